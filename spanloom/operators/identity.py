"""Names that mean one thing: normal forms, aliases within a document, and whether evidence speaks of the claim's names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import facts

# Titles and short forms.
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "sir", "dame", "lord", "lady", "president", "senator", "sen", "rep", "gen", "capt", "judge", "st")
CANONICAL = {"us": "united states", "u s": "united states", "usa": "united states", "uk": "united kingdom", "u k": "united kingdom", "covid 19": "covid"}
_MENTION = re.compile(r"\b(?:[A-Z]{2,}|(?:[A-Z][\w’'-]+\.?)(?:\s+(?:of|the|de|von)?\s?(?:[A-Z][\w’'-]+\.?))*)")
_SKIP = frozenset("the a an in on at of and but for is it this that these those he she they we our as by from since until with".split())


def entity_key(name: str) -> str:
    """A name's normal form: folded, without possessives, punctuation, articles, titles and a year before it."""
    text = unicodedata.normalize("NFKC", name).casefold()
    text = re.sub(r"['’]s\b", "", text)
    text = " ".join(re.sub(r"[^\w\s]", " ", text.replace("-", " ")).split())
    while True:
        cut = re.sub(rf"^(?:the|a|an|{'|'.join(HONORIFICS)}|(?:19|20)\d\d)\s+", "", text)
        if cut == text:
            return CANONICAL.get(text, text)
        text = cut


def mentions(text: str) -> list[str]:
    """Names in a text, the longest where several would overlap, each once."""
    out = []
    for m in _MENTION.finditer(text):
        words = m.group().split()
        while words and words[0].lower() in _SKIP:
            words = words[1:]
        if words:
            out.append(entity_key(" ".join(words)))
    return [x for x in dict.fromkeys(out) if x]


def alias_groups(text: str) -> dict[str, str]:
    """Every name of a document that has an alias, with the first name of its group: equated names, and a surname that only one full name ends in."""
    pairs = [(entity_key(a), entity_key(b)) for a, b in facts.aliases(text)]
    names = mentions(text)
    full = [n for n in names if " " in n]
    for n in names:
        if " " not in n:
            fits = [f for f in full if f.split()[-1] == n]
            if len(fits) == 1:
                pairs.append((fits[0], n))
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in parent}


def form_of(name: str) -> str | None:
    """What a name looks like: that of a person or body in several words, or an acronym; single words may be places and compete with nothing."""
    return "words" if " " in name else None


def mentioned(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, names``: the names in texts, each text read once."""

    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([mentions(t) if t else [] for t in texts])

    return df.select(*keys, F.pandas_udf(column, "array<string>")(F.col(text)).alias("names"))


def document_groups(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, groups``: of every document its names that have others there, with the first of each group; each document read once."""

    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([alias_groups(t) if t else {} for t in texts])

    return documents.select(*keys, F.pandas_udf(column, "map<string,string>")(F.col(text)).alias("groups"))


def _compare(required: pd.Series, names: pd.Series, groups: pd.Series) -> pd.DataFrame:
    out = []
    for need, here, group in zip(required, names, groups):
        group = dict(group) if group is not None else {}
        here = set(here) if here is not None else set()
        last = [n.split()[-1] for n in here if " " in n]
        known = here | {x for x in last if last.count(x) == 1}
        roots = {group.get(n, n) for n in known}
        matched = [n for n in need if n in known or group.get(n, n) in roots]
        rivals = {n for n in here if form_of(n)}
        competing = [n for n in need if n not in matched and form_of(n) and rivals - {x for x in rivals if group.get(x, x) == group.get(n, n)}]
        out.append((matched, competing))
    return pd.DataFrame(out, columns=["matched", "competing"])


def align(claims: DataFrame, evidence: DataFrame, groups: DataFrame | None = None, relation: str = "SUPPORTS") -> DataFrame:
    """``case_id, atom_id, required, matched, status`` for claims (case_id, atom_id, text) and the names in their evidence (case_id, atom_id, document_id, names), with the groups of
    names of the documents (case_id, document_id, groups).

    A claim's name is matched if some document has it under one of its names there. UNRESOLVED if one is not and its evidence has another name of its form instead, which
    a refutation may well have; ALIGNED else; not applicable without names. What meets are names, never texts."""
    need = mentioned(claims, ["case_id", "atom_id"]).withColumnRenamed("names", "required")
    rows = need.where(F.size("required") > 0).join(evidence.select("case_id", "atom_id", "document_id", "names"), ["case_id", "atom_id"])
    rows = rows.join(groups, ["case_id", "document_id"], "left") if groups is not None else rows.withColumn("groups", F.lit(None).cast("map<string,string>"))
    met = rows.withColumn("m", F.pandas_udf(_compare, "struct<matched:array<string>,competing:array<string>>")("required", "names", "groups"))
    both = met.groupBy("case_id", "atom_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.matched")))).alias("matched"), F.array_distinct(F.flatten(F.collect_list("m.competing"))).alias("competing"))
    empty = F.array().cast("array<string>")
    rows = need.join(both, ["case_id", "atom_id"], "left").withColumn("matched", F.coalesce("matched", empty)).withColumn("competing", F.array_except(F.coalesce("competing", empty), F.coalesce("matched", empty)))
    decisive = (F.size("competing") > 0) & F.lit(relation == "SUPPORTS")
    status = F.when(F.size("required") == 0, "NOT_APPLICABLE").when(decisive, "UNRESOLVED").otherwise("ALIGNED")
    return rows.select("case_id", "atom_id", "required", "matched", status.alias("status"))
