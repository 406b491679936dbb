"""Checks of claims taken apart into atoms. Atoms come as a table of answers; whatever made them, they must be grounded in the claim."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import symbol_tokens, utf16_length

ROLES = ("CORE", "ATTRIBUTION", "LOCATION_CONSTRAINT", "TEMPORAL_CONSTRAINT", "NUMERIC_CONSTRAINT", "CAUSAL_RELATION", "MODALITY_CONSTRAINT", "CONDITIONAL")
_LEADING = re.compile(r"^\S+\s+")


def locate(claim: str, source: str) -> tuple[int, int] | None:
    """Where a source text stands in a claim, in code points: as it is, then without punctuation at its edges, then without words from its beginning, down
    to four characters. Only a place that is the only one counts."""
    tries, rest = [source, source.strip(" .,;:!?\"'“”‘’()")], source.strip(" .,;:!?\"'“”‘’()")
    while (m := _LEADING.match(rest)) and len(rest) - m.end() >= 4:
        rest = rest[m.end() :]
        tries.append(rest)
    for t in tries:
        if t and claim.count(t) == 1:
            return claim.index(t), claim.index(t) + len(t)
    return None


def _located(claim: pd.Series, source: pd.Series) -> pd.DataFrame:
    found = [locate(c, s) if c and s else None for c, s in zip(claim, source)]
    return pd.DataFrame({"start_cp": [x and x[0] for x in found], "end_cp": [x and x[1] for x in found]}).astype("Int32")


def locate_in(claim: Column, source: Column) -> Column:
    return F.pandas_udf(_located, "struct<start_cp:int,end_cp:int>")(claim, source)


def ground(atoms: DataFrame, claims: DataFrame) -> DataFrame:
    """``case_id, atom_id, start_u16, end_u16, grounded``: source texts found again in their claims, in code units."""
    rows = atoms.join(claims, "case_id").withColumn("at", locate_in(F.col("claim"), F.col("source_text")))
    units = lambda n: utf16_length(F.expr(f"substring(claim, 1, at.{n})"))
    return rows.select("case_id", "atom_id", units("start_cp").alias("start_u16"), units("end_cp").alias("end_u16"), F.col("at.start_cp").isNotNull().alias("grounded"))


def warnings(atoms: DataFrame, claims: DataFrame) -> DataFrame:
    """``case_id, atom_id, code``: source text that several atoms share, or too short to place, words that need another atom to be understood, several
    amounts in one atom, and claims of several sentences that one atom covers."""
    shared = Window.partitionBy("case_id", "source_text")
    amounts = F.size(F.filter(F.split("text", r"[;,](?!\d)\s*|\s(?:and|but|while|whereas)\s"), lambda c: c.rlike("[0-9]") & c.rlike(r"(?i)\b(?:is|are|was|were|has|have|had|rose|fell|reached|covered|counted|spent)\b")))
    codes = {
        "REUSED_SOURCE_TEXT": F.count("*").over(shared) > 1,
        "AMBIGUOUS_SOURCE_TEXT": F.length(F.trim("source_text")) < 4,
        "NON_STANDALONE_REFERENCE": F.col("text").rlike(r"(?i)^(?:he|she|it|they|this|that|these|those|his|her|its|their)\b"),
        "MULTIPLE_NUMERIC_ASSERTIONS": amounts > 1,
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes.items()]))
    per_atom = atoms.withColumn("_codes", flags).select("case_id", "atom_id", F.explode("_codes").alias("code"))
    spans = atoms.groupBy("case_id").agg(F.max(F.col("end_off") - F.col("start_off")).alias("longest"), F.count("*").alias("n"))
    whole = claims.join(spans, "case_id").where((F.col("n") == 1) & (F.col("longest") >= 0.9 * F.length("claim")) & (F.size(F.split("claim", r"[.!?]\s+(?=[A-Z])")) >= 2))
    return per_atom.unionByName(whole.select("case_id", F.lit(None).cast("string").alias("atom_id"), F.lit("UNDER_DECOMPOSED").alias("code")))


def redundant_covering(atoms: DataFrame) -> DataFrame:
    """``case_id, atom_id`` of the first atom that spans all others of its case and says nothing they don't, in cases of three atoms at least."""
    case = Window.partitionBy("case_id")
    rows = atoms.withColumn("n", F.count("*").over(case)).withColumn("lo", F.min("start_off").over(case)).withColumn("hi", F.max("end_off").over(case)).withColumn("ts", symbol_tokens(F.col("text")))
    covering = rows.where("n >= 3 AND start_off = lo AND end_off = hi")
    others = covering.select("case_id", "atom_id", F.col("ts").alias("own")).join(rows.select("case_id", F.col("atom_id").alias("other"), "ts"), "case_id").where("other <> atom_id")
    said = others.groupBy("case_id", "atom_id", "own").agg(F.flatten(F.collect_list("ts")).alias("all")).where(F.size(F.array_except("own", "all")) == 0)
    return said.groupBy("case_id").agg(F.min("atom_id").alias("atom_id"))


def normalized_role(role: Column, text: Column) -> Column:
    """A role that the words of its atom don't bear out becomes the one they do."""
    causal = text.rlike(r"(?i)\b(?:cause[sd]?|because|led to|due to|result(?:s|ed) in)\b")
    said = text.rlike(r"(?i)\b(?:said|says|told|according to|claim(?:s|ed)?|stated|wrote|announced|reported)\b")
    bound = text.rlike(r"(?i)\b(?:at least|at most|more than|less than|fewer than|no more than|over|under|exactly)\b.*[0-9]")
    return F.when((role == "CAUSAL_RELATION") & ~causal, "CORE").when((role == "ATTRIBUTION") & ~said, "CORE").when((role == "CORE") & bound, "NUMERIC_CONSTRAINT").otherwise(role)
