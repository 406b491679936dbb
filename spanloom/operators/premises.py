"""What rules may rest on: evidence and its context, complete lists and their items, lines with amounts; and the candidates of rules with the premises each may use.

A premise has ``case_id, premise_id, document_id, kind, text, start_u16, end_u16`` (and, for lists, ``digest``), always a piece of its document at its place. Atoms meet the premises of
their case only; documents are read once for all atoms.

Defined results: null and empty documents give no premises; a document that comes twice gives its premises once; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import facts
from spanloom.functions.text import identity_tokens, symbol_tokens, utf16_length
from spanloom.operators.prepare import once
from spanloom.operators.rules import BEFORE_COPULA, _COUNT, attribute_profile, superlative

# Limits of lines, list items, operands and context, and what is no row of a table.
LINE_CHARS, MOST_ITEMS, MOST_OPERANDS, CONTEXT_CHARS, SHOWN_CHARS = 500, 4, 8, 5000, 240
NO_ROW = r"(?i)^(?:capital city|total|all capitals|regional|---)"
AMOUNT = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?"
BLANKS, _DIGIT, _LETTER = " \t\n\x0b\f\r", re.compile("[0-9]"), re.compile("[A-Za-z]")
COLUMNS = ["case_id", "premise_id", "document_id", "kind", "text", "start_u16", "end_u16", "digest"]


def _once(documents: DataFrame) -> DataFrame:
    return once(documents.select("case_id", "document_id", "text"), ["case_id", "document_id"], "text = ''").withColumnRenamed("text", "body")


def _placed(rows: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Offsets in code units of a piece of ``body``, given in code points."""
    return rows.withColumn("start_u16", utf16_length(F.substring("body", F.lit(1), begin))).withColumn("end_u16", utf16_length(F.substring("body", F.lit(1), end)))


def evidence_premises(spans: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Chosen spans (case_id, atom_id, span_id, document_id, text, start_u16, end_u16) and their context (the same with context_id) as premises."""
    key = lambda kind, c: F.concat_ws(":", F.lit(kind), "atom_id", "document_id", c)
    none = F.lit(None).cast("string").alias("digest")
    out = spans.select("case_id", key("evidence", "span_id").alias("premise_id"), "document_id", F.lit("EVIDENCE").alias("kind"), "text", "start_u16", "end_u16", none)
    if contexts is not None:
        out = out.unionByName(contexts.select("case_id", key("context", "context_id").alias("premise_id"), "document_id", F.lit("OPERAND").alias("kind"), "text", "start_u16", "end_u16", none))
    return out.dropDuplicates(["case_id", "premise_id"])


def list_premises(documents: DataFrame) -> DataFrame:
    """The certificates of complete lists and their items, at their places."""
    rows = _once(documents).select("case_id", "document_id", "body", F.explode(facts.lists_in(F.col("body"))).alias("l"))
    rows = rows.withColumn("list", F.concat(F.lit("list:"), "document_id", F.when(F.col("l.kind") == "counted", ":counted-").otherwise(":"), F.col("l.no").cast("string")))
    # the list itself, then its items, so that every document is read once
    whole = F.struct(F.col("l.text").alias("name"), F.col("l.begin").alias("begin"), F.col("l.end").alias("end"))
    rows = rows.select("case_id", "document_id", "body", "list", F.col("l.digest").alias("digest"), F.posexplode(F.concat(F.array(whole), "l.placed")).alias("i", "p"))
    item = F.col("i") > 0
    name, kind = F.when(item, F.concat(F.lit(":item:"), F.col("i").cast("string"))).otherwise(":certificate"), F.when(item, "LIST_ITEM").otherwise("LIST_CERTIFICATE")
    return _placed(rows, F.col("p.begin"), F.col("p.end")).select("case_id", F.concat("list", name).alias("premise_id"), "document_id", kind.alias("kind"), F.col("p.name").alias("text"), "start_u16", "end_u16", "digest")


def line_operands(documents: DataFrame) -> DataFrame:
    """Short lines with a digit and a letter, as rows of operands; numbered among a document's short lines."""
    rows = _once(documents).select("case_id", "document_id", F.explode(_lines_of(F.col("body"))).alias("l"))
    return rows.select("case_id", F.concat(F.lit("operand:"), "document_id", F.lit(":line:"), F.col("l.no").cast("string")).alias("premise_id"), "document_id", F.lit("OPERAND").alias("kind"), "l.text", "l.start_u16", "l.end_u16", F.lit(None).cast("string").alias("digest"))


def _numbered_lines(body: str) -> list[dict]:
    """The lines of ``line_operands`` in one walk."""
    out, begin, no = [], 0, 0
    for line in body.split("\n"):
        if 1 <= len(line) <= LINE_CHARS:
            no += 1
            if _DIGIT.search(line) and _LETTER.search(line):
                text = line.strip(BLANKS)
                start = begin + len(line) - len(line.lstrip(BLANKS))  # blanks are one code unit each
                out.append({"no": no, "text": text, "start_u16": start, "end_u16": start + _units(text)})
        begin += _units(line) + 1
    return out


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _lines_of(text: Column) -> Column:
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([_numbered_lines(t) if t else [] for t in texts])

    return F.pandas_udf(column, "array<struct<no:int,text:string,start_u16:int,end_u16:int>>")(text)


def context_premises(atoms: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """For spans that don't name the subject of a counting claim: the piece of their document from the nearest line above that does, if it isn't too long.
    ``spans``: case_id, atom_id, span_id, document_id, text, start_u16, end_u16. Also has ``atom_id``."""
    subject = symbol_tokens(F.regexp_extract(F.lower("text"), BEFORE_COPULA, 1))
    asked = atoms.where(F.regexp_extract("text", _COUNT, 2) != "").select("case_id", "atom_id", subject.alias("subject")).where(F.size("subject") > 0)
    loose = spans.join(asked, ["case_id", "atom_id"]).where(F.size(F.array_except("subject", symbol_tokens(F.col("text")))) > 0)
    lines = _once(documents).select("case_id", "document_id", "body", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    order = Window.partitionBy("case_id", "document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(utf16_length(F.col("line")) + 1).over(order), F.lit(0)).cast("int")).where("line <> ''").select("case_id", "document_id", "at", symbol_tokens(F.col("line")).alias("ts"))
    near = loose.join(lines, ["case_id", "document_id"]).where((F.col("at") < F.col("start_u16")) & (F.size(F.array_except("subject", "ts")) == 0))
    anchors = near.groupBy("case_id", "atom_id", "document_id", "span_id", "end_u16").agg(F.max("at").alias("start_u16")).where(F.col("end_u16") - F.col("start_u16") <= CONTEXT_CHARS)
    rows = anchors.join(_once(documents), ["case_id", "document_id"])
    piece = F.decode(F.substring(F.encode("body", "UTF-16LE"), F.col("start_u16") * 2 + 1, (F.col("end_u16") - F.col("start_u16")) * 2), "UTF-16LE")
    return rows.select("case_id", "atom_id", F.concat_ws(":", F.lit("context-record"), "atom_id", "document_id", "span_id").alias("premise_id"), "document_id", F.lit("OPERAND").alias("kind"), piece.alias("text"), "start_u16", "end_u16", F.lit(None).cast("string").alias("digest"))


def extremum_operands(atoms: DataFrame, operands: DataFrame) -> DataFrame:
    """``case_id, atom_id, premise_id, place``: for superlatives the eight best lines: rows of tables if there are any, those that share a word with the claim first, then by
    their largest (or smallest) amount that is no year."""
    asked = atoms.withColumn("word", superlative(F.col("text"))).where("word IS NOT NULL").select("case_id", "atom_id", "word", symbol_tokens(F.col("text")).alias("ts"))
    amounts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(AMOUNT), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")), lambda x: ~x.between(1900, 2100))
    held = operands.select("case_id", "premise_id", (F.col("text").contains("|") & ~F.trim("text").rlike(NO_ROW)).alias("row"), symbol_tokens(F.col("text")).alias("os"), amounts.alias("ns")).where(F.size("ns") > 0)
    rows = asked.join(held, "case_id")
    most = F.col("word").isin("largest", "highest", "tallest", "most")
    rows = rows.withColumn("rows", F.max(F.col("row").cast("int")).over(Window.partitionBy("case_id", "atom_id"))).where(F.col("row") | (F.col("rows") == 0))
    order = [F.when(F.arrays_overlap("ts", "os"), 0).otherwise(1), F.when(most, -F.array_max("ns")).otherwise(F.array_min("ns")), F.col("premise_id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "atom_id").orderBy(*order))).where(F.col("place") <= MOST_OPERANDS).select("case_id", "atom_id", "premise_id", "place")


def list_operands(atoms: DataFrame, lists: DataFrame) -> DataFrame:
    """``case_id, atom_id, premise_id, place``: the certificates that share a name with a claim about membership, then its first four likely items: those that the claim
    has whole, or shares a word with."""
    asked = atoms.where(F.lower("text").rlike(r"\b(?:list|listed|member|included|designated)\b")).select("case_id", "atom_id", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("said"), symbol_tokens(F.col("text")).alias("ts"), identity_tokens(F.col("text")).alias("names"))
    met = asked.join(lists, "case_id")
    whole = met.where((F.col("kind") == "LIST_CERTIFICATE") & F.arrays_overlap("names", identity_tokens(F.col("text"))))
    likely = met.where((F.col("kind") == "LIST_ITEM") & (F.contains("said", F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))) | F.arrays_overlap("ts", symbol_tokens(F.col("text")))))
    order = Window.partitionBy("case_id", "atom_id").orderBy("document_id", "start_u16", "premise_id")
    likely = likely.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MOST_ITEMS)
    rows = whole.select("case_id", "atom_id", "premise_id", "document_id", "start_u16", F.lit(0).alias("k")).unionByName(likely.select("case_id", "atom_id", "premise_id", "document_id", "start_u16", F.lit(1).alias("k")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "atom_id").orderBy("k", "document_id", "start_u16", "premise_id"))).select("case_id", "atom_id", "premise_id", "place")


def build_candidates(atoms: DataFrame, chosen: DataFrame, lists: DataFrame, operands: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """``case_id, atom_id, candidate_id, operator, profile, premise_ids``: the rules an atom qualifies for by its words, each with the premises it may use, in order.
    ``chosen``: case_id, atom_id, premise_id, place (evidence, then its context); ``contexts``: ``context_premises``."""
    from spanloom.operators.rules import candidates

    found = candidates(atoms)
    dated = F.lower("text").rlike(r"\b(?:before|after)\b") & ~F.col("text").rlike(r"\b(?:19|20)[0-9]{2}\b")
    names = {"SET_MEMBERSHIP": "set", "COUNT_DISTINCT": "distinct", "EXTREMUM_COMPARE": "extremum", "ATTRIBUTE_COMPARE": "attribute", "NUMERIC_COMPARE": "numeric", "TEMPORAL_COMPARE": "temporal"}
    profiles = {"SET_MEMBERSHIP": F.lit("GENERIC_SET_MEMBERSHIP"), "COUNT_DISTINCT": F.lit("GENERIC_DISTINCT_VALUES"), "EXTREMUM_COMPARE": F.lit("GENERIC_EXTREMUM_COUNTEREXAMPLE"), "ATTRIBUTE_COMPARE": attribute_profile(F.col("text")), "NUMERIC_COMPARE": F.lit("GENERIC_NUMERIC_THRESHOLD"), "TEMPORAL_COMPARE": F.when(dated, "GENERIC_EVENT_ORDER").otherwise("GENERIC_ABSOLUTE_DATE")}
    pick = lambda table: reduce(lambda out, kv: F.when(F.col("operator") == kv[0], kv[1]).otherwise(out), table.items(), F.lit(None).cast("string"))
    found = found.withColumn("profile", pick(profiles)).withColumn("candidate_id", F.concat_ws(":", F.lit("candidate"), "atom_id", pick(names)))
    evidence = chosen.select("case_id", "atom_id", F.lit(0).alias("k"), "place", "premise_id")
    parts = [evidence.withColumn("for", F.explode(F.array(*[F.lit(o) for o in names if o != "SET_MEMBERSHIP"]))), list_operands(atoms, lists).withColumn("k", F.lit(1)).withColumn("for", F.lit("SET_MEMBERSHIP")), extremum_operands(atoms, operands).withColumn("k", F.lit(1)).withColumn("for", F.lit("EXTREMUM_COMPARE"))]
    if contexts is not None:
        parts.append(contexts.select("case_id", "atom_id", "premise_id", F.lit(1).alias("k"), F.row_number().over(Window.partitionBy("case_id", "atom_id").orderBy("premise_id")).alias("place"), F.lit("COUNT_DISTINCT").alias("for")))
    rows = reduce(DataFrame.unionByName, parts).withColumnRenamed("for", "operator")
    # a budget of evidence, eight operands, four items and the certificates of a case
    ids = rows.groupBy("case_id", "atom_id", "operator").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "place", "premise_id"))), lambda x: x["premise_id"])).alias("premise_ids"))
    out = found.join(ids, ["case_id", "atom_id", "operator"], "left")
    return out.select("case_id", "atom_id", "candidate_id", "operator", "profile", F.coalesce("premise_ids", F.array().cast("array<string>")).alias("premise_ids"))
