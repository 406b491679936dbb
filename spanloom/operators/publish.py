"""Gates before results are published, as one boolean column per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` of every rule that a row breaks; a rule that gives null is broken, too."""
    flags = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, flags.alias("_failed")).select(key, F.explode("_failed").alias("rule"))


def run_rules() -> dict[str, Column]:
    """The structural rules of a run: schema, coverage, timings, decisive evidence, verdict and label, and a graph that can be shown."""
    return {
        "SCHEMA_VERSION": F.col("schema_version") == 7,
        "ATOM_COUNT": F.col("n_atoms").between(1, 12),
        "ASSESSED_ATOMS": F.col("n_assessed") == F.col("n_atoms"),
        "TIMINGS": F.forall("timings", lambda t: t >= 0),
        "DECISIVE_EVIDENCE": (F.col("verdict") == "NOT_ENOUGH_EVIDENCE") | (F.col("n_edges") > 0),
        "VERDICT_IS_LABEL": F.col("verdict") == F.col("label"),
        "GRAPH_SIZE": F.col("n_nodes") <= 60,
    }


def grounding_errors(premises: DataFrame, documents: DataFrame) -> DataFrame:
    """Premises (case_id, document_id, premise_id, start_u16, end_u16, text) whose document is unknown or has another text at their place."""
    rows = premises.withColumnRenamed("text", "said").join(documents.select("case_id", "document_id", F.col("text").alias("body")), ["case_id", "document_id"], "left")
    # compared as code units, as offsets may split a character
    there = F.substring(F.encode("body", "UTF-16LE"), F.col("start_u16") * 2 + 1, (F.col("end_u16") - F.col("start_u16")) * 2)
    reason = F.when(F.col("body").isNull(), "UNKNOWN_DOCUMENT").when(~F.coalesce(there == F.encode("said", "UTF-16LE"), F.lit(False)), "TEXT_DIFFERS")
    return rows.select("case_id", "premise_id", reason.alias("reason")).where("reason IS NOT NULL")


def coverage_gaps(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a, b = expected.select(*keys).distinct().withColumn("_a", F.lit(1)), given.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.where("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_a").isNull(), "UNEXPECTED").otherwise("MISSING").alias("gap"))


def conflicting_documents(edges: DataFrame) -> DataFrame:
    """Cases and atoms whose supporting and refuting evidence share no document, and where both exist. ``edges``: case_id, atom_id, relation, document_id."""
    ids = lambda r: F.collect_set(F.when(F.col("relation") == r, F.col("document_id")))
    rows = edges.groupBy("case_id", "atom_id").agg(ids("SUPPORTS").alias("s"), ids("REFUTES").alias("r"))
    return rows.where((F.size("s") > 0) & (F.size("r") > 0) & ~F.arrays_overlap("s", "r")).select("case_id", "atom_id")


def prompt_leaks(claims: DataFrame, examples: DataFrame) -> DataFrame:
    """Claims that, by their words alone, are among the examples given to a model."""
    key = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    return claims.withColumn("_k", key(F.col("claim"))).join(examples.select(key(F.col("claim")).alias("_k")), "_k", "left_semi").drop("_k")


def without_overlap(df: DataFrame, by: list[str], spans: str, taken: str) -> DataFrame:
    """``spans`` (array of structs a, b) that touch none of ``taken``."""
    return df.select(*by, F.filter(spans, lambda x: ~F.exists(F.col(taken), lambda y: (x["a"] < y["b"]) & (x["b"] > y["a"]))).alias(spans))
