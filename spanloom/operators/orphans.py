"""Problem 3: references to records that do not exist, per table, field and month.

A reference is an orphan if no row of its target is live at the reference's own time: a target row is live from
``ingested_at`` (inclusive) until ``deleted_at`` (exclusive; null: for ever).

Plan: references are pre-aggregated per field, key and period (count, first and last time), and these rows meet the live spans
of their keys in an anti join: what a span covers whole has no orphan. Raw references come back only for the keys and periods left. The
totals give the heavy keys, of which there are at most ``1 / HEAVY_SHARE`` per field, so their periods and spans can be broadcast;
all other keys meet theirs in shuffled joins, where no key is large. Both parts are united.

Defined results: null references and references without a time are no cases; null target keys match nothing; target rows
that end before they begin are never live; a row that arrives twice is one reference; empty targets make every reference
an orphan; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize

#: A key with more than this share of a field's references is heavy; hence at most 1 / HEAVY_SHARE heavy keys a field.
HEAVY_SHARE = 0.001
#: A heavy key is broadcast only with at most so many live spans; any other goes through the skew-aware shuffle.
HEAVY_SPANS = 1_000


def references(df: DataFrame, table: str, field: str, ref_key: str, target: str, at: str) -> DataFrame:
    """``(ref_table, ref_field, ref_key, target_key, ref_time)`` of the rows with a reference."""
    return df.select(
        F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(ref_key).cast("string").alias("ref_key"), F.col(target).cast("string").alias("target_key"), F.col(at).alias("ref_time")
    ).where(F.col("target_key").isNotNull() & F.col("ref_time").isNotNull())


def live_spans(df: DataFrame, key: str, begins: str = "ingested_at", ends: str = "deleted_at") -> DataFrame:
    """``(key, live_from, live_to)``: the disjoint spans in which some row with the key is live; ``live_to`` null: for ever.

    The first aggregation leaves one row per key and end; a running maximum over them joins what overlaps. Both run
    sorted and spill, so a key with very many rows costs time, not memory.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(begins).alias("b"), F.col(ends).alias("e")).where("key IS NOT NULL AND b IS NOT NULL AND (e IS NULL OR e > b)")
    rows = rows.groupBy("key", "e").agg(F.min("b").alias("b"))
    order = Window.partitionBy("key").orderBy("b", F.col("e").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.max(F.col("e").isNull()).over(before)).withColumn("reach", F.max("e").over(before))
    rows = rows.withColumn("fresh", F.when(F.coalesce("open", F.lit(False)) | F.coalesce(F.col("b") <= F.col("reach"), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "island").agg(F.min("b").alias("live_from"), F.when(F.max(F.col("e").isNull()), None).otherwise(F.max("e")).alias("live_to")).select("key", "live_from", "live_to")


def reference_periods(refs: DataFrame) -> DataFrame:
    """References per field, key and period (month): count, first and last time."""
    return refs.groupBy("ref_table", "ref_field", "target_key", "period").agg(F.count("*").alias("n_refs"), F.min("ref_time").alias("first_ref"), F.max("ref_time").alias("last_ref"))


def heavy_keys(refs: DataFrame) -> DataFrame:
    """``(ref_table, ref_field, target_key)`` of the keys above the heavy share: a bounded number of rows."""
    per_key = reference_periods(refs).groupBy("ref_table", "ref_field", "target_key").agg(F.sum("n_refs").alias("n"))
    total = per_key.groupBy("ref_table", "ref_field").agg(F.sum("n").alias("total"))
    return (
        per_key.join(F.broadcast(total), ["ref_table", "ref_field"])  # one row per referring field
        .where((F.col("n") > F.col("total") * HEAVY_SHARE) & (F.col("n") > HEAVY_LEAST))
        .select("ref_table", "ref_field", "target_key")
    )


def heavy_keys(periods: DataFrame) -> DataFrame:
    """``(ref_table, ref_field, target_key)`` of the keys above the heavy share: at most ``1 / HEAVY_SHARE`` rows a field."""
    per_key = periods.groupBy("ref_table", "ref_field", "target_key").agg(F.sum("n_refs").alias("n"))
    total = per_key.groupBy("ref_table", "ref_field").agg(F.sum("n").alias("total"))
    joined = per_key.join(F.broadcast(total), ["ref_table", "ref_field"])  # one row per referring field
    return joined.where(F.col("n") > F.col("total") * HEAVY_SHARE).select("ref_table", "ref_field", "target_key")


def suspect_periods(periods: DataFrame, spans: DataFrame) -> DataFrame:
    """Keys and periods of which no single span covers the time from first to last reference, so that some may be orphans;
    ``hot`` where the key is heavy and has at most ``HEAVY_SPANS`` spans. The anti join is one of aggregated rows."""
    covers = (F.col("target_key") == spans["key"]) & (spans["live_from"] <= F.col("first_ref")) & (spans["live_to"].isNull() | (spans["live_to"] > F.col("last_ref")))
    manifold = spans.groupBy("key").count().where(F.col("count") > HEAVY_SPANS).select(F.col("key").alias("target_key"))
    heavy = heavy_keys(periods).join(manifold, "target_key", "left_anti").withColumn("hot", F.lit(True))
    found = periods.join(spans, covers, "left_anti").select("ref_table", "ref_field", "target_key", "period")
    return found.join(F.broadcast(heavy), ["ref_table", "ref_field", "target_key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def find_orphans(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """The orphan references of ``refs``, all of one target table; repeated rows stay repeated."""
    refs = refs.withColumn("period", F.date_format("ref_time", "yyyy-MM"))
    spans = materialize(live_spans(targets, key), "live-spans")
    suspects = materialize(suspect_periods(materialize(reference_periods(refs), "reference-periods"), spans), "suspect-periods")
    # raw references are met again only where their key and period is suspect
    on = ["ref_table", "ref_field", "target_key", "period"]
    live = lambda s: (F.col("target_key") == s["key"]) & (s["live_from"] <= F.col("ref_time")) & (s["live_to"].isNull() | (s["live_to"] > F.col("ref_time")))
    # at most 1 / HEAVY_SHARE keys a field, each with as many rows as there are months, and HEAVY_SPANS spans
    hot = F.broadcast(suspects.where("hot").select(*on))
    hot_spans = F.broadcast(spans.join(F.broadcast(suspects.where("hot").select("target_key").distinct()), spans["key"] == F.col("target_key"), "left_semi"))
    heavy = refs.join(hot, on, "left_semi").join(hot_spans, live(hot_spans), "left_anti")
    rest = refs.join(suspects.where("NOT hot").select(*on), on, "left_semi").join(spans, live(spans), "left_anti")
    return heavy.unionByName(rest).drop("period")


def corpus_references(audit: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of the project's tables: to cases, and to documents."""
    cases = references(audit, "fetch_audit", "case_id", "audit_id", "case_id", "logged_at")
    listed = catalog.select("case_id", "published_at", F.explode("documents.id").alias("document_ref"))
    documents = references(audit, "fetch_audit", "document_id", "audit_id", "document_id", "logged_at").unionByName(references(listed, "catalog", "documents.id", "case_id", "document_ref", "published_at"))
    return cases, documents


def orphan_references(audit: DataFrame, catalog: DataFrame, case_documents: DataFrame) -> DataFrame:
    """Orphans among all references of the project's tables, one row per record, field and key."""
    cases, documents = corpus_references(audit, catalog)
    found = [find_orphans(cases, catalog, "case_id"), find_orphans(documents, case_documents, "document_id")]
    return reduce(DataFrame.unionByName, found).groupBy("ref_table", "ref_field", "ref_key", "target_key").agg(F.min("ref_time").alias("ref_time"))


def orphan_report(audit: DataFrame, catalog: DataFrame, case_documents: DataFrame) -> DataFrame:
    """References and orphans per referring table, field and month of the reference."""
    cases, documents = corpus_references(audit, catalog)
    keys = ["ref_table", "ref_field", "ref_key", "target_key"]
    month = F.date_format("ref_time", "yyyy-MM").alias("period")
    rows = cases.unionByName(documents).withColumn("n_orphans", F.lit(0)).unionByName(orphan_references(audit, catalog, case_documents).withColumn("n_orphans", F.lit(1)))
    # a redelivered reference counts once, and is an orphan if found so: one shuffle for both counts
    every = rows.groupBy(*keys).agg(F.min("ref_time").alias("ref_time"), F.max("n_orphans").alias("n_orphans"))
    return every.groupBy("ref_table", "ref_field", month).agg(F.count("*").alias("n_refs"), F.sum("n_orphans").cast("bigint").alias("n_orphans"))
