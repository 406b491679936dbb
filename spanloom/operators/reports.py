"""Evaluation: agreement, confusion, latency, shares, transitions, regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("SUPPORTED", "REFUTED", "NOT_ENOUGH_EVIDENCE", "CONFLICTING_EVIDENCE")


def confusion(rows: DataFrame, reference: str, predicted: str) -> DataFrame:
    """Counts of every pair of labels, zeros included, without a shuffle of more than the counts."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], f"{reference} string, {predicted} string")
    counts = rows.groupBy(reference, predicted).agg(F.count("*").alias("n"))
    return cells.join(counts, [reference, predicted], "left").na.fill(0, ["n"])


def latency(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """Median (interpolated), mean, largest and number of the values per stage; negative ones don't count."""
    return rows.where(F.col(value) >= 0).groupBy(stage).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("largest"), F.count("*").alias("n"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Counts per key and their shares of all."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # over the few counts, not the rows


def agreement(matches: Column) -> Column:
    return F.avg(matches.cast("int"))


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Checks of a run against its baseline (both: ``mean_atoms, fallbacks, high_severity, repair_rate``, one row)."""
    names = ["mean_atoms", "fallbacks", "high_severity", "repair_rate"]
    both = current.select(*names).crossJoin(F.broadcast(baseline.select(*[F.col(c).alias("base_" + c) for c in names])))  # one row each
    checks = {
        "mean_atoms": F.col("mean_atoms") <= F.col("base_mean_atoms") * 1.10,
        "fallbacks": F.col("fallbacks") <= F.col("base_fallbacks"),
        "high_severity": F.col("high_severity") <= F.col("base_high_severity"),
        "repair_rate": F.col("repair_rate") <= 0.10,
    }
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")


def relation_of_span(support: Column, refute: Column, context: Column, span: Column, sufficient: Column, mismatch: Column) -> Column:
    """How a report names a span: by its decisive relation, as potential where evidence is not sufficient; a scope mismatch overrides."""
    return (
        F.when(mismatch, "SCOPE_MISMATCH")
        .when(F.array_contains(support, span), F.when(sufficient, "SUPPORTS").otherwise("POTENTIAL_SUPPORTS"))
        .when(F.array_contains(refute, span), F.when(sufficient, "REFUTES").otherwise("POTENTIAL_REFUTES"))
        .when(F.array_contains(context, span), "CONTEXT")
        .otherwise("NOT_SELECTED")
    )
