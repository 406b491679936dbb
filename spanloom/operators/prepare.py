"""Selection of cases and documents for a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize


def once(df: DataFrame, keys: list[str], drop: str = "false") -> DataFrame:
    """One row per key, without rows that ``drop`` holds for. Only keys and the rows of repeated ones are moved: texts whose key comes once stay where they are read."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    repeated = materialize(repeated, "repeated-keys")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = df.where(f"NOT ({drop})")
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(keys))


def first_rows(df: DataFrame, key: str, order: list[Column], most: int, least: int = 1) -> DataFrame:
    """The first ``most`` rows per key, for keys with ``least`` at least. A key with very many rows sends only its first ones on."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = df.withColumn("place", place).where(F.col("place") <= most)
    enough = kept.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return kept.join(enough, key, "left_semi")


def balanced(df: DataFrame, label: str, order: list[Column], each: int) -> DataFrame:
    """``each`` rows per label by preference; labels with fewer are left out."""
    return first_rows(df, label, order, each, each)


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``base`` with the non-null fields of ``patch`` in their place."""
    fields = [c for c in patch.columns if c != key and c in base.columns]
    renamed = patch.select(key, *[F.col(c).alias("_p_" + c) for c in fields])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce("_p_" + c, c).alias(c) if c in fields else F.col(c) for c in base.columns])


def unknown_keys(patch: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return patch.join(base, key, "left_anti").select(key)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def is_relevant(text: Column, query_tokens: Column, text_tokens: Column, answer: Column) -> Column:
    """Enough tokens of the query in the text, or a long answer word for word."""
    need = F.least(F.lit(8), F.greatest(F.lit(3), F.floor(F.size(query_tokens) / 12)))
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return (F.size(F.array_intersect(query_tokens, text_tokens)) >= need) | ((F.length(flat(answer)) >= 24) & F.contains(flat(text), flat(answer)))


def policy_gaps(df: DataFrame, policy: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Where counts per key differ from a policy's (``key, expected``), either way."""
    have = df.groupBy(key).agg(F.count("*").alias(count))
    both = have.join(policy, key, "full").select(key, F.coalesce(count, F.lit(0)).alias(count), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where(F.col(count) != F.col("expected"))
