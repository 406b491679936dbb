"""Problem 9: mix sources to target weights of the total tokens.

Weighted fair queueing: within a source, documents stand in a shuffled order (by a hash of seed and id), one round after
another up to the source's ``max_repeats``. A document's virtual finish time is its source's tokens so far, itself included, divided
by the target weight; all are sorted by that time, and those within the token budget make the mix. Sources keep step with their weights until
they run out; the others then share the rest by theirs.

No source is summed in one task: documents fall into hash buckets, whose token sums give every bucket its start, and
only within a bucket a running sum is taken. The budget's cut is found likewise from token sums over slices of virtual time.
``BUCKETS`` and ``SLICES`` bound what those sums amount to, whatever the corpus.

Defined results: texts without tokens, null texts, ids and sources, and sources without a target (or with one of 0 or less, or with no repeats allowed) take
no part; a source given two targets counts as given the larger; repeated ids are one document; equal finish times are ordered by source, round and
id; a budget of 0 or an empty table gives an empty mix. A budget that only a part of the next document would fit into ends before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tokens import token_counts
from spanloom.session import materialize

BUCKETS = 4096
SLICES = 4096
#: So many rows of the queue are ordered in one task where the budget cuts it.
EDGE_ROWS = 100_000


def document_sizes(documents: DataFrame, targets: DataFrame, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, h`` of the documents that may take part, counted once and kept."""
    wanted = clean_targets(targets).select("source")
    known = documents.where("doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0").join(F.broadcast(wanted), "source", "left_semi")  # targets are listed by hand
    sizes = token_counts(known.select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0")
    # one row per document; the hash orders a source's documents
    return materialize(sizes.groupBy("doc_id").agg(F.min_by(F.struct("source", "n_tokens"), F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*", F.xxhash64(F.lit(seed), "doc_id").alias("h")), "token-sizes")


def clean_targets(targets: DataFrame) -> DataFrame:
    return targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))


def finish_times(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, round, finish`` of every document in every round it may be used in."""
    bucket = F.shiftright("h", 64 - BUCKETS.bit_length() + 1)  # equal ranges of the hash, in its order
    rows = sizes.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("own"))  # at most sources x BUCKETS rows
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("total", F.sum("own").over(Window.partitionBy("source")))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sofar", F.sum("n_tokens").over(within)).join(sums.drop("own"), ["source", "bucket"])
    rows = rows.join(F.broadcast(clean_targets(targets)), "source").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    return rows.select("doc_id", "source", "n_tokens", "round", ((F.col("round") * F.col("total") + F.col("ahead") + F.col("sofar")) / F.col("target_share")).alias("finish"))


def within_budget(queue: DataFrame, budget: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The front of ``queue`` whose tokens fit into ``budget``. Sums over slices of virtual time find the slice that is cut inside; while it has more
    than ``edge_rows`` rows it is sliced again, as a target of a tiny share stretches time and puts most rows into few slices."""
    found = queue.agg(F.min("finish"), F.max("finish"), F.count("*")).first()
    (low, high, rows), ahead, part = found, 0, queue
    while rows:
        place = F.least(F.floor((F.col("finish") - low) / (high - low) * SLICES), F.lit(SLICES - 1)) if high > low else F.lit(0)
        sums = part.groupBy(place.cast("int").alias("slice")).agg(F.sum("n_tokens").alias("own"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()  # at most SLICES rows
        edge = None
        for r in sorted(sums, key=lambda r: r["slice"]):
            if ahead + r["own"] > budget:
                edge = r
                break
            ahead += r["own"]
        if edge is None:
            return queue
        low, high, rows = edge["low"], edge["high"], edge["n"]
        if rows <= edge_rows or low == high or len(sums) == 1:
            break
        part = queue.where(F.col("finish").between(low, high))
    if not rows:
        return queue
    whole = queue.where(F.col("finish") < low)
    inside = Window.orderBy("finish", "source", "round", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # a slice's few rows, or ties
    cut = queue.where(F.col("finish").between(low, high)).withColumn("upto", F.lit(ahead) + F.sum("n_tokens").over(inside))
    return whole.unionByName(cut.where(F.col("upto") <= budget).select(*queue.columns))


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, vocabulary: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, round, n_tokens, finish``, sorted by virtual finish time. Without a budget the mix is as long as the
    documents that take part are together, each used once."""
    own = document_sizes(documents, targets, seed, vocabulary) if sizes is None else sizes
    queue = finish_times(own, targets)
    total = (own.agg(F.sum("n_tokens")).first()[0] or 0) if budget is None else budget
    chosen = within_budget(queue, total)
    return chosen.select("doc_id", "source", "round", "n_tokens", "finish").repartitionByRange("finish", "source", "round", "doc_id").sortWithinPartitions("finish", "source", "round", "doc_id")


def mix_report(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """Per target: its share, the share reached, documents and uses, and the reason for a shortfall."""
    sizes = document_sizes(documents, targets, seed, vocabulary)
    chosen = materialize(mix(documents, targets, budget, seed, vocabulary, sizes), "mix")
    used = chosen.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("round").alias("round"))
    there = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    total = chosen.agg(F.sum("n_tokens")).first()[0] or 1
    rows = clean_targets(targets).join(there, "source", "left").join(used, "source", "left")
    share = F.coalesce(F.col("tokens") / total, F.lit(0.0))
    spent = F.col("uses") >= F.col("n_docs") * F.col("max_repeats")
    reason = (
        F.when(F.col("n_docs").isNull(), "no documents")
        .when(share >= F.col("target_share") * 0.99, None)
        .when(spent, "all documents used max_repeats times")
        .otherwise("budget too small to follow the weights")
    )
    return rows.select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        share.alias("reached_share"), reason.alias("shortfall_reason"),
    )
