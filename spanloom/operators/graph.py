"""The argument graph of cases: nodes, edges, counts, and list certificates in their enclosing spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graph_nodes(cases: DataFrame, atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``case_id, node_id, kind``: the claim, its obligations, and what the edges come from, each once."""
    source_kind = F.when(F.col("kind") == "INFERENCE", "INFERENCE").when(F.col("kind") == "BUNDLE", "EVIDENCE_BUNDLE").otherwise("EVIDENCE")
    parts = [
        cases.select("case_id", F.lit("claim").alias("node_id"), F.lit("CASE_CLAIM").alias("kind")),
        atoms.select("case_id", F.concat(F.lit("obligation:"), "atom_id").alias("node_id"), F.lit("VERIFICATION_OBLIGATION").alias("kind")),
        edges.select("case_id", F.col("source_id").alias("node_id"), source_kind.alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def graph_edges(atoms: DataFrame, edges: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """``case_id, from_id, to_id, kind``: claim to obligations, and sources to the obligations they support or refute. Edges that are not
    among the accepted ones are left out (see ``rejected_edges``)."""
    kept = edges if accepted is None else edges.join(accepted, ["case_id", "atom_id", "relation", "source_id"], "left_semi")
    parts = [
        atoms.select("case_id", F.lit("claim").alias("from_id"), F.concat(F.lit("obligation:"), "atom_id").alias("to_id"), F.lit("DECOMPOSES_TO").alias("kind")),
        kept.select("case_id", F.col("source_id").alias("from_id"), F.concat(F.lit("obligation:"), "atom_id").alias("to_id"), F.col("relation").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def rejected_edges(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    return edges.join(accepted, ["case_id", "atom_id", "relation", "source_id"], "left_anti").withColumn("warning", F.lit("AGGREGATION_EDGE_MISMATCH"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per case: nodes and edges, and obligations that no argument reaches."""
    n = nodes.groupBy("case_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "VERIFICATION_OBLIGATION").alias("n_obligations"))
    argued = edges.where("kind IN ('SUPPORTS', 'REFUTES')")
    e = edges.groupBy("case_id").agg(F.count("*").alias("n_edges"))
    reached = argued.select("case_id", "to_id").distinct().groupBy("case_id").agg(F.count("*").alias("n_reached"))
    rows = n.join(e, "case_id", "left").join(reached, "case_id", "left").na.fill(0)
    return rows.select("case_id", "n_nodes", "n_edges", (F.col("n_obligations") - F.col("n_reached")).alias("n_unargued"))


def lanes(edges: DataFrame) -> DataFrame:
    """Per obligation and relation: how many direct and inferred paths lead to it."""
    return edges.groupBy("case_id", "atom_id", "relation").agg(F.count_if(F.col("kind") != "INFERENCE").alias("direct"), F.count_if(F.col("kind") == "INFERENCE").alias("inferred"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """For every point span (``p_start, p_end``) the shortest span (``s_start, s_end, span_id``) of its group around it.

    A range join on buckets: a span is listed in every bucket it covers, a point only in that of its start, so pairs are met once
    and only where they can match.
    """
    listed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s_start") / width), F.floor(F.col("s_end") / width))))
    asked = points.withColumn("_b", F.floor(F.col("p_start") / width))
    met = asked.join(listed, [*by, "_b"]).where("s_start <= p_start AND s_end >= p_end").drop("_b")
    best = Window.partitionBy(*by, "p_start", "p_end").orderBy(F.col("s_end") - F.col("s_start"), "s_start", "span_id")
    return met.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
