"""From relations of evidence to a verdict, and the edges that show why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decisive(ids: Column, sufficiency: Column) -> Column:
    """Only sufficient evidence decides."""
    return F.when(sufficiency == "SUFFICIENT", ids).otherwise(F.array().cast("array<string>"))


def obligation_states(assessments: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """Per atom: its state from decisive evidence and proofs, with counts of unselected and provisional evidence.

    ``assessments``: case_id, atom_id, support_ids, refute_ids, context_ids, sufficiency, n_spans; ``proofs``: case_id, atom_id, relation.
    """
    rows = assessments
    if proofs is not None:
        folded = proofs.groupBy("case_id", "atom_id").agg(F.coalesce(F.bool_or(F.col("relation") == "SUPPORTS"), F.lit(False)).alias("proved"), F.coalesce(F.bool_or(F.col("relation") == "REFUTES"), F.lit(False)).alias("disproved"))
        rows = rows.join(folded, ["case_id", "atom_id"], "left").na.fill(False, ["proved", "disproved"])
    else:
        rows = rows.withColumn("proved", F.lit(False)).withColumn("disproved", F.lit(False))
    supported = (F.size(decisive(F.col("support_ids"), F.col("sufficiency"))) > 0) | F.col("proved")
    refuted = (F.size(decisive(F.col("refute_ids"), F.col("sufficiency"))) > 0) | F.col("disproved")
    both = F.array_union("support_ids", "refute_ids")
    return rows.select(
        "case_id", "atom_id",
        F.when(supported & refuted, "CONFLICTING").when(supported, "SUPPORTED").when(refuted, "REFUTED").otherwise("UNRESOLVED").alias("state"),
        F.greatest(F.lit(0), F.col("n_spans") - F.size(F.array_union(both, "context_ids"))).alias("n_unselected"),
        F.when(F.col("sufficiency") == "SUFFICIENT", 0).otherwise(F.size(both)).alias("n_provisional"),
    )


def verdicts(states: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: the atoms' states folded as its composition says. ``cases``: case_id, composition, omission_detected."""
    n = states.groupBy("case_id").agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("SUPPORTED", "REFUTED", "CONFLICTING")], F.count("*").alias("n_atoms"))
    rows = cases.join(n, "case_id")
    all_supported, all_refuted = F.col("supported") == F.col("n_atoms"), F.col("refuted") == F.col("n_atoms")
    folded = (
        F.when(F.col("composition") == "OR", F.when(F.col("supported") > 0, "SUPPORTED").when(F.col("conflicting") > 0, "CONFLICTING_EVIDENCE").when(all_refuted, "REFUTED").otherwise("NOT_ENOUGH_EVIDENCE"))
        .when(F.col("composition") == "AND", F.when(F.col("refuted") > 0, "REFUTED").when(F.col("conflicting") > 0, "CONFLICTING_EVIDENCE").when(all_supported, "SUPPORTED").otherwise("NOT_ENOUGH_EVIDENCE"))
        .otherwise(F.when(F.col("conflicting") > 0, "CONFLICTING_EVIDENCE").when(F.col("supported") > 0, "SUPPORTED").when(F.col("refuted") > 0, "REFUTED").otherwise("NOT_ENOUGH_EVIDENCE"))
    )
    return rows.select("case_id", "composition", F.when(F.coalesce("omission_detected", F.lit(False)), "CONFLICTING_EVIDENCE").otherwise(folded).alias("verdict"))


def argument_edges(assessments: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """``case_id, atom_id, relation, kind, source_id``: one edge per decisive span, one for a bundle of several, one per resolved proof."""
    edges = []
    for relation, col in (("SUPPORTS", "support_ids"), ("REFUTES", "refute_ids")):
        rows = assessments.where("sufficiency = 'SUFFICIENT'").where(F.size(col) > 0)
        source = F.when(F.size(col) > 1, F.concat(F.lit("bundle:"), F.array_join(F.array_sort(col), "+"))).otherwise(F.element_at(col, 1))
        edges.append(rows.select("case_id", "atom_id", F.lit(relation).alias("relation"), F.when(F.size(col) > 1, "BUNDLE").otherwise("EVIDENCE").alias("kind"), source.alias("source_id")))
    if proofs is not None:
        edges.append(proofs.where("relation IS NOT NULL").select("case_id", "atom_id", "relation", F.lit("INFERENCE").alias("kind"), F.col("proof_id").alias("source_id")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def postprocess(relations: DataFrame) -> DataFrame:
    """Relations after the checks that need no text: known spans only, three per relation, no span or text on both sides, context from what is left.

    ``relations``: case_id, atom_id, span_id, span_text, relation, ord, known. Spans on both sides become context, as do spans whose
    normalised text stands on both sides; every relation keeps its first three in order.
    """
    keys = ["case_id", "atom_id"]
    rows = relations.where("known").withColumn("norm", F.lower(F.trim(F.regexp_replace("span_text", r"\s+", " "))))
    rows = rows.groupBy(*keys, "span_id", "relation").agg(F.min("ord").alias("ord"), F.first("norm").alias("norm"))
    sides = lambda by: rows.where("relation IN ('SUPPORTS', 'REFUTES')").groupBy(*keys, by).agg(F.count_distinct("relation").alias("n")).where("n > 1").select(*keys, by)
    same_span, same_text = sides("span_id").withColumn("b1", F.lit(True)), sides("norm").withColumn("b2", F.lit(True))
    rows = rows.join(same_span, [*keys, "span_id"], "left").join(same_text, [*keys, "norm"], "left")
    rows = rows.withColumn("relation", F.when(F.col("b1") | F.col("b2"), "CONTEXT").otherwise(F.col("relation")))
    best = rows.groupBy(*keys, "span_id").agg(F.min_by("relation", F.struct(F.when(F.col("relation") == "CONTEXT", 1).otherwise(0), "ord")).alias("relation"), F.min("ord").alias("ord"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys, "relation").orderBy("ord", "span_id"))
    return best.withColumn("place", place).where("place <= 3").select(*keys, "span_id", "relation", "place")
