"""From rule candidates to executions: chosen premises are checked, completed, executed, ordered, and written down as typed programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of a mapping, and the order and result type of the operators.
MOST_MAPPINGS, MOST_PREMISES, MOST_OPERANDS = 3, 8, 10
ORDER = ("SET_MEMBERSHIP", "NUMERIC_COMPARE", "TEMPORAL_COMPARE", "ATTRIBUTE_COMPARE", "COUNT_DISTINCT", "EXTREMUM_COMPARE")
RESULT = {"SET_MEMBERSHIP": ("MEMBER", "BOOLEAN"), "NUMERIC_COMPARE": ("COMPARE", "NUMBER"), "TEMPORAL_COMPARE": ("COMPARE_DATE", "DATE"), "ATTRIBUTE_COMPARE": ("MATCH", "BOOLEAN"), "COUNT_DISTINCT": ("COUNT", "SET"), "EXTREMUM_COMPARE": ("EXTREMUM", "NUMBER")}
CANDIDATE = ["case_id", "atom_id", "candidate_id"]


def valid_mappings(mappings: DataFrame, candidates: DataFrame, permitted: DataFrame) -> DataFrame:
    """``case_id, atom_id, candidate_id, premise_ids``: answers that name known candidates and premises these may use; repeats are merged, and an atom keeps its
    first three candidates. ``mappings``: case_id, candidate_id, premise_id, ord; ``permitted``: case_id, candidate_id, premise_id."""
    known = mappings.join(candidates.select("case_id", "atom_id", "candidate_id").distinct(), ["case_id", "candidate_id"]).join(permitted, ["case_id", "candidate_id", "premise_id"], "left_semi")
    merged = known.groupBy(*CANDIDATE, "premise_id").agg(F.min("ord").alias("ord")).groupBy(*CANDIDATE).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "premise_id"))), lambda x: x["premise_id"]).alias("premise_ids"), F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("case_id", "atom_id").orderBy("ord", "candidate_id"))
    return merged.withColumn("place", place).where(F.col("place") <= MOST_MAPPINGS).select(*CANDIDATE, F.slice("premise_ids", 1, MOST_PREMISES).alias("premise_ids"))


def unmapped(candidates: DataFrame, mappings: DataFrame) -> DataFrame:
    """Candidates that no mapping chose, as executions without a result."""
    left = candidates.join(mappings, CANDIDATE, "left_anti")
    return left.select(*CANDIDATE, "operator", F.lit("UNRESOLVED").alias("status"), F.lit("NO_GROUNDED_PROGRAM").alias("warning"))


def recovered(executions: DataFrame) -> DataFrame:
    """What running unmapped attribute and count candidates anyway may keep: decided results."""
    return executions.where("operator IN ('ATTRIBUTE_COMPARE', 'COUNT_DISTINCT') AND status IN ('PROVED', 'DISPROVED')")


def completed(mappings: DataFrame, operands: DataFrame) -> DataFrame:
    """Mappings with further operands of their kind, ten at most together. ``operands``: case_id, candidate_id, premise_id, ord."""
    more = operands.groupBy("case_id", "candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "premise_id"))), lambda x: x["premise_id"]).alias("more"))
    rows = mappings.join(more, ["case_id", "candidate_id"], "left")
    return rows.withColumn("premise_ids", F.slice(F.array_distinct(F.concat("premise_ids", F.coalesce("more", F.array().cast("array<string>")))), 1, MOST_OPERANDS)).drop("more")


def demote_unaligned(executions: DataFrame, identities: DataFrame) -> DataFrame:
    """A proof whose names don't align is unresolved; membership compares items themselves and is exempt."""
    rows = executions.join(identities.select("case_id", "atom_id", F.col("status").alias("names")), ["case_id", "atom_id"], "left")
    hit = (F.col("names") == "UNRESOLVED") & (F.col("operator") != "SET_MEMBERSHIP") & F.col("status").isin("PROVED", "DISPROVED")
    return rows.withColumn("warning", F.when(hit, "MISSING_ENTITY_ALIGNMENT").otherwise(F.col("warning"))).withColumn("status", F.when(hit, "UNRESOLVED").otherwise(F.col("status"))).drop("names")


def preconditions(executions: DataFrame) -> DataFrame:
    """What each execution rested on, with whether it held."""
    decided = F.col("status").isin("PROVED", "DISPROVED")
    parts = [
        F.struct(F.lit("Source grounding").alias("name"), (F.size("premise_ids") > 0).alias("met")), F.struct(F.lit("Registered profile").alias("name"), F.col("operator").isin(*ORDER).alias("met")),
        F.struct(F.lit("Operand alignment").alias("name"), decided.alias("met")), F.struct(F.lit("Identity alignment").alias("name"), (F.coalesce("warning", F.lit("")) != "MISSING_ENTITY_ALIGNMENT").alias("met")),
    ]
    extra = F.when(F.col("operator") == "SET_MEMBERSHIP", F.struct(F.lit("Closed-set semantics").alias("name"), decided.alias("met"))).when(F.col("operator") == "COUNT_DISTINCT", F.struct(F.lit("Count semantics").alias("name"), decided.alias("met")))
    return executions.withColumn("preconditions", F.array_compact(F.array(*parts, extra)))


def with_program(executions: DataFrame) -> DataFrame:
    """A typed program: a lookup per premise, then the operator over them all."""
    steps = F.transform("premise_ids", lambda p, i: F.struct(F.concat(F.lit("s"), (i + 1).cast("string")).alias("id"), F.lit("LOOKUP").alias("operation"), F.array(p).alias("input_ids"), F.lit("FACT").alias("output_type")))
    ids = F.transform(steps, lambda s: s["id"])
    pick = lambda n: F.create_map(*[F.lit(x) for k, v in RESULT.items() for x in (k, v[n])])[F.col("operator")]
    final = F.struct(F.lit("result").alias("id"), pick(0).alias("operation"), ids.alias("input_ids"), pick(1).alias("output_type"))
    return executions.withColumn("program", F.struct(F.lit(1).alias("version"), F.concat(steps, F.array(final)).alias("steps"), F.lit("result").alias("output_step_id")))


def ordered(executions: DataFrame, atoms: DataFrame) -> DataFrame:
    """Executions by the order of atoms, operators, and ids. ``atoms``: case_id, atom_id, atom_ord."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("operator"))
    return executions.join(atoms.select("case_id", "atom_id", "atom_ord"), ["case_id", "atom_id"]).orderBy("case_id", "atom_ord", rank, "candidate_id")
