"""Rules over the premises that their candidates may use, from evidence to typed programs.

``execute`` runs each candidate (``premises.build_candidates``) by its operator on its own premises only; lists come as certificates and items. What is decided is checked against the
names of claim and premises, unmapped candidates stay visible, and every execution is written down as a program. All joins are on case, atom and premise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import facts
from spanloom.operators import identity, programs, rules
from spanloom.session import materialize

KEYS = ["case_id", "atom_id"]


def listed_membership(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """Membership over list premises (case_id, atom_id, premise_id, kind, text, digest): an item that is the subject, or an alias of it that a premise states, proves;
    certificates of one list disprove, of several conflict. A negation in the claim turns both around."""
    subject, negated = rules.membership_claim(F.col("text"))
    claims = atoms.select(*KEYS, subject.alias("subject"), negated.alias("negated"))
    alias = premises.select(*KEYS, F.explode(facts.aliases_in(F.col("text"))).alias("x")).select(*KEYS, F.col("x.name").alias("subject"), F.col("x.alias").alias("other")).distinct()
    names = claims.select(*KEYS, F.col("subject").alias("other")).unionByName(claims.select(*KEYS, "subject").join(alias, [*KEYS, "subject"]).select(*KEYS, "other"))
    items = premises.where("kind = 'LIST_ITEM'").select(*KEYS, F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("other"))
    present = items.join(names, [*KEYS, "other"]).select(*KEYS).distinct().withColumn("present", F.lit(True))
    lists = premises.where("kind = 'LIST_CERTIFICATE'").groupBy(*KEYS).agg(F.count_distinct("digest").alias("n_lists"))
    met = claims.join(present, KEYS, "left").join(lists, KEYS, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    warning = F.when(F.col("subject") == "", "NOT_APPLICABLE").when(F.col("present"), None).when(F.col("n_lists").isNull(), "INCOMPLETE_LIST_EVIDENCE").when(F.col("n_lists") > 1, "CONFLICTING_COMPLETE_LISTS")
    return rules._result(met.withColumn("w", warning), F.col("present") != F.col("negated"))


def execute(atoms: DataFrame, candidates: DataFrame, premises: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """``case_id, atom_id, candidate_id, operator, profile, premise_ids, status, warning, relation``. ``mappings``: case_id, atom_id, candidate_id, premise_ids that a model chose; without, all
    permitted premises are used. Candidates that no mapping chose are unresolved, but decided attribute and count candidates are recovered."""
    cut = F.slice("premise_ids", 1, programs.MOST_OPERANDS)
    every = candidates.select(*programs.CANDIDATE, "operator", "profile", cut.alias("premise_ids"))
    if mappings is None:
        chosen, left = every, None
    else:
        chosen = every.drop("premise_ids").join(mappings.select(*programs.CANDIDATE, "premise_ids"), programs.CANDIDATE)
        left = every.join(mappings, programs.CANDIDATE, "left_anti")
        chosen = chosen.unionByName(left.where("operator IN ('ATTRIBUTE_COMPARE', 'COUNT_DISTINCT')"))
    chosen = materialize(chosen, "chosen-candidates")
    asked = chosen.select(*KEYS, "operator", F.explode("premise_ids").alias("premise_id"))
    # of all premises only those that a candidate uses are kept, once; each rule runs by itself, as one plan of all rules repeats what it comes from
    known = premises.select("case_id", "premise_id", "document_id", "kind", "text", "digest").join(asked.select("case_id", "premise_id").distinct(), ["case_id", "premise_id"], "left_semi")
    known = materialize(known.dropDuplicates(["case_id", "premise_id"]), "used-premises")
    parts = []
    for name, rule in rules.REGISTRY.items():
        own = chosen.where(F.col("operator") == name).select(*KEYS).join(atoms.select(*KEYS, "text"), KEYS)
        used = asked.where(F.col("operator") == name).drop("operator").join(known, ["case_id", "premise_id"])
        run = listed_membership if name == "SET_MEMBERSHIP" else rule
        parts.append(materialize(run(own, used), "rule-results").withColumn("operator", F.lit(name)))
    found = rules.with_relation(reduce(DataFrame.unionByName, parts))
    out = materialize(chosen.join(found, [*KEYS, "operator"]), "executions")
    if left is not None:
        kept = out.join(mappings.select(*programs.CANDIDATE), programs.CANDIDATE, "left_semi").unionByName(programs.recovered(out.join(mappings.select(*programs.CANDIDATE), programs.CANDIDATE, "left_anti")))
        rest = programs.unmapped(candidates, mappings).join(kept.select(*programs.CANDIDATE), programs.CANDIDATE, "left_anti")
        empty = rest.join(every.select(*programs.CANDIDATE, "profile"), programs.CANDIDATE).select(*programs.CANDIDATE, "operator", "profile", F.array().cast("array<string>").alias("premise_ids"), "status", "warning", F.lit(None).cast("string").alias("relation"))
        out = kept.select(*empty.columns).unionByName(empty)
    return aligned(out, atoms, known)


def aligned(executions: DataFrame, atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """Proofs whose premises name somebody else instead of whom the claim names are unresolved; membership compares items themselves and is exempt."""
    read = executions.where("status IN ('PROVED', 'DISPROVED') AND operator <> 'SET_MEMBERSHIP'").select(*KEYS, F.explode("premise_ids").alias("premise_id")).distinct()
    texts = read.join(premises.select("case_id", "premise_id", "document_id", "text"), ["case_id", "premise_id"])
    names = identity.align(atoms.select(*KEYS, "text"), identity.mentioned(texts, [*KEYS, "document_id"]))
    out = programs.demote_unaligned(executions, names)
    return out.withColumn("relation", F.when(F.col("status").isin("PROVED", "DISPROVED"), F.col("relation")))


def programs_of(executions: DataFrame) -> DataFrame:
    """Executions with their preconditions and typed programs."""
    return programs.with_program(programs.preconditions(executions))
