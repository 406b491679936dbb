"""The checks that a model's choice of evidence goes through, as one plan over all atoms.

``answers`` has what was chosen per atom (case_id, atom_id, support_ids, refute_ids, context_ids, sufficiency, missing, reason), ``spans`` the evidence that was offered
(case_id, atom_id, span_id, span_ord, document_id, text, context). An atom is offered a budget of spans at most, so they meet it as an array, and every check is an expression over
arrays of ids; only amounts and names are read in Arrow batches. Steps come in the order of ``STEPS``, each taking and giving the same columns, so that a run can stop after
any of them.

Defined results: ids that were not offered, sufficiencies that don't exist and answers given twice are rejected with a reason (``rejects``) and not assessed; null lists are
empty; repeated ids count once; atoms without an answer are rejected as missing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import identity
from spanloom.operators.assess import grounds, incompatible_measures, measures, quantities, quantity_matches
from spanloom.operators.rules import exclusive_counterexample

KEYS = ["case_id", "atom_id"]
# Sufficiencies, the number of ids a side keeps, values that mean nothing was said, lengths and fixed sentences of explanations.
SUFFICIENCIES = ("SUFFICIENT", "PARTIAL", "INSUFFICIENT")
MOST_IDS = 3
SAYS_NOTHING = ("", "false", "null", "none", "n/a", "not applicable", "no")
MISSING_CHARS, REASON_CHARS = 220, 300
NO_REASON, NO_END = "No rationale was returned.", "Additional source information is needed."
_IDS = "array<string>"
SIDES = ("support", "refute")


def clean_sentence(text: Column, fallback: str, limit: int) -> Column:
    """The first whole sentence of a text in one line; a short text without an end gets one; values that mean nothing give the fallback, as do long texts without an end."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    whole = F.regexp_extract(line, r"^(.+?[.!?])(?:\s|$)", 1)
    return (
        F.when(F.lower(line).isin(*SAYS_NOTHING), fallback).when(whole != "", F.left(whole, F.lit(limit)))
        .when(F.length(line) <= limit, F.when(line.rlike(r"[.!?]$"), line).otherwise(F.concat(line, F.lit(".")))).otherwise(fallback or NO_END)
    )


def rejects(answers: DataFrame, atoms: DataFrame, spans: DataFrame) -> DataFrame:
    """``case_id, atom_id, reason`` of answers that can't be assessed: atoms without an answer, answers without an atom or given twice, unknown sufficiencies, ids that were not offered."""
    asked = atoms.select(*KEYS).distinct().withColumn("asked", F.lit(True))
    offered = spans.groupBy(*KEYS).agg(F.collect_set("span_id").alias("offered"))  # a budget of spans
    chosen = F.array_distinct(F.flatten(F.array(*[F.slice(F.array_distinct(_list(c)), 1, MOST_IDS) for c in ("support_ids", "refute_ids", "context_ids")])))
    given = answers.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("sufficiency", ignorenulls=True).alias("sufficiency"), F.array_distinct(F.flatten(F.collect_list(chosen))).alias("chosen"))
    rows = asked.join(given, KEYS, "full").join(offered, KEYS, "left")
    unknown = F.size(F.array_except("chosen", F.coalesce("offered", F.array().cast(_IDS)))) > 0
    reason = (
        F.when(F.col("n").isNull(), "MISSING_ANSWER").when(F.col("asked").isNull(), "UNKNOWN_ATOM").when(F.col("n") > 1, "REPEATED_ANSWER")
        .when(~F.coalesce(F.col("sufficiency").isin(*SUFFICIENCIES), F.lit(False)), "UNKNOWN_SUFFICIENCY").when(unknown, "UNAVAILABLE_EVIDENCE")
    )
    return rows.select(*KEYS, reason.alias("reason")).where("reason IS NOT NULL")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_IDS))


def prepared(answers: DataFrame, atoms: DataFrame, spans: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """One row per atom that can be assessed: its text, the spans it was offered by id, the sides as arrays of ids, and what they are of.
    ``scopes``: case_id, atom_id, span_id, claim_scope, evidence_scope, status; spans out of the claim's scope were not offered."""
    if scopes is not None:
        spans = spans.join(scopes.select(*KEYS, "span_id", "claim_scope", "evidence_scope", F.col("status").alias("scope_status")), [*KEYS, "span_id"], "left").where("scope_status IS NULL OR scope_status <> 'MISMATCH'")
    else:
        spans = spans.withColumn("claim_scope", F.array().cast(_IDS)).withColumn("evidence_scope", F.array().cast(_IDS))
    full = F.concat_ws(" ", "text", F.nullif("context", F.lit("")))
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    one = F.struct("span_ord", F.col("span_id").alias("id"), "document_id", F.col("text").alias("said"), norm.alias("norm"), full.alias("full"), F.coalesce("evidence_scope", F.array().cast(_IDS)).alias("scope"))
    offered = spans.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("spans"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("claim_scope", F.array().cast(_IDS))))).alias("claim_scope"))
    bad = rejects(answers, atoms, spans)
    rows = answers.join(bad, KEYS, "left_anti").join(atoms.select(*KEYS, F.col("text").alias("claim")), KEYS).join(offered, KEYS, "left")
    ids = lambda c: F.slice(F.array_distinct(_list(c)), 1, MOST_IDS)
    sufficiency = F.col("sufficiency")
    return rows.select(
        *KEYS, "claim", F.coalesce("spans", F.array().cast(offered.schema["spans"].dataType)).alias("spans"), F.coalesce("claim_scope", F.array().cast(_IDS)).alias("claim_scope"), ids("support_ids").alias("support"), ids("refute_ids").alias("refute"), ids("context_ids").alias("context"), "sufficiency",
        F.when(sufficiency == "SUFFICIENT", "").otherwise(clean_sentence(F.col("missing"), "", MISSING_CHARS)).alias("missing"), clean_sentence(F.col("reason"), NO_REASON, REASON_CHARS).alias("reason"),
    )


def _of(ids: Column, field: str) -> Column:
    """A field of the spans with these ids, in their order."""
    return F.flatten(F.transform(ids, lambda i: F.transform(F.filter(F.col("spans"), lambda s: s["id"] == i), lambda s: s[field])))


def _demoted(rows: DataFrame, moved: Column, first: bool = True) -> DataFrame:
    """Ids moved from the sides to the context, before or after what is there."""
    rows = rows.withColumn("moved", moved)
    joined = F.concat("moved", "context") if first else F.concat("context", "moved")
    rows = rows.withColumn("context", F.when(F.size("moved") > 0, F.slice(F.array_distinct(joined), 1, MOST_IDS)).otherwise(F.col("context")))
    for side in SIDES:
        rows = rows.withColumn(side, F.array_except(side, "moved"))
    return rows.drop("moved")


def both_sides(rows: DataFrame) -> DataFrame:
    """A span, or spans of one text, on both sides decide nothing."""
    same = F.array_intersect(_of(F.col("support"), "norm"), _of(F.col("refute"), "norm"))
    of_text = lambda side: F.filter(side, lambda i: F.arrays_overlap(F.transform(F.filter(F.col("spans"), lambda s: s["id"] == i), lambda s: s["norm"]), same))
    return _demoted(rows, F.array_sort(F.array_distinct(F.concat(F.array_intersect("support", "refute"), of_text("support"), of_text("refute")))), first=False)


def jurisdiction_cover(rows: DataFrame) -> DataFrame:
    """Where a claim puts one place before or after another, a side that doesn't speak of all its places decides nothing."""
    compared = F.col("claim").rlike(r"(?i)\b(?:before|after)\b") & (F.size("claim_scope") >= 2)
    lacks = lambda side: F.when(compared & (F.size(F.array_except("claim_scope", F.flatten(F.transform(side, lambda i: F.flatten(F.transform(F.filter(F.col("spans"), lambda s: s["id"] == i), lambda s: s["scope"])))))) > 0), F.col(side)).otherwise(F.array().cast(_IDS))
    return _demoted(rows, F.concat(lacks("support"), lacks("refute")), first=False)


def _numeric(claim: pd.Series, support: pd.Series, support_texts: pd.Series, refute: pd.Series, refute_texts: pd.Series) -> pd.DataFrame:
    """Per side the ids that ground the claim's amounts (or all, if none does alone), and whether they do together; whether support was rounded, and whether ids were left out."""
    out = []
    for c, s, st, r, rt in zip(claim, support, support_texts, refute, refute_texts):
        need, row, pruned, rounded = quantities(c), [], False, False
        for ids, texts, supports in ((list(s), list(st), True), (list(r), list(rt), False)):
            if need and len(ids) > 1:
                alone = [k for k, t in enumerate(texts) if grounds(c, t, supports)]
                if alone and len(alone) < len(ids):
                    ids, texts, pruned = [ids[k] for k in alone], [texts[k] for k in alone], True
            joined = " ".join(texts)
            row += [ids, not ids or grounds(c, joined, supports)]
            if supports and need and ids:
                have = quantities(joined)
                rounded = any(all(abs(x[0] - y[0]) > 1e-9 for y in have) and any(quantity_matches(x, y) for y in have) for x in need)
        out.append((*row, rounded, pruned))
    return pd.DataFrame(out, columns=["s", "s_ok", "r", "r_ok", "rounded", "pruned"])


def numeric_grounding(rows: DataFrame) -> DataFrame:
    """Ids beyond those that ground a claim's amounts alone are left out; a side that doesn't ground them becomes context, and sufficient evidence partial if nothing is left."""
    read = F.pandas_udf(_numeric, "struct<s:array<string>,s_ok:boolean,r:array<string>,r_ok:boolean,rounded:boolean,pruned:boolean>")
    # one row out of one row, before and after: neither what a batch takes nor what it gives is moved into other expressions
    rows = rows.select("*", F.explode(F.array(F.struct(F.col("claim").alias("c"), F.col("support").alias("s"), _of(F.col("support"), "full").alias("st"), F.col("refute").alias("r"), _of(F.col("refute"), "full").alias("rt")))).alias("t"))
    rows = rows.select("*", F.explode(F.array(read("t.c", "t.s", "t.st", "t.r", "t.rt"))).alias("n")).drop("t")
    rows = rows.withColumn("support", F.col("n.s")).withColumn("refute", F.col("n.r"))
    empty = F.array().cast(_IDS)
    rows = rows.withColumn("bad", F.concat(F.when(F.col("n.s_ok"), empty).otherwise(F.col("support")), F.when(F.col("n.r_ok"), empty).otherwise(F.col("refute"))))
    demoted = F.size("bad") > 0
    rows = _demoted(rows, F.col("bad"))
    none = demoted & (F.size("support") + F.size("refute") == 0)
    reason = (
        F.when(none, "The selected evidence does not ground the atom's numeric assertion.").when(demoted, F.col("reason"))
        .when((F.size("support") > 0) & F.col("n.rounded"), "The selected evidence reports a compatible rounded quantity for the same measured fact.")
        .when(F.col("n.pruned") & (F.size("support") > 0) & (F.size("refute") == 0), "The retained evidence directly supports the atomic claim's numeric assertion.")
        .when(F.col("n.pruned") & (F.size("refute") > 0) & (F.size("support") == 0), "The retained evidence directly refutes the atomic claim's numeric assertion.").otherwise(F.col("reason"))
    )
    missing = F.when(none, "Evidence stating the claimed quantity for the same measured fact is needed.").otherwise(F.col("missing"))
    sufficiency = F.when(none & (F.col("sufficiency") == "SUFFICIENT"), "PARTIAL").otherwise(F.col("sufficiency"))
    return rows.withColumn("reason", reason).withColumn("missing", missing).withColumn("sufficiency", sufficiency).drop("n", "bad")


def forced_counterexample(rows: DataFrame) -> DataFrame:
    """Any offered span that states a competing purpose of something said to be for civilians exclusively refutes, chosen or not."""
    found = F.transform(F.filter("spans", lambda s: exclusive_counterexample(F.col("claim"), s["said"])), lambda s: s["id"])
    rows = rows.withColumn("found", found)
    hit = F.size("found") > 0
    return (
        rows.withColumn("support", F.array_except("support", "found")).withColumn("refute", F.when(hit, F.slice("found", 1, 1)).otherwise(F.col("refute")))
        .withColumn("sufficiency", F.when(hit, "SUFFICIENT").otherwise(F.col("sufficiency"))).withColumn("missing", F.when(hit, "").otherwise(F.col("missing")))
        .withColumn("reason", F.when(hit, "The selected evidence states an explicit competing development purpose.").otherwise(F.col("reason"))).drop("found")
    )


def comparable_measures(rows: DataFrame) -> DataFrame:
    """A superlative is not decided by evidence that measures in two ways."""
    decisive = F.array_union("support", "refute")
    bad = (F.size(decisive) > 0) & incompatible_measures(F.col("claim"), measures(F.concat_ws("\n", F.array("claim"), _of(decisive, "said"))))
    rows = rows.withColumn("bad", bad).withColumn("of", F.when(bad, decisive).otherwise(F.array().cast(_IDS)))
    rows = _demoted(rows, F.col("of"))
    fixed = {"sufficiency": "PARTIAL", "missing": "Comparable measurements using one definition and a complete comparison set are needed.", "reason": "The selected evidence compares measurements that use incompatible definitions."}
    return rows.withColumns({c: F.when(F.col("bad"), x).otherwise(F.col(c)) for c, x in fixed.items()}).drop("bad", "of")


def conflict_is_sufficient(rows: DataFrame) -> DataFrame:
    """Evidence on both sides establishes a conflict."""
    both = (F.size("support") > 0) & (F.size("refute") > 0)
    fixed = {"sufficiency": "SUFFICIENT", "missing": "", "reason": "The selected evidence directly supports and refutes the same atomic claim."}
    return rows.withColumns({c: F.when(both, x).otherwise(F.col(c)) for c, x in fixed.items()})


def identities(rows: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """A side whose evidence names somebody else instead decides nothing. ``documents``: case_id, document_id, text, for the names they equate."""
    groups = identity.document_groups(documents, ["case_id", "document_id"]) if documents is not None else None
    claims = rows.select(*KEYS, F.col("claim").alias("text"))
    for side, relation in (("support", "SUPPORTS"), ("refute", "REFUTES")):
        chosen = rows.select(*KEYS, F.explode(F.filter("spans", lambda s: F.array_contains(F.col(side), s["id"]))).alias("s")).select(*KEYS, "s.document_id", F.col("s.full").alias("text"))  # noqa: B023
        found = identity.align(claims, identity.mentioned(chosen, [*KEYS, "document_id"]), groups, relation)
        rows = rows.join(found.select(*KEYS, F.col("status").alias(f"{side}_names")), KEYS, "left")
    lost = lambda side: F.when((F.size(side) > 0) & (F.col(f"{side}_names") == "UNRESOLVED"), F.col(side)).otherwise(F.array().cast(_IDS))
    rows = rows.withColumn("lost", F.concat(lost("support"), lost("refute")))
    demoted = F.size("lost") > 0
    rows = _demoted(rows, F.col("lost"))
    s, r = F.size("support") > 0, F.size("refute") > 0
    none = demoted & ~s & ~r
    reason = (
        F.when(none, "The selected evidence does not align every named identity in the atomic claim.").when(demoted & s & ~r, "Only the supporting relation retained a non-conflicting subject identity.")
        .when(demoted & r & ~s, "Only the refuting relation retained a non-conflicting subject identity.").otherwise(F.col("reason"))
    )
    return (
        rows.withColumn("sufficiency", F.when(none, "INSUFFICIENT").otherwise(F.col("sufficiency")))
        .withColumn("missing", F.when(none, "Evidence explicitly identifying the claimed entity is needed.").when(demoted & (s != r), "").otherwise(F.col("missing"))).withColumn("reason", reason).withColumn("demoted", F.col("lost")).drop("lost")
    )


#: Steps in order; ``identities`` also takes documents.
STEPS: tuple[Callable[[DataFrame], DataFrame], ...] = (both_sides, jurisdiction_cover, numeric_grounding, forced_counterexample, comparable_measures, conflict_is_sufficient, identities)


def assess(answers: DataFrame, atoms: DataFrame, spans: DataFrame, scopes: DataFrame | None = None, documents: DataFrame | None = None, upto: int = len(STEPS)) -> DataFrame:
    """``case_id, atom_id, support_ids, refute_ids, context_ids, sufficiency, missing, reason, n_spans, demoted_ids`` after all steps (or the first ``upto``)."""
    rows = prepared(answers, atoms, spans, scopes)
    for step in STEPS[:upto]:
        rows = step(rows, documents) if step is identities else step(rows)
    if "demoted" not in rows.columns:
        rows = rows.withColumn("demoted", F.array().cast(_IDS))
    rows = rows.withColumn("context", F.array_except("context", F.array_union("support", "refute")))
    return rows.select(*KEYS, F.col("support").alias("support_ids"), F.col("refute").alias("refute_ids"), F.col("context").alias("context_ids"), "sufficiency", "missing", "reason", F.size("spans").alias("n_spans"), F.col("demoted").alias("demoted_ids"))


def omissions(certificates: DataFrame, assessed: DataFrame) -> DataFrame:
    """``case_id, detected, support_ids, context_ids, rejected``: certificates of a material omission hold if they cite sufficient support; those that cite what names
    demoted are withdrawn, others are rejected. ``certificates``: case_id, detected, support_ids, context_ids."""
    known = assessed.groupBy("case_id").agg(F.flatten(F.collect_list(F.when(F.col("sufficiency") == "SUFFICIENT", F.col("support_ids")))).alias("known"), F.flatten(F.collect_list("demoted_ids")).alias("gone"))
    rows = certificates.join(known, "case_id", "left")
    empty = F.array().cast(_IDS)
    off = F.array_except(F.slice(F.array_distinct(_list("support_ids")), 1, MOST_IDS), F.coalesce("known", empty))
    withdrawn = F.col("detected") & (F.size(off) > 0) & (F.size(F.array_except(off, F.coalesce("gone", empty))) == 0)
    detected = F.col("detected") & ~withdrawn
    kept = lambda c: F.when(detected, F.slice(F.array_distinct(_list(c)), 1, MOST_IDS)).otherwise(empty)
    incomplete = (F.size(kept("support_ids")) == 0) | (F.size(kept("context_ids")) == 0)
    rejected = F.when(detected & (F.size(off) > 0), "UNSUPPORTED_CERTIFICATE").when(detected & incomplete, "INCOMPLETE_CERTIFICATE")
    return rows.select("case_id", detected.alias("detected"), kept("support_ids").alias("support_ids"), kept("context_ids").alias("context_ids"), rejected.alias("rejected"))
