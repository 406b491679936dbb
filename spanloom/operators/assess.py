"""Checks on evidence that was chosen for atoms: quantities, measures, counterexamples, sufficiency, omissions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["case_id", "atom_id"]

# Number words, scales, words that say nothing of a measured fact, words that deny outright, and how amounts are written.
WORDS = {w: float(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
SCALES = {"billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3, "%": 0.01, "percent": 0.01, "percentage": 0.01}
PLAIN_WORDS = frozenset("about added after already and approximately around back been before claim during from height more pandemic than that the their there these this through time were where with would".split())
REFUTING = r"(?i)\b(?:false|incorrect|inaccurate|myth|not true|isn[’']t\s+true|did not|didn[’']t|does not|doesn[’']t|never)\b"
AMOUNT = r"(?<![\w.])([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*(billion|million|thousand|bn|mn|m|k|%|percent(?:age)?)?(?=\s|[.,;:!?)]|$)"
_AMOUNT = re.compile(AMOUNT, re.I)
_SPELT = re.compile(r"(?<![\w-])(?:" + "|".join(WORDS) + r")(?![\w-])", re.I)
MEASURES = {"population": ("population", "populous", "residents", "people"), "above_sea_level": ("above sea level", "elevation", "sea level"), "base_to_summit": ("base to summit", "base-to-summit", "base to top", "base-to-top", "from its base", "ocean floor", "below sea level")}


def quantities(text: str) -> list[tuple[float, float]]:
    """``(value, scale)`` of a text's amounts, then of those in words; percentages are hundredths (scale 0.01), and those alone are compared by scale; bare whole numbers from 1000 to 2099 are
    taken for years."""
    out = []
    for m in _AMOUNT.finditer(text):
        value, scale = float(m.group(1).replace(",", "")), SCALES.get((m.group(2) or "").lower(), 1.0)
        if m.group(2) or not (value.is_integer() and 1000 <= value <= 2099):
            out.append((value * scale, scale))
    return out + [(WORDS[m.group().lower()], 1.0) for m in _SPELT.finditer(text)]


def quantity_matches(a: tuple[float, float], b: tuple[float, float]) -> bool:
    """Percentages must be equal; other amounts, too, or from a million on within five percent."""
    if abs(a[0] - b[0]) <= 1e-9:
        return True
    return 0.01 not in (a[1], b[1]) and abs(a[0]) >= 1e6 and abs(a[0] - b[0]) / abs(a[0]) <= 0.05


def measured_terms(text: str) -> set[str]:
    """Words of three letters and more that may name a measured fact, singular where they look plural."""
    words = (w for w in re.findall(r"[A-Za-z]{3,}", text.lower()) if w not in PLAIN_WORDS)
    return {w[:-1] if w.endswith("s") and len(w) > 4 else w for w in words}


def grounds(claim: str, evidence: str, supports: bool) -> bool:
    """Whether evidence grounds the amounts of a claim: it speaks of a word of it, and support has every amount, refutation any or a denial."""
    need = quantities(claim)
    if not need:
        return True
    if not measured_terms(claim) & measured_terms(evidence):
        return False
    have = quantities(evidence)
    if supports:
        return all(any(quantity_matches(x, y) for y in have) for x in need)
    return bool(have) or bool(re.search(REFUTING, evidence))


def _grounded(claim: pd.Series, evidence: pd.Series, relation: pd.Series) -> pd.Series:
    return pd.Series([r not in ("SUPPORTS", "REFUTES") or grounds(c or "", e or "", r == "SUPPORTS") for c, e, r in zip(claim, evidence, relation)], dtype=bool)


def numeric_grounding(atoms: DataFrame, relations: DataFrame) -> DataFrame:
    """``case_id, atom_id, span_id, relation, grounded``: support must meet every amount of the claim, refutation some, or deny in words; both must speak of a
    word of it. Claims without amounts ground anything. ``relations``: case_id, atom_id, span_id, span_text, relation."""
    rows = relations.join(atoms.select(*KEYS, F.col("text").alias("claim")), KEYS)
    return rows.select(*KEYS, "span_id", "relation", F.pandas_udf(_grounded, "boolean")("claim", "span_text", "relation").alias("grounded"))


def demote_ungrounded(assessments: DataFrame, grounding: DataFrame) -> DataFrame:
    """Relations without ground become context; where nothing decisive is left, SUFFICIENT becomes PARTIAL."""
    bad = grounding.where("NOT grounded").groupBy(*KEYS).agg(F.collect_set("span_id").alias("bad"))  # a few spans per atom
    rows = assessments.join(bad, KEYS, "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    support, refute = F.array_except("support_ids", "bad"), F.array_except("refute_ids", "bad")
    moved = F.array_intersect(F.array_union("support_ids", "refute_ids"), "bad")
    rows = rows.withColumn("s", support).withColumn("r", refute).withColumn("c", F.slice(F.array_union(moved, F.col("context_ids")), 1, 3))
    left = F.size("s") + F.size("r")
    sufficiency = F.when((F.col("sufficiency") == "SUFFICIENT") & (left == 0), "PARTIAL").when((F.size("s") > 0) & (F.size("r") > 0), "SUFFICIENT").otherwise(F.col("sufficiency"))
    return rows.select(*KEYS, F.col("s").alias("support_ids"), F.col("r").alias("refute_ids"), F.col("c").alias("context_ids"), sufficiency.alias("sufficiency"), "n_spans")


def measures(text: Column) -> Column:
    """Which measures a text speaks of."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in MEASURES.items()]))


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def incompatible_measures(claim: Column, evidence_measures: Column) -> Column:
    """A superlative can't be decided by evidence that measures height from the sea and from the base."""
    superlative = F.lower(claim).rlike(r"\b(?:largest|smallest|highest|lowest|tallest|shortest)\b")
    return superlative & F.array_contains(evidence_measures, "above_sea_level") & F.array_contains(evidence_measures, "base_to_summit")


def omission_errors(omissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """``case_id, reason`` of omission certificates that don't hold: detected without spans, not detected with spans, or citing support that is
    not sufficient. ``omissions``: case_id, detected, support_ids, context_ids."""
    sufficient = assessments.where("sufficiency = 'SUFFICIENT'").groupBy("case_id").agg(F.flatten(F.collect_list("support_ids")).alias("known"))
    rows = omissions.join(sufficient, "case_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    filled = (F.size("support_ids") > 0) & (F.size("context_ids") > 0)
    empty = (F.size("support_ids") == 0) & (F.size("context_ids") == 0)
    reason = F.when(F.col("detected") & ~filled, "INCOMPLETE_CERTIFICATE").when(~F.col("detected") & ~empty, "UNDETECTED_WITH_SPANS").when(F.size(F.array_except("support_ids", "known")) > 0, "UNSUPPORTED_CERTIFICATE")
    return rows.select("case_id", reason.alias("reason")).where("reason IS NOT NULL")
