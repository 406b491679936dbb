"""Deterministic rules over claims and their premises.

Each takes ``atoms`` (case_id, atom_id, text) and ``premises`` (case_id, atom_id, premise_id, text) and gives, per atom, ``status`` (PROVED,
DISPROVED, UNRESOLVED, NOT_APPLICABLE) and ``warning``. Premises meet claims on (case, atom) only; per atom they are folded by aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import facts
from spanloom.functions.text import symbol_tokens
from spanloom.session import materialize

KEYS = ["case_id", "atom_id"]


def with_relation(results: DataFrame) -> DataFrame:
    """What a proof means for its atom."""
    return results.withColumn("relation", F.when(F.col("status") == "PROVED", "SUPPORTS").when(F.col("status") == "DISPROVED", "REFUTES"))


def holds(value: Column, op: Column, bound: Column) -> Column:
    return (
        F.when(op.isin(">=", "≥"), value >= bound).when(op.isin("<=", "≤"), value <= bound).when(op == ">", value > bound).when(op == "<", value < bound).otherwise(value == bound)
    )


def _terms(text: Column) -> Column:
    return symbol_tokens(F.regexp_replace(text, "[0-9]", " "))


def numeric_compare(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """A claim's last number as a threshold, against the numbers of its premises in the same unit, of the same years, about the claim's first name."""
    claims = atoms.select(*KEYS, F.col("text").alias("claim"), facts.comparator_in(F.col("text")).alias("op"), facts.numbers_in(F.col("text")).alias("ns"), facts.years_in(F.col("text")).alias("ys"), facts.anchor_tokens_in(F.col("text")).alias("names"))
    claims = claims.withColumn("bound", F.when(F.size("ns") > 0, F.element_at("ns", -1)))
    # premises without a number change nothing
    rows = premises.where(F.col("text").rlike(r"[0-9]|[^\x00-\x7f]")).select(*KEYS, "premise_id", F.col("text").alias("evidence"), facts.numbers_in(F.col("text")).alias("es"), facts.years_in(F.col("text")).alias("eys"))
    met = claims.join(rows, KEYS, "left").withColumn("e", F.explode_outer("es"))
    fits = (F.col("e.unit") == F.col("bound.unit")) & ((F.size("ys") == 0) | (F.col("ys") == F.col("eys"))) & ((F.size("names") == 0) | F.arrays_overlap("names", symbol_tokens(F.col("evidence"))))
    met = met.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("shared", F.coalesce(F.arrays_overlap(_terms(F.col("claim")), _terms(F.col("evidence"))), F.lit(False)))
    met = met.withColumn("outcome", F.when(F.col("fits") & F.col("shared"), holds(F.col("e.key"), F.col("op"), F.col("bound.key"))))
    out = met.groupBy(*KEYS).agg(
        F.first("op").alias("op"), F.first("bound").alias("bound"), F.count_if("fits").alias("n_fit"), F.count("outcome").alias("n"), F.bool_and("outcome").alias("every"), F.bool_or("outcome").alias("some")
    )
    unit = F.col("bound.unit")
    warning = (
        F.when(F.col("op").isNull() | F.col("bound").isNull(), "NOT_APPLICABLE").when(unit.startswith("unsupported:"), "UNSUPPORTED_NUMERIC_UNIT").when(F.col("n_fit") == 0, "MISSING_COMPATIBLE_UNIT")
        .when((F.col("n") == 0) | ((unit == "count") & (F.col("n") != 1)), "AMBIGUOUS_NUMERIC_MAPPING").when(F.col("every") != F.col("some"), "CONFLICTING_NUMERIC_EVIDENCE")
    )
    return _result(out.withColumn("w", warning), F.col("every"))


def _result(rows: DataFrame, truth: Column) -> DataFrame:
    """Status from a warning column ``w`` (or NOT_APPLICABLE) and the outcome where there is none."""
    status = F.when(F.col("w") == "NOT_APPLICABLE", "NOT_APPLICABLE").when(F.col("w").isNotNull(), "UNRESOLVED").when(truth, "PROVED").otherwise("DISPROVED")
    return rows.select(*KEYS, status.alias("status"), F.when(F.col("w") != "NOT_APPLICABLE", F.col("w")).alias("warning"))


# What tells that a claim is about a date, and words of time that are never resolved.
ON_DATE = rf"(?i)\b(?:on|in)\s+(?:{facts.MONTH}(?:\s+[0-9]{{1,2}},?)?\s+(?:19|20)[0-9]{{2}}|[0-9]{{1,2}}\s+{facts.MONTH}\s+(?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}})\b"
RELATIVE = r"(?i)\b(?:yesterday|today|tomorrow|last|next|ago|later|earlier)\b"
_NAME = r"\b[A-Z][A-Za-z'-]*(?:\s+[A-Z][A-Za-z'-]*)*"


def temporal_compare(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """Before, after, between and on: the premises' dates against the claim's last one (between: its last two), as intervals; of two events without
    dates, the one date that premises give each of them. What two intervals that overlap leave open stays unresolved.

    Claims are read once; the dates of an atom's premises, however many, are folded by aggregates."""
    low = F.lower("text")
    kind = F.when(low.rlike(r"\bbefore\b"), "before").when(low.rlike(r"\bafter\b"), "after").when(low.rlike(r"\bbetween\b"), "between").when(F.col("text").rlike(ON_DATE), "on")
    left, right = (F.regexp_extract(F.regexp_extract("text", r"(?is)^(.+?)\b(?:before|after)\b(.+?)[.!?]?$", i), _NAME, 0) for i in (1, 2))
    said = F.regexp_extract("text", r"(?is)^(.+?)\b(?:before|after)\b", 1)
    claims = atoms.select(
        *KEYS, kind.alias("kind"), facts.intervals_in(F.col("text")).alias("cs"), F.col("text").rlike(RELATIVE).alias("relative"), _terms(F.col("text")).alias("terms"),
        F.lower(left).alias("left"), F.lower(right).alias("right"), F.array_except(symbol_tokens(said), symbol_tokens(left)).alias("event"),
    )
    claims = claims.withColumn("last", F.when(F.size("cs") > 0, F.element_at("cs", -1))).withColumn("lower", F.when(F.size("cs") > 1, F.element_at("cs", -2)))
    rows = premises.where(F.col("text").contains("19") | F.col("text").contains("20")).select(*KEYS, F.lower(F.regexp_replace("text", r"\s+", " ")).alias("said"), symbol_tokens(F.col("text")).alias("ts"), F.explode(facts.intervals_in(F.col("text"))).alias("v"))
    met = claims.join(rows, KEYS, "left")
    names = lambda n: (F.col(n) != "") & F.concat(F.lit(" "), F.regexp_replace("said", r"[^\p{L}\p{N}']+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace(n, r"[^\p{L}\p{N}']+", " "), F.lit(" ")))
    about = (F.size("event") == 0) | F.arrays_overlap("event", "ts")
    dated = F.col("last").isNotNull()
    possible = F.col("v").isNotNull() & dated & ((F.col("kind") == "on") | (F.col("v.raw") != F.col("last.raw")))
    met = met.withColumn("possible", possible).withColumn("shared", F.when(F.col("possible"), F.size(F.array_intersect("terms", _terms(F.col("said"))))))
    met = met.withColumn("of_left", F.col("v").isNotNull() & names("left") & about).withColumn("of_right", F.col("v").isNotNull() & names("right") & about)
    same = lambda a, b: (a == b) & (F.col("last.first") == F.col("last.last")) & (a == F.col("last.first"))
    apart = lambda a, b: (b < F.col("last.first")) | (a > F.col("last.last"))
    days = (F.col("v.first").alias("a"), F.col("v.last").alias("b"))
    # of the dates that share most with the claim: whether one is the same, and whether one is not apart
    nearest = lambda holds, name: F.max(F.when(F.col("possible"), F.struct("shared", holds.alias("holds")))).alias(name)
    of = lambda n, fold: fold(F.when(F.col(n), F.struct(*days, F.col("v.raw").alias("raw"))))
    out = met.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in ("kind", "relative", "last", "lower")], F.count("v").alias("n"), F.count_if("possible").alias("n_possible"), F.min(F.when(F.col("possible"), F.struct(*days))).alias("one"),
        nearest(same(F.col("v.first"), F.col("v.last")), "equal"), nearest(~apart(F.col("v.first"), F.col("v.last")), "near"),
        of("of_left", F.min).alias("l"), of("of_left", F.max).alias("l_last"), of("of_right", F.min).alias("r"), of("of_right", F.max).alias("r_last"),
    )
    x, y, one = F.col("l"), F.col("r"), F.col("one")
    alone = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") == F.col("l_last")) & (F.col("r") == F.col("r_last"))
    ordered = F.when(alone, F.when(F.col("kind") == "before", F.when(x["b"] < y["a"], True).when(x["a"] >= y["b"], False)).when(x["a"] > y["b"], True).when(x["b"] <= y["a"], False))
    on = F.when(F.col("equal.shared") > 0, F.when(F.col("equal.holds"), True).when(~F.col("near.holds"), False))
    single = (
        F.when(F.col("kind") == "before", F.when(one["b"] < F.col("last.first"), True).when(one["a"] >= F.col("last.last"), False))
        .when(F.col("kind") == "after", F.when(one["a"] > F.col("last.last"), True).when(one["b"] <= F.col("last.first"), False))
        .when(F.col("kind") == "on", F.when(same(one["a"], one["b"]), True).when(apart(one["a"], one["b"]), False))
        .when((one["a"] >= F.col("lower.first")) & (one["b"] <= F.col("last.last")), True).when((one["b"] < F.col("lower.first")) | (one["a"] > F.col("last.last")), False)
    )
    decided = F.when(~dated, ordered).when((F.col("kind") == "on") & on.isNotNull(), on).when(F.col("n_possible") == 1, single)
    out = out.withColumn("truth", decided)
    warning = (
        F.when(F.col("kind").isNull(), "NOT_APPLICABLE").when(F.col("relative"), "RELATIVE_TIME").when(F.col("n") == 0, "MISSING_DATE_OPERAND").when(~dated & (F.col("kind") == "between"), "MISSING_DATE_BOUNDARY")
        .when(F.col("truth").isNotNull(), None).when(~dated | (F.col("n_possible") != 1), "AMBIGUOUS_TEMPORAL_MAPPING").when((F.col("kind") == "between") & F.col("lower").isNull(), "MISSING_DATE_BOUNDARY").otherwise("COARSE_DATE_OVERLAP")
    )
    return _result(out.withColumn("w", warning), F.col("truth"))


# The ways to say that something is on a list; of each the first that fits counts.
INCLUDED = r"(?i)^(.+?)\s+((?:has|have|had)\s+not|(?:has|have|had))\s+(?:officially\s+)?(?:included|listed|designated)\s+(.+?)\s+(?:in|on|among|as|by)\s+(.+?)[.!?]?$"
MEMBERSHIP = r"(?i)^(.+?)\s+(is\s+not|isn't|was\s+not|wasn't|has\s+not\s+been|has\s+been|is|was)\s+(?:an?\s+)?(?:officially\s+)?(?:included\s+in|included\s+on|on|in|among|listed\s+on|designated\s+(?:as|by))\s+(.+?)[.!?]?$"
MEMBER_OF = r"(?i)^(.+?)\s+(is\s+not|isn't|was\s+not|wasn't|is|was)\s+(?:an?\s+)?(?:permanent\s+)?member\s+of\s+(.+?)[.!?]?$"


def membership_claim(text: Column) -> tuple[Column, Column]:
    """Whom a claim says to be on a list, or not: the subject as normalised text (empty if it says nothing of the kind), and whether it denies it."""
    plain = F.regexp_replace(F.trim(text), "’", "'")
    subject = F.when(plain.rlike(INCLUDED), F.regexp_extract(plain, INCLUDED, 3)).when(plain.rlike(MEMBERSHIP), F.regexp_extract(plain, MEMBERSHIP, 1)).otherwise(F.regexp_extract(plain, MEMBER_OF, 1))
    verb = F.when(plain.rlike(INCLUDED), F.regexp_extract(plain, INCLUDED, 2)).when(plain.rlike(MEMBERSHIP), F.regexp_extract(plain, MEMBERSHIP, 2)).otherwise(F.regexp_extract(plain, MEMBER_OF, 2))
    return F.trim(F.regexp_replace(F.lower(subject), r"\s+", " ")), F.lower(verb).rlike("not|n't")


def set_membership(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """Whether the subject is on the list: an item that is it (or an alias of it) proves; only a complete list disproves, and only if no
    other complete list differs. A negation in the claim turns both around."""
    subject, negated = membership_claim(F.col("text"))
    claims = atoms.select(*KEYS, subject.alias("subject"), negated.alias("negated"))
    found = premises.select(*KEYS, F.explode(facts.lists_in(F.col("text"))).alias("l"))
    alias = premises.select(*KEYS, F.explode(facts.aliases_in(F.col("text"))).alias("x")).select(*KEYS, F.col("x.name").alias("subject"), F.col("x.alias").alias("other")).distinct()
    names = claims.select(*KEYS, "subject", F.col("subject").alias("other")).unionByName(claims.select(*KEYS, "subject").join(alias, [*KEYS, "subject"]).select(*KEYS, "subject", "other"))
    items = found.select(*KEYS, F.explode("l.items").alias("other"))
    present = items.join(names, [*KEYS, "other"]).select(*KEYS).distinct().withColumn("present", F.lit(True))
    lists = found.groupBy(*KEYS).agg(F.count_distinct("l.digest").alias("n_lists"))
    met = claims.join(present, KEYS, "left").join(lists, KEYS, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    warning = F.when(F.col("subject") == "", "NOT_APPLICABLE").when(F.col("present"), None).when(F.col("n_lists").isNull(), "INCOMPLETE_LIST_EVIDENCE").when(F.col("n_lists") > 1, "CONFLICTING_COMPLETE_LISTS")
    return _result(met.withColumn("w", warning), F.col("present") != F.col("negated"))


_COUNT = r"(?i)\b(?:won|wins|received|receives|earned|contains|contained|includes|included|offers|offered|supports|supported|uses|used)\b.*?\b(at\s+least\s+|no\s+fewer\s+than\s+|exactly\s+)?(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\s+(?:different\s+|distinct\s+)?([a-z][a-z -]*)"


def count_distinct(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """At least so many different values: proved by as many in the premises (``label: value`` or what follows the predicate), never disproved."""
    word = F.lower(F.regexp_extract("text", _COUNT, 2))
    n = F.coalesce(F.create_map(*[F.lit(x) for kv in facts.COUNT_WORDS.items() for x in kv])[word], F.when(word.rlike("^[0-9]+$"), F.coalesce(word.try_cast("bigint"), F.lit(2**63 - 1))))  # more than any number of premises
    claims = atoms.select(*KEYS, n.alias("need"), F.lower(F.regexp_extract("text", _COUNT, 1)).rlike("at|no").alias("open"), symbol_tokens(F.regexp_extract("text", r"^(.*?)\s+(?:won|wins|received|receives|earned|contains|contained|includes|included|offers|offered|supports|supported|uses|used)\b", 1)).alias("subject"))
    value = F.lower(F.trim(F.regexp_replace(F.regexp_extract("text", r"(?i)\b(?:won|received|earned|contains|contained|includes|included|offers|offered|supports|supported|uses|used)\s+(?:the\s+)?([^.,;]+)", 1), r"\s+", " ")))
    said = premises.select(*KEYS, value.alias("value"), symbol_tokens(F.col("text")).alias("ts")).where("value <> ''")
    counts = said.join(claims.select(*KEYS, "subject"), KEYS).where(F.size(F.array_except("subject", "ts")) == 0).groupBy(*KEYS).agg(F.count_distinct("value").alias("n"))
    met = claims.join(counts, KEYS, "left").na.fill(0, ["n"])
    warning = F.when(F.col("need").isNull(), "NOT_APPLICABLE").when(F.col("n") < F.col("need"), "MISSING_DISTINCT_VALUES").when(~F.col("open"), "INCOMPLETE_VALUE_SET")
    return _result(met.withColumn("w", warning), F.lit(True))


# Superlatives, what ends a subject, the measures that can't be compared, and how a record begins.
SUPERLATIVE = r"\b(largest|smallest|highest|lowest|tallest|shortest|most|least)\b"
BEFORE_COPULA = r"(?i)^(.+?)\s+(?:is|was|has|have|received|won|invented|developed|makes|make|uses|causes)\b"
ABOVE_SEA = ("above sea level", "elevation", "sea level")
FROM_BASE = ("base to summit", "base-to-summit", "base to top", "base-to-top", "from its base", "ocean floor", "below sea level")
RECORD = r"^\s*([A-Z][A-Za-z .'-]{1,80})"


def superlative(text: Column) -> Column:
    """The superlative of a text, null without one. No look-behind is needed: "at most" and "at least" are taken out first."""
    word = F.regexp_extract(F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", " ")), r"at (?:most|least)\b", ""), SUPERLATIVE, 1)
    return F.when(word != "", word)


def subject_of(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.trim(text), BEFORE_COPULA, 1)))


def _speaks_of(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def extremum(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """The largest or smallest: disproved by one record that is larger or smaller in the same unit; never proved, as records may be missing. Heights
    from the sea and from the base are not compared."""
    text = F.col("text")
    claims = atoms.select(*KEYS, superlative(text).alias("word"), symbol_tokens(subject_of(text)).alias("subject"), _speaks_of(text, ABOVE_SEA).alias("sea"), _speaks_of(text, FROM_BASE).alias("base"))
    bases = premises.groupBy(*KEYS).agg(F.bool_or(_speaks_of(text, ABOVE_SEA)).alias("p_sea"), F.bool_or(_speaks_of(text, FROM_BASE)).alias("p_base"))
    name = F.lower(F.trim(F.regexp_replace(F.regexp_extract("text", RECORD, 1), r"\s+", " ")))
    records = premises.select(*KEYS, "premise_id", name.alias("name"), facts.numbers_in(text).alias("ns")).where("name <> '' AND size(ns) > 0").select(*KEYS, "premise_id", "name", F.col("ns")[0].alias("v"))
    rows = records.join(claims.select(*KEYS, "word", "subject"), KEYS).withColumn("own", F.arrays_overlap("subject", symbol_tokens(F.col("name"))))
    mine = rows.where("own").groupBy(*KEYS).agg(F.min_by(F.struct("v", "name"), "premise_id").alias("mine"))
    met = rows.join(mine, KEYS).where((F.col("v.unit") == F.col("mine.v.unit")) & (F.col("name") != F.col("mine.name")))
    up = F.col("word").isin("largest", "highest", "tallest", "most")
    beaten = F.when(up, F.col("v.key") > F.col("mine.v.key")).otherwise(F.col("v.key") < F.col("mine.v.key"))
    out = claims.join(met.groupBy(*KEYS).agg(F.bool_or(beaten).alias("beaten")), KEYS, "left").join(mine.select(*KEYS, F.lit(True).alias("valued")), KEYS, "left").join(bases, KEYS, "left")
    both = (F.col("sea") | F.coalesce("p_sea", F.lit(False))) & (F.col("base") | F.coalesce("p_base", F.lit(False)))
    warning = F.when(F.col("word").isNull(), "NOT_APPLICABLE").when(both, "INCOMPATIBLE_MEASURES").when(F.col("valued").isNull(), "MISSING_SUBJECT_VALUE").when(F.coalesce("beaten", F.lit(False)), None).otherwise("INCOMPLETE_COMPARISON_UNIVERSE")
    return _result(out.withColumn("w", warning), F.lit(False))


# What denies, what parts clauses, what ends the words before a property, and words of purposes.
NEGATION = r"(?i)\b(?:no|not|never|without|did not|does not|will not|won['’]t|cannot|can['’]t|false|myth)\b"
CLAUSES = r"(?i)[.;]|\b(?:but|although|however|whereas|while)\b|\band\s+(?=(?:is|was|has|does|did|can|will)\b)"
BEFORE_PROPERTY = r"(?i)^.+?\b(?:is|was|has|have|for|in)\b"
MILITARY = r"(?is)\b(?:developed|development|designed|conceived)\b.{0,160}?\bmilitary\b|\bmilitary\b.{0,160}?\b(?:developed|development|designed|conceived)\b"


def attribute_profile(text: Column) -> Column:
    """Which kind of attribute a claim states, null for none."""
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.when(low.rlike(r"\b(?:located|location)\b"), "COUNTRY_LOCATION").when(low.contains("exclusively"), "EXCLUSIVE_PURPOSE").when(low.rlike(r"\b(?:is|are|has|have|invented|created|developed|makes|make|causes|uses)\b|\bawarded\s+for\b"), "EXPLICIT_NEGATION")


def exclusive_counterexample(claim: Column, evidence: Column) -> Column:
    """Whether evidence speaks of a military purpose where a claim says that something was for civilians exclusively."""
    low = F.lower(claim)
    return low.contains("exclusively") & low.rlike(r"\bcivil(?:ian)?\b") & evidence.rlike(MILITARY)


def attribute(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """Where something lies, or what it is said not to be: a country in both proves a location and two others disprove it; a clause that denies the
    property of the subject disproves it. Premises together must name some word of the subject."""
    text = F.col("text")
    claims = atoms.select(*KEYS, text.alias("claim"), attribute_profile(text).alias("profile"), symbol_tokens(subject_of(text)).alias("subject"), symbol_tokens(F.regexp_replace(text, BEFORE_PROPERTY, "")).alias("property"), facts.jurisdictions_in(text).alias("cc"))
    met = claims.join(premises.select(*KEYS, "text"), KEYS)
    met = met.withColumn("ec", facts.jurisdictions_in(F.when(F.col("profile") == "COUNTRY_LOCATION", text)))  # no other profile reads places
    denies = F.exists(F.split("text", CLAUSES), lambda c: c.rlike(NEGATION) & F.arrays_overlap(F.col("subject"), symbol_tokens(c)) & F.arrays_overlap(F.col("property"), symbol_tokens(c)))
    folded = met.groupBy(*KEYS).agg(
        F.bool_or(F.arrays_overlap("subject", symbol_tokens(F.col("text")))).alias("about"), F.bool_or(denies).alias("denied"), F.bool_or(F.size("ec") > 0).alias("placed"), F.bool_or(F.arrays_overlap("cc", "ec")).alias("same_place"), F.bool_or(exclusive_counterexample(F.col("claim"), F.col("text"))).alias("military")
    )
    out = claims.join(folded, KEYS, "left")
    located = (F.col("profile") == "COUNTRY_LOCATION") & (F.size("cc") > 0) & F.coalesce("placed", F.lit(False))
    denied = (F.col("profile") == "EXPLICIT_NEGATION") & F.coalesce("denied", F.lit(False))
    exclusive = (F.col("profile") == "EXCLUSIVE_PURPOSE") & F.coalesce("military", F.lit(False))
    no = denied | (located & ~F.coalesce("same_place", F.lit(False))) | exclusive
    warning = F.when((F.size("subject") > 0) & ~F.coalesce("about", F.lit(False)), "MISSING_ENTITY_ALIGNMENT").when(F.col("profile").isNull(), "NOT_APPLICABLE").when(no | located, None).otherwise("AMBIGUOUS_ATTRIBUTE_MAPPING")
    return _result(out.withColumn("w", warning), ~no)


#: So much of a source's beginning tells where it is about, where neither domain nor title does.
SCOPE_CHARS = 2000


def scope_checks(atoms: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether evidence speaks of the claim's jurisdictions. ``spans``: case_id, atom_id, span_id, text, title, host and, where it is known, document (the source's text). Evidence's own places count, else its source's:
    by domain, title, then the text's beginning; more than four are none."""
    is_value = F.lower("text").rlike(r"\b(?:located|situated|based|born) in\b|\bmember of\b|\bcapital of\b")
    claims = atoms.select(*KEYS, is_value.alias("is_value"), facts.jurisdictions_in(F.col("text")).alias("claim_scope"))
    few = lambda c: F.when((F.size(c) >= 1) & (F.size(c) <= 4), c)
    local = few(facts.jurisdictions_in(F.col("text")))
    domain = facts.domain_scope(F.col("host"))
    opening = F.left("document", F.lit(SCOPE_CHARS)) if "document" in spans.columns else F.lit("")
    some = lambda c: F.when(F.size(c) > 0, c)
    source = few(F.coalesce(F.when(domain.isNotNull(), F.array(domain)), some(facts.jurisdictions_in(F.coalesce("title", F.lit("")))), some(facts.jurisdictions_in(F.coalesce(opening, F.lit(""))))))
    rows = spans.select(*KEYS, "span_id", F.coalesce(local, source, F.array().cast("array<string>")).alias("evidence_scope"))
    status = (
        F.when(F.col("is_value") | (F.size("claim_scope") == 0), "NOT_APPLICABLE").when(F.size("evidence_scope") == 0, "UNRESOLVED").when(F.arrays_overlap("claim_scope", "evidence_scope"), "MATCH").otherwise("MISMATCH")
    )
    return rows.join(claims, KEYS).select(*KEYS, "span_id", "claim_scope", "evidence_scope", status.alias("status"))


REGISTRY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "SET_MEMBERSHIP": set_membership, "NUMERIC_COMPARE": numeric_compare, "TEMPORAL_COMPARE": temporal_compare, "ATTRIBUTE_COMPARE": attribute, "COUNT_DISTINCT": count_distinct, "EXTREMUM_COMPARE": extremum,
}


def run_rules(candidates: DataFrame, premises: DataFrame) -> DataFrame:
    """All candidates (case_id, atom_id, operator, text) by their operators: ``operator, status, warning, relation``; resolved ones first. Premises with an ``operator`` are
    for that one only, others for all of their atom.

    Each rule runs by itself over the premises of its own atoms, and its results are kept: one plan of all rules, with what they come from in it
    many times, outgrows the driver."""
    asked = materialize(candidates.select(*KEYS, "operator", "text"), "rule-atoms")
    used = premises if "operator" in premises.columns else premises.select(*KEYS, "premise_id", "text").join(asked.select(*KEYS, "operator").distinct(), KEYS)
    used = materialize(used, "rule-premises")
    parts = []
    for name, rule in REGISTRY.items():
        own = F.col("operator") == name
        parts.append(materialize(rule(asked.where(own).drop("operator"), used.where(own).drop("operator")), "rule-results").withColumn("operator", F.lit(name)))
    return with_relation(reduce(DataFrame.unionByName, parts))


def candidates(atoms: DataFrame) -> DataFrame:
    """Which rules an atom qualifies for, by its words."""
    low = F.lower("text")
    extreme = superlative(F.col("text")).isNotNull()
    profile = attribute_profile(F.col("text"))
    fits = {
        "SET_MEMBERSHIP": low.rlike(r"\b(?:list|listed|member|included|designated)\b"), "COUNT_DISTINCT": F.regexp_extract("text", _COUNT, 2) != "", "EXTREMUM_COMPARE": extreme,
        "ATTRIBUTE_COMPARE": profile.isNotNull() & ((profile != "EXPLICIT_NEGATION") | low.rlike(r"\b(?:has|have|invented|created|developed|makes|make|causes|uses)\b|\bawarded\s+for\b")),
        "NUMERIC_COMPARE": low.rlike("[0-9]") & low.rlike(r"[<>≤≥=]|\b(?:more|less|fewer|over|under|at least|at most|equal|than|percent)\b|[a-z0-9_]%[a-z0-9_]"),
        "TEMPORAL_COMPARE": ~extreme & low.rlike(r"\b(?:before|after|between|during|on|since|until)\b"),
    }
    return atoms.select(*KEYS, "text", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fits.items()]))).alias("operator"))
