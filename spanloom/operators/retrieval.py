"""Ranked evidence: BM25, vector similarity, fused ranks, budgets per document, source diversity.

Everything is keyed by case, so one claim or millions run through the same joins: terms meet on (case, term), candidates
on case. Scores are rounded before they are ranked, so sums in any order give the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import LIST_PREFIX, LIST_QUERY, MAX_SENTENCE, SENTENCE, eligible, lexical_tokens, shared_tokens
from spanloom.session import materialize

# Fixed values of the scoring function and of fusion.
K1, B, LIST_BONUS, FUSION = 1.5, 0.75, 0.15, 60
DIGITS = 9
#: So many queries meet a document at once; a case with more of them has several such groups, and its documents meet each.
AT_ONCE = 64


def term_frequencies(passages: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    """``keys, term, tf``."""
    return passages.select(*keys, F.explode(lexical_tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def corpus_statistics(passages: DataFrame, case: str, keys: list[str], text: str = "sentence") -> DataFrame:
    """``case, n_passages, avg_len`` over all passages of a case, those without tokens included."""
    return passages.groupBy(case).agg(F.count("*").alias("n_passages"), F.avg(F.size(lexical_tokens(F.col(text)))).alias("avg_len"))


def passage_tokens(passages: DataFrame, case: str, passage_keys: list[str], text: str = "sentence") -> DataFrame:
    """Passages with their tokens, made once and kept, as several aggregates need them."""
    return materialize(passages.select(case, *passage_keys, F.col(text).rlike(LIST_PREFIX).alias("listed"), lexical_tokens(F.col(text)).alias("_tokens")).withColumn("n_tokens", F.size("_tokens")), "passage-tokens")


def bm25_matches(base: DataFrame, queries: DataFrame, case: str, passage_keys: list[str], query_key: str, query_text: str = "query") -> DataFrame:
    """``case, query_key, passage_keys, score`` of the passages (``passage_tokens``) that share a term with a query of their case. Every aggregate
    combines before it shuffles, so no case is too large for a task."""
    keys = [case, *passage_keys]
    stats = base.groupBy(case).agg(F.count("*").alias("n_passages"), F.avg("n_tokens").alias("avg_len"))
    asked = materialize(queries.select(case, query_key, F.col(query_text).rlike(LIST_QUERY).alias("asks_list"), F.explode(F.array_distinct(lexical_tokens(F.col(query_text)))).alias("term")), "query-terms")
    # passages meet the terms of their case as they are, and only terms that are asked for become rows
    met = base.select(*keys, "n_tokens", "listed", "_tokens").join(asked.groupBy(case).agg(F.collect_set("term").alias("_asked")), case)
    met = met.select(*keys, "n_tokens", "listed", "_tokens", F.explode(F.array_intersect("_tokens", "_asked")).alias("term"))
    tf = met.select(*keys, "n_tokens", "listed", "term", F.size(F.filter("_tokens", lambda t: t == F.col("term"))).alias("n")).groupBy(*keys, "n_tokens", "listed", "term").agg(F.sum("n").alias("tf"))
    df = tf.groupBy(case, "term").agg(F.count("*").alias("df"))
    tf = tf.join(df, [case, "term"]).join(stats, case)
    idf = F.log(1 + (F.col("n_passages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.when(F.col("avg_len") > 0, 1 - B + B * F.col("n_tokens") / F.col("avg_len")).otherwise(1 - B)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    sums = tf.join(asked, [case, "term"]).groupBy(query_key, *keys, "listed", "asks_list").agg(F.sum(part).alias("raw"))
    score = F.col("raw") + F.when((F.col("raw") > 0) & F.col("listed") & F.col("asks_list"), LIST_BONUS).otherwise(0.0)
    return sums.select(case, query_key, *passage_keys, F.round(score, DIGITS).alias("score"))


def bm25(base: DataFrame, queries: DataFrame, case: str, passage_keys: list[str], query_key: str, query_text: str = "query", extra: list[str] | None = None) -> DataFrame:
    """The same for every passage and query of a case, with 0 where no term meets, as ranks need it. ``extra``: the distinct tokens of the passage
    (``ts``) and of the query (``qs``)."""
    sides = {"ts": F.array_distinct("_tokens"), "qs": F.array_distinct(lexical_tokens(F.col(query_text)))}
    held = base.select(case, *passage_keys, *[sides[c].alias(c) for c in extra or () if c == "ts"])
    asked = queries.select(case, query_key, *[sides[c].alias(c) for c in extra or () if c == "qs"])
    found = bm25_matches(base, queries, case, passage_keys, query_key, query_text)
    rows = held.join(asked, case).join(found, [case, query_key, *passage_keys], "left")
    return rows.select(case, *passage_keys, query_key, F.coalesce("score", F.lit(0.0)).alias("score"), *(extra or []))


def sharing_sentences(documents: DataFrame, queries: DataFrame, case: str, document: str, query_keys: list[str], text: str = "text", query_text: str = "text") -> DataFrame:
    """``case, query_keys, document, ordinal, sentence``: every eligible sentence with every query of its case that it shares a token with, however many there are.

    Texts move once, to the queries of their case; there they are cut, and only sentences that share a token become rows."""
    terms = queries.groupBy(case, *query_keys).agg(F.array_distinct(F.flatten(F.collect_list(lexical_tokens(F.col(query_text))))).alias("terms"))  # a key's texts: one
    terms = materialize(terms, "query-terms")
    groups = terms.groupBy(case).agg(F.ceil(F.count("*") / AT_ONCE).alias("_groups"))
    asked = terms.join(groups, case).groupBy(case, F.pmod(F.xxhash64(*query_keys), "_groups").alias("_group")).agg(F.collect_list(F.struct(*query_keys, "terms")).alias("_asked"))
    asked = asked.select(case, "_asked", F.array_distinct(F.flatten(F.transform("_asked", lambda q: q["terms"]))).alias("_all"))
    shared = lambda s: F.when(F.length(s) <= MAX_SENTENCE, shared_tokens(s, F.col("_all")))
    cut = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s, i: F.struct(i.alias("ordinal"), s.alias("sentence"), shared(s).alias("own")))
    rows = documents.select(case, document, text).join(asked, case).select(case, document, "_asked", F.explode(F.filter(cut, lambda x: F.size(x["own"]) > 0)).alias("x"))
    met = rows.where(eligible(F.col("x.sentence"))).select(case, document, "x", F.explode(F.filter("_asked", lambda q: F.arrays_overlap(q["terms"], F.col("x.own")))).alias("q"))
    return met.select(case, *[F.col(f"q.{k}").alias(k) for k in query_keys], document, "x.ordinal", "x.sentence")


def cosine(a: Column, b: Column) -> Column:
    """The dot product of vectors that are normalised, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def competition_rank(by: list[str], score: str) -> Column:
    """Equal scores share a rank, and the next one leaves a gap."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))


def fused(dense_rank: Column, lexical_rank: Column, lexical_score: Column) -> Column:
    """Reciprocal ranks added; a passage no term of the query is in has no lexical share."""
    return F.round(1.0 / (FUSION + dense_rank) + F.when(lexical_score > 0, 1.0 / (FUSION + lexical_rank)).otherwise(0.0), 12)


def capped_top(scored: DataFrame, by: list[str], document: str, order: list[Column], budget: int, least: int = 1) -> DataFrame:
    """The best ``budget`` rows per group with at most so many of one document that all could have a share (``least`` at least).

    The cap only ever drops a document's own lower rows, so two window ranks give what a greedy walk would.
    """
    n_docs = scored.groupBy(*by).agg(F.count_distinct(document).alias("n_docs"))
    cap = F.when(F.col("n_docs") <= 1, budget).otherwise(F.greatest(F.lit(least), F.ceil(F.lit(budget) / F.col("n_docs"))))
    own = F.row_number().over(Window.partitionBy(*by, document).orderBy(*order))
    kept = scored.join(n_docs, by).withColumn("in_document", own).where(F.col("in_document") <= cap)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= budget).drop("n_docs", "in_document")


def diverse_top(selected: DataFrame, candidates: DataFrame, by: list[str], document: str, threshold: float = 0.9) -> DataFrame:
    """Soft source diversity: each document without a sentence, in order of its id, puts its best one in place of the last selected whose document
    has several, if the query's terms are in it and its fused score comes near the cut-off (that of the last selected before any swap).

    Groups hold a budget's worth of rows, so the swaps are a fold over small arrays. Rows need ``fused, lexical, position``.
    """
    chosen = selected.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("fused")).alias("f"), (-F.col("lexical")).alias("l"), F.col("position").alias("p"), F.col(document).alias("d")))).alias("chosen"))
    missing = candidates.join(selected.select(*by, document).distinct(), [*by, document], "left_anti")
    best = missing.withColumn("_r", F.row_number().over(Window.partitionBy(*by, document).orderBy(F.desc("fused"), F.desc("lexical"), "position"))).where("_r = 1 AND lexical > 0")
    offers = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(document).alias("d"), (-F.col("fused")).alias("f"), (-F.col("lexical")).alias("l"), F.col("position").alias("p")))).alias("offers"))
    rows = chosen.join(offers, by, "left").withColumn("cutoff", -F.element_at("chosen", -1)["f"])

    def swap(state: Column, offer: Column) -> Column:
        count = lambda d: F.size(F.filter(state, lambda x: x["d"] == d))
        spots = F.filter(F.transform(state, lambda x, i: F.when(count(x["d"]) > 1, i)), lambda i: i.isNotNull())
        at = F.when(F.size(spots) > 0, F.element_at(spots, -1))
        new = F.struct(offer["f"].alias("f"), offer["l"].alias("l"), offer["p"].alias("p"), offer["d"].alias("d"))
        take = at.isNotNull() & (-offer["f"] >= threshold * F.col("cutoff"))
        return F.when(take, F.transform(state, lambda x, i: F.when(i == at, new).otherwise(x))).otherwise(state)

    folded = rows.withColumn("final", F.when(F.col("offers").isNull(), F.col("chosen")).otherwise(F.aggregate("offers", F.col("chosen"), swap)))
    out = folded.select(*by, F.explode("final").alias("x")).select(*by, F.col("x.d").alias(document), F.col("x.p").alias("position"), (-F.col("x.f")).alias("fused"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fused"), "position")))
