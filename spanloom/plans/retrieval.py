"""Queries on ranked evidence: the sentences of a case's documents for its atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import retrieval as R
from spanloom.operators.prepare import once
from spanloom.plans.text import LIKE_SQL, canonical_sql, token_sql
from spanloom.session import materialize
from spanloom.sources.tables import table

BUDGET = 6


def passages(spark: SparkSession, d: str) -> DataFrame:
    """``case_id, document_id, ordinal, sentence``: the candidates of every case."""
    documents = once(table(spark, d, "case_documents").select("case_id", "document_id", "text"), ["case_id", "document_id"])
    return T.sentences(documents, ["case_id", "document_id"]).where(T.eligible(F.col("sentence"))).select("case_id", "document_id", "ordinal", "sentence")


def atoms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atoms").select("case_id", "atom_id", F.col("text").alias("query"))


def lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    keys = ["document_id", "ordinal"]
    return R.bm25(R.passage_tokens(passages(spark, d), "case_id", keys), atoms(spark, d), "case_id", keys, "atom_id")


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """Passages, mean length and distinct terms per case."""
    rows = passages(spark, d)
    terms = R.term_frequencies(rows, ["case_id"]).groupBy("case_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return R.corpus_statistics(rows, "case_id", []).join(terms, "case_id").select("case_id", "n_passages", F.round("avg_len", 6).alias("avg_len"), "n_terms", "n_tokens")


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    found = R.bm25_matches(R.passage_tokens(passages(spark, d), "case_id", ["document_id", "ordinal"]), atoms(spark, d), "case_id", ["document_id", "ordinal"], "atom_id")
    return found.where("score > 0").select("case_id", "atom_id", "document_id", "ordinal", F.round("score", 6).alias("score"))


_BY = ["case_id", "atom_id"]


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best sentences of each atom, whatever their documents."""
    from pyspark.sql import Window

    order = Window.partitionBy(*_BY).orderBy(F.desc("score"), "document_id", "ordinal")
    return lexical_scores(spark, d).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BUDGET).select(*_BY, "rank", "document_id", "ordinal", F.round("score", 6).alias("score"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """``lexical_topk`` with the sentences. Documents meet the places of their chosen sentences, so that no other sentence is moved."""
    top = materialize(lexical_topk(spark, d), "evidence")
    places = top.groupBy("case_id", "document_id").agg(F.collect_set("ordinal").alias("places"))  # of a document's sentences
    documents = once(table(spark, d, "case_documents").select("case_id", "document_id", "text"), ["case_id", "document_id"]).join(places, ["case_id", "document_id"])
    chosen = documents.select("case_id", "document_id", "places", F.posexplode(F.regexp_extract_all("text", F.lit(T.SENTENCE), F.lit(0))).alias("ordinal", "sentence")).where(F.array_contains("places", F.col("ordinal")))
    return materialize(top.join(chosen.drop("places"), ["case_id", "document_id", "ordinal"]), "evidence-sentences")


def sharing(spark: SparkSession, d: str, queries: DataFrame, keys: list[str]) -> DataFrame:
    """All passages that share a word with a query (case_id, keys, text) of their case, with the sentences."""
    documents = once(table(spark, d, "case_documents").select("case_id", "document_id", "text"), ["case_id", "document_id"])
    return R.sharing_sentences(documents, queries, "case_id", "document_id", keys)


def lexical_topk_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same with a share of the budget for every document."""
    found = R.capped_top(lexical_scores(spark, d), _BY, "document_id", [F.desc("score"), F.asc("document_id"), F.asc("ordinal")], BUDGET)
    return found.select(*_BY, "rank", "document_id", "ordinal", F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Both scores of every pair, their ranks, and the fused score. The vector share is the cosine of sets of tokens, in place of a model's vectors."""
    keys = ["document_id", "ordinal"]
    base, asked = R.passage_tokens(passages(spark, d), "case_id", keys), atoms(spark, d)
    rows = R.bm25(base, asked, "case_id", keys, "atom_id", extra=["ts", "qs"])
    both = F.size(F.array_intersect("ts", "qs"))
    dense = F.when((F.size("ts") > 0) & (F.size("qs") > 0), both / F.sqrt(F.size("ts").cast("double") * F.size("qs"))).otherwise(0.0)
    rows = rows.select("case_id", "atom_id", *keys, F.round(dense, R.DIGITS).alias("dense"), F.col("score").alias("lexical"))
    rows = rows.withColumn("dense_rank", R.competition_rank(_BY, "dense")).withColumn("lexical_rank", R.competition_rank(_BY, "lexical"))
    return rows.withColumn("fused", R.fused(F.col("dense_rank"), F.col("lexical_rank"), F.col("lexical")))


def competition_rank(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select(*_BY, "document_id", "ordinal", "dense_rank", "lexical_rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select(*_BY, "document_id", "ordinal", F.round("fused", 9).alias("fused"))



def _order() -> list:
    return [F.desc("fused"), F.desc("lexical"), F.asc("document_id"), F.asc("ordinal")]


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    found = R.capped_top(_fused(spark, d), _BY, "document_id", _order(), BUDGET, least=3)
    return found.select(*_BY, "rank", "document_id", "ordinal", F.round("fused", 9).alias("fused"))


def hybrid_diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid selection after swaps for documents without a sentence."""
    from pyspark.sql import Window

    rows = _fused(spark, d).withColumn("position", F.row_number().over(Window.partitionBy(*_BY).orderBy("document_id", "ordinal")))
    found = R.diverse_top(R.capped_top(rows, _BY, "document_id", _order(), BUDGET, least=3), rows, _BY, "document_id")
    return found.select(*_BY, "rank", "document_id", "position", F.round("fused", 9).alias("fused"))


def document_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Evidence per document, and its best rank over the atoms of its case."""
    found = R.capped_top(lexical_scores(spark, d), _BY, "document_id", [F.desc("score"), F.asc("document_id"), F.asc("ordinal")], BUDGET)
    return found.groupBy("case_id", "document_id").agg(F.count("*").alias("n_evidence"), F.min("rank").alias("best_rank"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows to every row whose id is divisible by 20, by cosine."""
    from pyspark.sql import Window

    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("block"))
    held = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int"))
    dot = R.cosine(F.col("v"), F.col("q"))
    # within a block ten candidates of each query are kept, so what meets over blocks is bounded
    scored = held.join(asked, "block").where("vec_id <> query_id").select("block", "query_id", "vec_id", F.round(dot / (F.col("norm") * F.col("q_norm")), 6).alias("similarity"))
    first = scored.withColumn("r", F.row_number().over(Window.partitionBy("block", "query_id").orderBy(F.desc("similarity"), "vec_id"))).where("r <= 10")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where("rank <= 10").select("query_id", "rank", "vec_id", "similarity")


QUERIES = {f.__name__: f for f in (bm25_stats, bm25_scores, lexical_topk, lexical_topk_capped, competition_rank, rrf_fusion, hybrid_topk, hybrid_diverse_topk, document_coverage, dense_topk)}

_NUM = "regexp_full_match(w, '[0-9]+(?:[.,][0-9]+)*%?')"


def _tokens(expression: str) -> str:
    return f"list_transform(list_filter({token_sql(expression)}, lambda w: {_NUM} OR length(w) > 2), lambda w: CASE WHEN {_NUM} THEN {canonical_sql('w')} ELSE w END)"


_BASE = rf"""
    docs AS (SELECT DISTINCT case_id, document_id, text FROM case_documents),
    cut AS (SELECT case_id, document_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*\s*|[.!?\n]\s*')) AS sentence, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*\s*|[.!?\n]\s*'), 1) - 1 AS ordinal FROM docs),
    pass AS (SELECT *, {_tokens("sentence")} AS toks FROM cut WHERE length(sentence) <= 1000 AND ({LIKE_SQL})),
    q AS (SELECT case_id, atom_id, text AS query, list_distinct({_tokens("text")}) AS qs FROM atoms),
    tf AS (SELECT case_id, document_id, ordinal, term, count(*) AS tf FROM (SELECT case_id, document_id, ordinal, unnest(toks) AS term FROM pass) GROUP BY ALL),
    df AS (SELECT case_id, term, count(*) AS df FROM tf GROUP BY ALL),
    st AS (SELECT case_id, count(*) AS n_passages, avg(len(toks)) AS avg_len FROM pass GROUP BY 1),
    hits AS (SELECT t.case_id, q.atom_id, t.document_id, t.ordinal, sum(ln(1 + (st.n_passages - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.5 / (t.tf + 1.5 * CASE WHEN st.avg_len > 0 THEN 0.25 + 0.75 * len(p.toks) / st.avg_len ELSE 0.25 END)) AS raw
      FROM tf t JOIN (SELECT case_id, atom_id, unnest(qs) AS term FROM q) q ON q.case_id = t.case_id AND q.term = t.term JOIN df ON df.case_id = t.case_id AND df.term = t.term
      JOIN pass p ON p.case_id = t.case_id AND p.document_id = t.document_id AND p.ordinal = t.ordinal JOIN st ON st.case_id = t.case_id GROUP BY ALL),
    lex AS (SELECT p.case_id, q.atom_id, p.document_id, p.ordinal, p.toks, q.qs, round(coalesce(h.raw, 0.0) + CASE WHEN h.raw > 0 AND regexp_matches(p.sentence, '{T.LIST_PREFIX}') AND regexp_matches(q.query, '{T.LIST_QUERY.replace("'", "''")}') THEN 0.15 ELSE 0 END, 9) AS score
      FROM pass p JOIN q ON q.case_id = p.case_id LEFT JOIN hits h ON h.case_id = p.case_id AND h.atom_id = q.atom_id AND h.document_id = p.document_id AND h.ordinal = p.ordinal)"""
_TOP = """
    nd AS (SELECT case_id, atom_id, count(DISTINCT document_id) AS n_docs FROM lex GROUP BY ALL),
    own AS (SELECT l.*, n_docs, row_number() OVER (PARTITION BY l.case_id, l.atom_id, document_id ORDER BY score DESC, ordinal) AS r FROM lex l JOIN nd ON nd.case_id = l.case_id AND nd.atom_id = l.atom_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY case_id, atom_id ORDER BY score DESC, document_id, ordinal) AS rank FROM own WHERE r <= CASE WHEN n_docs <= 1 THEN 6 ELSE greatest(1, ceil(6.0 / n_docs)) END)"""
_FUSED = """
    den AS (SELECT *, CASE WHEN len(toks) > 0 AND len(qs) > 0 THEN round(len(list_intersect(list_distinct(toks), qs)) / sqrt(CAST(len(list_distinct(toks)) AS DOUBLE) * len(qs)), 9) ELSE 0 END AS dense FROM lex),
    rk AS (SELECT *, rank() OVER (PARTITION BY case_id, atom_id ORDER BY dense DESC) AS dense_rank, rank() OVER (PARTITION BY case_id, atom_id ORDER BY score DESC) AS lexical_rank FROM den),
    fu AS (SELECT *, round(1.0::DOUBLE / (60 + dense_rank) + CASE WHEN score > 0 THEN 1.0::DOUBLE / (60 + lexical_rank) ELSE 0 END, 12) AS fused FROM rk)"""

ORACLE_SQL = {
    "bm25_stats": f"WITH {_BASE} SELECT st.case_id, n_passages, round(avg_len, 6) AS avg_len, n_terms, n_tokens FROM st JOIN (SELECT case_id, count(DISTINCT term) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM tf GROUP BY 1) t ON t.case_id = st.case_id",
    "bm25_scores": f"WITH {_BASE} SELECT case_id, atom_id, document_id, CAST(ordinal AS INTEGER) AS ordinal, round(score, 6) AS score FROM lex WHERE score > 0",
    "lexical_topk": f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, atom_id ORDER BY score DESC, document_id, ordinal) AS rank FROM lex) SELECT case_id, atom_id, CAST(rank AS INTEGER) AS rank, document_id, CAST(ordinal AS INTEGER) AS ordinal, round(score, 6) AS score FROM r WHERE rank <= 6",
    "lexical_topk_capped": f"WITH {_BASE}, {_TOP} SELECT case_id, atom_id, CAST(rank AS INTEGER) AS rank, document_id, CAST(ordinal AS INTEGER) AS ordinal, round(score, 6) AS score FROM top WHERE rank <= 6",
    "document_coverage": f"WITH {_BASE}, {_TOP} SELECT case_id, document_id, count(*) AS n_evidence, CAST(min(rank) AS INTEGER) AS best_rank FROM top WHERE rank <= 6 GROUP BY ALL",
    "competition_rank": f"WITH {_BASE}, {_FUSED} SELECT case_id, atom_id, document_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank FROM rk",
    "rrf_fusion": f"WITH {_BASE}, {_FUSED} SELECT case_id, atom_id, document_id, CAST(ordinal AS INTEGER) AS ordinal, round(fused, 9) AS fused FROM fu",
    "hybrid_topk": f"""WITH {_BASE}, {_FUSED}, nd AS (SELECT case_id, atom_id, count(DISTINCT document_id) AS n_docs FROM fu GROUP BY ALL),
      own AS (SELECT f.*, n_docs, row_number() OVER (PARTITION BY f.case_id, f.atom_id, document_id ORDER BY fused DESC, score DESC, ordinal) AS r FROM fu f JOIN nd ON nd.case_id = f.case_id AND nd.atom_id = f.atom_id),
      top AS (SELECT *, row_number() OVER (PARTITION BY case_id, atom_id ORDER BY fused DESC, score DESC, document_id, ordinal) AS rank FROM own WHERE r <= CASE WHEN n_docs <= 1 THEN 6 ELSE greatest(3, ceil(6.0 / n_docs)) END)
      SELECT case_id, atom_id, CAST(rank AS INTEGER) AS rank, document_id, CAST(ordinal AS INTEGER) AS ordinal, round(fused, 9) AS fused FROM top WHERE rank <= 6""",
    "dense_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))), 6) AS similarity FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, similarity FROM r WHERE rank <= 10""",
}
