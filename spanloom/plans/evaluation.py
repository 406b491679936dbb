"""Queries on verdicts, graphs, selections and reports.

Relations of documents to atoms are rendered from the tables by a rule that SQL knows, too: the last character of a document's id and the
atom's number choose the relation, the atom's length its sufficiency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import symbol_tokens
from spanloom.operators import graph as G
from spanloom.operators import prepare as P
from spanloom.operators import reports as R
from spanloom.operators import verdict as V
from spanloom.sources.tables import table
from spanloom.streaming import rate_limit


def _relations(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "case_documents").groupBy("case_id", "document_id").agg(F.min("doc_ord").alias("ord"))
    pairs = spans.join(table(spark, d, "atoms").select("case_id", "atom_id", "text"), "case_id")
    code = (F.ascii(F.right("document_id", F.lit(1))) + F.right("atom_id", F.lit(1)).cast("int")) % 4
    relation = F.when(code == 0, "SUPPORTS").when(code == 1, "REFUTES").when(code == 2, "CONTEXT")
    n = F.length("text") % 3
    return pairs.select("case_id", "atom_id", F.col("document_id").alias("span_id"), "ord", relation.alias("relation"), F.when(n == 0, "SUFFICIENT").when(n == 1, "PARTIAL").otherwise("INSUFFICIENT").alias("sufficiency"))


def assessments(spark: SparkSession, d: str) -> DataFrame:
    rows = _relations(spark, d)
    # the spans of one atom: a case's few documents
    ids = lambda r: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct("ord", "span_id")))), 1, 3), lambda x: x["span_id"])
    return rows.groupBy("case_id", "atom_id", "sufficiency").agg(ids("SUPPORTS").alias("support_ids"), ids("REFUTES").alias("refute_ids"), ids("CONTEXT").alias("context_ids"), F.count("*").alias("n_spans"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "catalog").groupBy("case_id").agg(F.min("claim").alias("claim"), F.min("label").alias("label"))
    n = table(spark, d, "atoms").groupBy("case_id").agg(F.count("*").alias("n"))
    composition = F.when(F.col("n") == 1, "SINGLE").when(F.length("claim") % 2 == 0, "AND").otherwise("OR")
    return cases.join(n, "case_id").select("case_id", "label", composition.alias("composition"), (F.length("claim") % 11 == 0).alias("omission_detected"))


def obligation_state(spark: SparkSession, d: str) -> DataFrame:
    return V.obligation_states(assessments(spark, d))


def verdict_fold(spark: SparkSession, d: str) -> DataFrame:
    return V.verdicts(V.obligation_states(assessments(spark, d)), _cases(spark, d))


def argument_edges(spark: SparkSession, d: str) -> DataFrame:
    return V.argument_edges(assessments(spark, d))


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Relations per atom, unselected ones included."""
    rows = _relations(spark, d).withColumn("relation", F.coalesce("relation", F.lit("NOT_SELECTED")))
    return rows.groupBy("case_id", "atom_id").pivot("relation", ["SUPPORTS", "REFUTES", "CONTEXT", "NOT_SELECTED"]).count().na.fill(0).toDF("case_id", "atom_id", "n_supports", "n_refutes", "n_context", "n_not_selected")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = verdict_fold(spark, d).join(_cases(spark, d).select("case_id", "label"), "case_id")
    return R.confusion(rows.withColumnRenamed("verdict", "predicted").withColumnRenamed("label", "reference"), "reference", "predicted")


def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that agree with their label, per composition."""
    rows = verdict_fold(spark, d).join(_cases(spark, d).select("case_id", "label"), "case_id").where("label IS NOT NULL")
    return rows.groupBy("composition").agg(F.count("*").alias("n_cases"), F.round(R.agreement(F.col("verdict") == F.col("label")), 6).alias("rate"))


def error_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = verdict_fold(spark, d).join(_cases(spark, d).select("case_id", "label"), "case_id")
    return rows.where("label <> verdict").groupBy("label", "verdict").agg(F.count("*").alias("n"))


def relation_share(spark: SparkSession, d: str) -> DataFrame:
    found = R.shares(_relations(spark, d).withColumn("relation", F.coalesce("relation", F.lit("NOT_SELECTED"))), "relation")
    return found.select("relation", "n", F.round("share", 6).alias("share"))


def stage_latency(spark: SparkSession, d: str) -> DataFrame:
    found = R.latency(table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), "largest", "n")


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the showcase's cases against those of the others."""
    rows = table(spark, d, "atoms").groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("role").isNull()).alias("f"))
    stats = lambda x: x.agg(F.avg("n").alias("mean_atoms"), F.sum("f").alias("fallbacks"), F.count_if(F.col("n") > 3).alias("high_severity"), F.avg((F.col("f") > 0).cast("int")).alias("repair_rate"))
    shown = F.col("case_id").startswith("showcase")
    return R.regression_gate(stats(rows.where(shown)), stats(rows.where(~shown)))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_nodes(_cases(spark, d), table(spark, d, "atoms"), V.argument_edges(assessments(spark, d)))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_edges(table(spark, d, "atoms"), V.argument_edges(assessments(spark, d)))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(graph_nodes(spark, d), graph_edges(spark, d))


def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    """Atoms' source texts in the smallest atom span around them, own one excluded."""
    rows = table(spark, d, "atoms")
    points = rows.select("case_id", (F.col("start_off") + 2).alias("p_start"), (F.col("end_off") - 2).alias("p_end")).distinct()
    spans = rows.select("case_id", F.col("start_off").alias("s_start"), F.col("end_off").alias("s_end"), F.col("atom_id").alias("span_id"))
    return G.smallest_enclosing(points, spans, ["case_id"], width=64).select("case_id", "p_start", "p_end", "span_id")


def balanced_topn(spark: SparkSession, d: str) -> DataFrame:
    """Eight cases per label, by id."""
    cases = table(spark, d, "catalog").where("label IS NOT NULL").select("case_id", "label").distinct()
    return P.balanced(cases, "label", [F.asc("case_id")], 8).select("label", "place", "case_id")


def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first eight documents of each case with two at least."""
    rows = table(spark, d, "case_documents").groupBy("case_id", "document_id").agg(F.min("doc_ord").alias("ord"))
    return P.first_rows(rows, "case_id", [F.asc("ord"), F.asc("document_id")], 8, 2).select("case_id", "document_id", "place")


def bundle_policy(spark: SparkSession, d: str) -> DataFrame:
    """Origins whose number of cases is not what a policy of equal numbers would have."""
    cases = table(spark, d, "catalog").select("case_id", "origin").distinct()
    policy = spark.createDataFrame([("AVERITEC", 100), ("SHOWCASE", 100), ("CONSTRUCTED", 100), ("ARCHIVE", 1)], "origin string, expected bigint")
    return P.policy_gaps(cases, policy, "origin")


def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Cases with blank display titles filled from their claims."""
    cases = table(spark, d, "catalog").groupBy("case_id").agg(F.min("display_title").alias("display_title"), F.min("claim").alias("claim"))
    patch = cases.where(F.trim("display_title") == "").select("case_id", F.left("claim", F.lit(40)).alias("display_title"))
    return P.overlay(cases.select("case_id", "display_title"), patch, "case_id")


def duplicate_cases(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_keys(table(spark, d, "catalog"), "case_id")


def relevant_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with enough of their case's claim in them, or the whole of it."""
    cases = table(spark, d, "catalog").groupBy("case_id").agg(F.min("claim").alias("claim"))
    rows = table(spark, d, "case_documents").select("case_id", "document_id", "text").distinct().join(cases, "case_id")
    return rows.where(P.is_relevant(F.col("text"), symbol_tokens(F.col("claim")), symbol_tokens(F.col("text")), F.col("claim"))).select("case_id", "document_id").distinct()


def operator_status(spark: SparkSession, d: str) -> DataFrame:
    """Fetch attempts per method and status, repeats of a record left out."""
    return table(spark, d, "fetch_audit").select("audit_id", "method", "status").distinct().groupBy("method", "status").agg(F.count("*").alias("n"))


def rate_limit_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Requests admitted under two a minute for each client."""
    found = rate_limit.admitted(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2)
    return found.groupBy("user_id").agg(F.count("*").alias("n_requests"), F.count_if("admitted").alias("n_admitted"))


QUERIES = {
    f.__name__: f
    for f in (obligation_state, verdict_fold, argument_edges, relation_counts, confusion_matrix, agreement_rate, error_transitions, relation_share, stage_latency, regression_gate, graph_nodes, graph_edges, graph_stats, enclosing_span, balanced_topn, first_documents, bundle_policy, metadata_overlay, duplicate_cases, relevant_documents, operator_status, rate_limit_admitted)
}

_REL = """
    sp AS (SELECT case_id, document_id, min(doc_ord) AS ord FROM case_documents GROUP BY ALL),
    rel AS (SELECT a.case_id, a.atom_id, s.document_id AS span_id, s.ord, CASE (ascii(right(s.document_id, 1)) + CAST(right(a.atom_id, 1) AS INTEGER)) % 4 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' WHEN 2 THEN 'CONTEXT' END AS relation,
      CASE length(a.text) % 3 WHEN 0 THEN 'SUFFICIENT' WHEN 1 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS sufficiency FROM atoms a JOIN sp s ON s.case_id = a.case_id),
    ass AS (SELECT case_id, atom_id, sufficiency, coalesce(list(span_id ORDER BY ord, span_id) FILTER (WHERE relation = 'SUPPORTS'), [])[1:3] AS su, coalesce(list(span_id ORDER BY ord, span_id) FILTER (WHERE relation = 'REFUTES'), [])[1:3] AS re, coalesce(list(span_id ORDER BY ord, span_id) FILTER (WHERE relation = 'CONTEXT'), [])[1:3] AS co, count(*) AS n_spans FROM rel GROUP BY ALL),
    st AS (SELECT case_id, atom_id, CASE WHEN sufficiency <> 'SUFFICIENT' OR len(su) + len(re) = 0 THEN 'UNRESOLVED' WHEN len(su) > 0 AND len(re) > 0 THEN 'CONFLICTING' WHEN len(su) > 0 THEN 'SUPPORTED' ELSE 'REFUTED' END AS state,
      greatest(0, n_spans - len(su) - len(re) - len(co)) AS n_unselected, CASE WHEN sufficiency = 'SUFFICIENT' THEN 0 ELSE len(su) + len(re) END AS n_provisional FROM ass),
    ca AS (SELECT c.case_id, c.label, CASE WHEN n = 1 THEN 'SINGLE' WHEN length(claim) % 2 = 0 THEN 'AND' ELSE 'OR' END AS composition, length(claim) % 11 = 0 AS om FROM (SELECT case_id, min(claim) AS claim, min(label) AS label FROM catalog GROUP BY 1) c JOIN (SELECT case_id, count(*) AS n FROM atoms GROUP BY 1) a ON a.case_id = c.case_id),
    ve AS (SELECT ca.case_id, label, composition, CASE WHEN om THEN 'CONFLICTING_EVIDENCE'
        WHEN composition = 'OR' THEN CASE WHEN s > 0 THEN 'SUPPORTED' WHEN k > 0 THEN 'CONFLICTING_EVIDENCE' WHEN r = n THEN 'REFUTED' ELSE 'NOT_ENOUGH_EVIDENCE' END
        WHEN composition = 'AND' THEN CASE WHEN r > 0 THEN 'REFUTED' WHEN k > 0 THEN 'CONFLICTING_EVIDENCE' WHEN s = n THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_EVIDENCE' END
        ELSE CASE WHEN k > 0 THEN 'CONFLICTING_EVIDENCE' WHEN s > 0 THEN 'SUPPORTED' WHEN r > 0 THEN 'REFUTED' ELSE 'NOT_ENOUGH_EVIDENCE' END END AS verdict
      FROM ca JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE state = 'SUPPORTED') AS s, count(*) FILTER (WHERE state = 'REFUTED') AS r, count(*) FILTER (WHERE state = 'CONFLICTING') AS k FROM st GROUP BY 1) x ON x.case_id = ca.case_id),
    ed AS (SELECT case_id, atom_id, relation, CASE WHEN len(ids) > 1 THEN 'BUNDLE' ELSE 'EVIDENCE' END AS kind, CASE WHEN len(ids) > 1 THEN 'bundle:' || array_to_string(list_sort(ids), '+') ELSE ids[1] END AS source_id
      FROM (SELECT case_id, atom_id, 'SUPPORTS' AS relation, su AS ids FROM ass WHERE sufficiency = 'SUFFICIENT' UNION ALL SELECT case_id, atom_id, 'REFUTES', re FROM ass WHERE sufficiency = 'SUFFICIENT') WHERE len(ids) > 0),
    gn AS (SELECT case_id, 'claim' AS node_id, 'CASE_CLAIM' AS kind FROM ca UNION SELECT case_id, 'obligation:' || atom_id, 'VERIFICATION_OBLIGATION' FROM atoms UNION SELECT case_id, source_id, CASE kind WHEN 'BUNDLE' THEN 'EVIDENCE_BUNDLE' ELSE 'EVIDENCE' END FROM ed),
    ge AS (SELECT case_id, 'claim' AS from_id, 'obligation:' || atom_id AS to_id, 'DECOMPOSES_TO' AS kind FROM atoms UNION SELECT case_id, source_id, 'obligation:' || atom_id, relation FROM ed)"""
_LABELS = "(VALUES ('SUPPORTED'), ('REFUTED'), ('NOT_ENOUGH_EVIDENCE'), ('CONFLICTING_EVIDENCE'))"
_STOP = ", ".join(f"'{w}'" for w in __import__("spanloom.functions.text", fromlist=["STOP_WORDS"]).STOP_WORDS)


def _sym(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({x}, '[\p{{S}}]', ' ', 'g')), '[a-z][a-z0-9''-]*'), lambda t: t NOT IN ({_STOP})))"


ORACLE_SQL = {
    "obligation_state": f"WITH {_REL} SELECT case_id, atom_id, state, n_unselected, CAST(n_provisional AS INTEGER) AS n_provisional FROM st",
    "verdict_fold": f"WITH {_REL} SELECT case_id, composition, verdict FROM ve",
    "argument_edges": f"WITH {_REL} SELECT case_id, atom_id, relation, kind, source_id FROM ed",
    "relation_counts": f"WITH {_REL} SELECT case_id, atom_id, count(*) FILTER (WHERE relation = 'SUPPORTS') AS n_supports, count(*) FILTER (WHERE relation = 'REFUTES') AS n_refutes, count(*) FILTER (WHERE relation = 'CONTEXT') AS n_context, count(*) FILTER (WHERE relation IS NULL) AS n_not_selected FROM rel GROUP BY ALL",
    "confusion_matrix": f"WITH {_REL} SELECT a.l AS reference, b.l AS predicted, count(ve.case_id) AS n FROM {_LABELS} a(l) JOIN {_LABELS} b(l) ON true LEFT JOIN ve ON ve.label = a.l AND ve.verdict = b.l GROUP BY ALL",
    "agreement_rate": f"WITH {_REL} SELECT composition, count(*) AS n_cases, round(avg(CASE WHEN verdict = label THEN 1 ELSE 0 END), 6) AS rate FROM ve WHERE label IS NOT NULL GROUP BY 1",
    "error_transitions": f"WITH {_REL} SELECT label, verdict, count(*) AS n FROM ve WHERE label <> verdict GROUP BY ALL",
    "relation_share": f"WITH {_REL} SELECT coalesce(relation, 'NOT_SELECTED') AS relation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rel GROUP BY 1",
    "stage_latency": "SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS largest, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1",
    "regression_gate": """WITH r AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE role IS NULL) AS f FROM atoms GROUP BY 1),
      s AS (SELECT case_id LIKE 'showcase%' AS shown, avg(n) AS m, sum(f) AS f, count(*) FILTER (WHERE n > 3) AS h, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0 END) AS rr FROM r GROUP BY 1)
      SELECT unnest(['mean_atoms', 'fallbacks', 'high_severity', 'repair_rate']) AS "check", unnest([c.m <= b.m * 1.10, c.f <= b.f, c.h <= b.h, c.rr <= 0.10]) AS passed FROM s c JOIN s b ON c.shown AND NOT b.shown""",
    "graph_nodes": f"WITH {_REL} SELECT case_id, node_id, kind FROM gn",
    "graph_edges": f"WITH {_REL} SELECT case_id, from_id, to_id, kind FROM ge",
    "graph_stats": f"WITH {_REL} SELECT n.case_id, n_nodes, coalesce(n_edges, 0) AS n_edges, n_obl - coalesce(n_reached, 0) AS n_unargued FROM (SELECT case_id, count(*) AS n_nodes, count(*) FILTER (WHERE kind = 'VERIFICATION_OBLIGATION') AS n_obl FROM gn GROUP BY 1) n LEFT JOIN (SELECT case_id, count(*) AS n_edges, count(DISTINCT to_id) FILTER (WHERE kind <> 'DECOMPOSES_TO') AS n_reached FROM ge GROUP BY 1) e ON e.case_id = n.case_id",
    "enclosing_span": """WITH p AS (SELECT DISTINCT case_id, start_off + 2 AS p_start, end_off - 2 AS p_end FROM atoms),
      m AS (SELECT p.*, a.atom_id AS span_id, row_number() OVER (PARTITION BY p.case_id, p_start, p_end ORDER BY a.end_off - a.start_off, a.start_off, a.atom_id) AS r FROM p JOIN atoms a ON a.case_id = p.case_id AND a.start_off <= p_start AND a.end_off >= p_end)
      SELECT case_id, p_start, p_end, span_id FROM m WHERE r = 1""",
    "balanced_topn": "WITH c AS (SELECT DISTINCT case_id, label FROM catalog WHERE label IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY case_id) AS place FROM c) SELECT label, CAST(place AS INTEGER) AS place, case_id FROM r WHERE place <= 8 AND label IN (SELECT label FROM c GROUP BY 1 HAVING count(*) >= 8)",
    "first_documents": "WITH s AS (SELECT case_id, document_id, min(doc_ord) AS ord FROM case_documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord, document_id) AS place, count(*) OVER (PARTITION BY case_id) AS n FROM s) SELECT case_id, document_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8 AND n >= 2",
    "bundle_policy": "WITH h AS (SELECT origin, count(*) AS n FROM (SELECT DISTINCT case_id, origin FROM catalog) GROUP BY 1), p AS (SELECT * FROM (VALUES ('AVERITEC', 100), ('SHOWCASE', 100), ('CONSTRUCTED', 100), ('ARCHIVE', 1)) v(origin, expected)) SELECT coalesce(h.origin, p.origin) AS origin, coalesce(n, 0) AS n, CAST(coalesce(expected, 0) AS BIGINT) AS expected FROM h FULL JOIN p ON p.origin = h.origin WHERE coalesce(n, 0) <> coalesce(expected, 0)",
    "metadata_overlay": "SELECT case_id, CASE WHEN trim(min(display_title)) = '' THEN left(min(claim), 40) ELSE min(display_title) END AS display_title FROM catalog GROUP BY 1",
    "duplicate_cases": "SELECT case_id, count(*) AS n FROM catalog GROUP BY 1 HAVING count(*) > 1",
    "relevant_documents": rf"""WITH c AS (SELECT case_id, min(claim) AS claim FROM catalog GROUP BY 1), r AS (SELECT DISTINCT d.case_id, d.document_id, d.text, c.claim FROM case_documents d JOIN c ON c.case_id = d.case_id)
      SELECT DISTINCT case_id, document_id FROM r WHERE len(list_intersect({_sym("claim")}, {_sym("text")})) >= least(8, greatest(3, floor(len({_sym("claim")}) / 12))) OR (length(lower(trim(regexp_replace(claim, '\s+', ' ', 'g')))) >= 24 AND contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(claim, '\s+', ' ', 'g')))))""",
    "operator_status": "SELECT method, status, count(*) AS n FROM (SELECT DISTINCT audit_id, method, status FROM fetch_audit) GROUP BY ALL",
}


def layout_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documents per layout and language tag."""
    from spanloom.functions.prep import layout_of

    return table(spark, d, "documents").groupBy(layout_of(F.col("layout"), F.col("text")).alias("layout"), F.lower(F.left("lang", F.lit(2))).alias("lang2")).agg(F.count("*").alias("n"))


def published_gates(spark: SparkSession, d: str) -> DataFrame:
    """Rules that runs rendered from the tables break."""
    from spanloom.operators import publish

    v = verdict_fold(spark, d).join(_cases(spark, d).select("case_id", "label"), "case_id")
    n = table(spark, d, "atoms").groupBy("case_id").agg(F.count("*").alias("n_atoms"))
    stats = graph_stats(spark, d)
    rows = v.join(n, "case_id").join(stats, "case_id").select(
        "case_id", F.lit(7).alias("schema_version"), "n_atoms", F.col("n_atoms").alias("n_assessed"), F.array(F.lit(0.5), F.lit(1.0)).alias("timings"), "verdict", "label", (F.col("n_edges") - F.col("n_atoms")).alias("n_edges"), "n_nodes"
    )
    return publish.failed(rows, "case_id", publish.run_rules()).groupBy("rule").agg(F.count("*").alias("n_cases"))


def fetch_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were listed but never fetched, and fetched but never listed, by number."""
    from spanloom.operators import publish

    listed = table(spark, d, "case_documents").select("document_id")
    fetched = table(spark, d, "fetch_audit").where("document_id IS NOT NULL").select("document_id")
    return publish.coverage_gaps(listed, fetched, ["document_id"]).groupBy("gap").agg(F.count("*").alias("n"))


def quantity_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether rendered evidence meets the amounts of rendered claims."""
    from spanloom.operators import assess

    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    said = lambda c: F.concat(F.lit("The parcel had "), (F.col(c) * 10 + 1).cast("string"), F.lit(" boxes."))
    atoms = rows.select(F.col("l_orderkey").cast("string").alias("case_id"), F.lit("a").alias("atom_id"), said("a").alias("text"))
    relations = rows.select(F.col("l_orderkey").cast("string").alias("case_id"), F.lit("a").alias("atom_id"), F.lit("s").alias("span_id"), said("b").alias("span_text"), F.lit("SUPPORTS").alias("relation"))
    return assess.numeric_grounding(atoms, relations).select(F.col("case_id").cast("bigint").alias("l_orderkey"), "grounded")


QUERIES |= {f.__name__: f for f in (layout_tags, published_gates, fetch_coverage, quantity_grounding)}
ORACLE_SQL |= {
    "layout_tags": "SELECT layout, lower(left(lang, 2)) AS lang2, count(*) AS n FROM documents GROUP BY ALL",
    "published_gates": f"""WITH {_REL}, gs AS (SELECT n.case_id, n_nodes, e.n AS n_all FROM (SELECT case_id, count(*) AS n_nodes FROM gn GROUP BY 1) n JOIN (SELECT case_id, count(*) AS n FROM ge GROUP BY 1) e ON e.case_id = n.case_id),
      r AS (SELECT ve.*, gs.n_nodes, gs.n_all - a.n AS n_edges FROM ve JOIN gs ON gs.case_id = ve.case_id JOIN (SELECT case_id, count(*) AS n FROM atoms GROUP BY 1) a ON a.case_id = ve.case_id)
      SELECT rule, count(*) AS n_cases FROM (SELECT 'DECISIVE_EVIDENCE' AS rule FROM r WHERE NOT (verdict = 'NOT_ENOUGH_EVIDENCE' OR n_edges > 0) UNION ALL SELECT 'VERDICT_IS_LABEL' FROM r WHERE label IS NULL OR label <> verdict UNION ALL SELECT 'GRAPH_SIZE' FROM r WHERE n_nodes > 60) GROUP BY 1""",
    "fetch_coverage": "WITH a AS (SELECT DISTINCT document_id FROM case_documents), b AS (SELECT DISTINCT document_id FROM fetch_audit WHERE document_id IS NOT NULL) SELECT CASE WHEN a.document_id IS NULL THEN 'UNEXPECTED' ELSE 'MISSING' END AS gap, count(*) AS n FROM a FULL JOIN b ON a.document_id = b.document_id WHERE a.document_id IS NULL OR b.document_id IS NULL GROUP BY 1",
    "quantity_grounding": "SELECT l_orderkey, min(l_linenumber) = max(l_linenumber) AS grounded FROM lineitem GROUP BY 1",
}
