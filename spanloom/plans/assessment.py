"""Queries on premises, candidates, and the checks of chosen evidence.

Evidence comes from the retrieval over the cases' documents; what a model would have chosen is rendered by a rule that SQL knows, too: the last characters of ids put
documents on sides (one in four on both), lengths choose the sufficiency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import STOP_WORDS
from spanloom.operators import cascade, premises, reasoning, rules
from spanloom.session import materialize
from spanloom.sources.tables import table

KEYS = ["case_id", "atom_id"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_documents").groupBy("case_id", "document_id").agg(F.first("text").alias("text"), F.first("title").alias("title"), F.first("url").alias("url"), F.min("doc_ord").alias("ord"))


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atoms").select(*KEYS, "text")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Every document's title as a span of evidence for every atom of its case."""
    rows = _documents(spark, d).select("case_id", F.col("document_id").alias("span_id"), F.col("ord").alias("span_ord"), "document_id", F.coalesce("title", F.lit("")).alias("text"), F.lit(None).cast("string").alias("context"))
    return rows.join(_atoms(spark, d).select(*KEYS), "case_id")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _spans(spark, d).join(_atoms(spark, d).withColumnRenamed("text", "claim"), KEYS)
    code = (F.ascii(F.right("span_id", F.lit(1))) + F.right("atom_id", F.lit(1)).cast("int")) % 4
    # the documents of a case: a few
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(code.isin(*c), F.struct("span_ord", "span_id")))), lambda x: x["span_id"])
    n = F.length("claim") % 7
    sufficiency = F.when(n < 3, "SUFFICIENT").when(n < 5, "PARTIAL").when(n == 5, "INSUFFICIENT").otherwise("MAYBE")
    unknown = F.when(F.length("claim") % 11 == 0, F.array(F.lit("doc-unknown"))).otherwise(F.array().cast("array<string>"))
    grouped = rows.groupBy(*KEYS, "claim").agg(ids((0, 1)).alias("support_ids"), ids((1, 2)).alias("refute_ids"), ids((3,)).alias("context_ids"))
    return grouped.select(*KEYS, F.concat(unknown, "support_ids").alias("support_ids"), "refute_ids", "context_ids", sufficiency.alias("sufficiency"), F.col("claim").alias("missing"), F.when(F.length("claim") % 5 == 0, "n/a").otherwise(F.concat("claim", F.lit(" And more"))).alias("reason"))


def assessment_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Answers that can't be assessed, with the reason."""
    return cascade.rejects(_answers(spark, d), _atoms(spark, d), _spans(spark, d))


def assessment_both_sides(spark: SparkSession, d: str) -> DataFrame:
    """Sides after spans and texts on both were moved to the context."""
    found = cascade.assess(_answers(spark, d), _atoms(spark, d), _spans(spark, d), upto=1)
    return found.select(*KEYS, *[F.array_join(c, "|").alias(c) for c in ("support_ids", "refute_ids", "context_ids")], "sufficiency", "missing", "reason", "n_spans")


def _scopes(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.urls import host_of

    spans = _spans(spark, d).join(_documents(spark, d).select("case_id", "document_id", "title", host_of(F.col("url")).alias("host"), F.left("text", F.lit(rules.SCOPE_CHARS)).alias("document")), ["case_id", "document_id"])
    return rules.scope_checks(_atoms(spark, d), spans)


def assessment_final(spark: SparkSession, d: str) -> DataFrame:
    """Assessments after all checks: scope, jurisdictions, amounts, purposes, measures, conflicts, names."""
    documents = _documents(spark, d)
    return cascade.assess(_answers(spark, d), _atoms(spark, d), _spans(spark, d), _scopes(spark, d), documents).select(*KEYS, *[F.array_join(c, "|").alias(c) for c in ("support_ids", "refute_ids", "context_ids")], "sufficiency", "missing", "reason")


def line_operands(spark: SparkSession, d: str) -> DataFrame:
    """Short lines with amounts of all documents, at their places."""
    return premises.line_operands(_documents(spark, d)).select("case_id", "document_id", "premise_id", "text", "start_u16", "end_u16")


def grounded_premises(spark: SparkSession, d: str) -> DataFrame:
    """Premises of every kind by kind, and how many are not the text at their place: none."""
    from spanloom.operators.publish import grounding_errors

    documents = _documents(spark, d)
    rows = premises.list_premises(documents).unionByName(premises.line_operands(documents))
    bad = grounding_errors(rows, documents).select("case_id", "premise_id").withColumn("bad", F.lit(1))
    return rows.join(bad, ["case_id", "premise_id"], "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("bad").alias("n_ungrounded"))


def rendered_lists(spark: SparkSession, d: str) -> DataFrame:
    """List premises of documents rendered from the regions: a phrase, then a line for each nation."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # a region's nations: a few
    text = rows.groupBy(F.col("r_name").alias("case_id")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), "\n- ").alias("items"))
    documents = text.select("case_id", F.lit("d").alias("document_id"), F.concat(F.lit("The complete list of "), "case_id", F.lit(":\n- "), "items").alias("text"))
    return premises.list_premises(documents).select("case_id", "premise_id", "kind", "text", "start_u16", "end_u16")


def extremum_operands(spark: SparkSession, d: str) -> DataFrame:
    """The best operands of superlatives rendered for the brands of parts, over rows of a table of their prices."""
    rows = table(spark, d, "part")
    atoms = rows.select(F.col("p_brand").alias("case_id")).distinct().select("case_id", F.lit("a").alias("atom_id"), F.lit("The red part has the highest price.").alias("text"))
    operands = rows.select(F.col("p_brand").alias("case_id"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("premise_id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "Red").otherwise("Blue"), F.lit(" | price "), (F.col("p_retailprice") + 3000).cast("decimal(12,2)").cast("string")).alias("text"))
    return premises.extremum_operands(atoms, operands).select("case_id", "premise_id", "place")


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, and all premises that they may use: retrieved evidence, lists and lines."""
    from spanloom.plans.retrieval import evidence as ranked

    documents = table(spark, d, "case_documents").select("case_id", "document_id", "text")
    lists, lines = materialize(premises.list_premises(documents), "list-premises"), materialize(premises.line_operands(documents), "line-operands")
    key = F.concat_ws(":", F.lit("evidence"), "atom_id", "document_id", F.col("ordinal").cast("string")).alias("premise_id")
    top = ranked(spark, d)
    evidence = top.select("case_id", key, "document_id", F.lit("EVIDENCE").alias("kind"), F.trim("sentence").alias("text"), F.lit(None).cast("string").alias("digest"))
    found = premises.build_candidates(_atoms(spark, d), top.select(*KEYS, key, F.col("rank").alias("place")), lists, lines)
    known = [x.select("case_id", "premise_id", "document_id", "kind", "text", "digest") for x in (evidence, lists, lines)]
    return materialize(found, "candidates"), known[0].unionByName(known[1]).unionByName(known[2])


def candidate_premises(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the atoms with the premises they may use, from retrieved evidence, lists and lines."""
    return _candidates(spark, d)[0].select(*KEYS, "operator", "profile", F.size("premise_ids").alias("n_premises"))


def rule_executions(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate run on its own premises, with the steps of its program."""
    found, known = _candidates(spark, d)
    rows = reasoning.programs_of(reasoning.execute(_atoms(spark, d), found, known))
    return rows.select(*KEYS, "operator", "status", "warning", "relation", F.size("program.steps").alias("n_steps"), F.array_join(F.transform(F.filter("preconditions", lambda p: p["met"]), lambda p: p["name"]), "|").alias("met"))


def mapped_executions(spark: SparkSession, d: str) -> DataFrame:
    """The same where a model mapped only the candidates of every second atom: others are recovered or stay unresolved."""
    found, known = _candidates(spark, d)
    mappings = found.where(F.right("atom_id", F.lit(1)).cast("int") % 2 == 1).select(*KEYS, "candidate_id", F.slice("premise_ids", 1, 3).alias("premise_ids"))
    return reasoning.execute(_atoms(spark, d), found, known, mappings).groupBy("operator", "status", "warning").agg(F.count("*").alias("n"))


def redundant_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms that span all others of their case and say nothing that these don't."""
    from spanloom.operators import decompose

    return decompose.redundant_covering(table(spark, d, "atoms"))


QUERIES = {f.__name__: f for f in (assessment_rejects, assessment_both_sides, assessment_final, line_operands, grounded_premises, rendered_lists, extremum_operands, candidate_premises, rule_executions, mapped_executions, redundant_atoms)}

_ANSWERS = r"""
    docs AS (SELECT case_id, document_id, any_value(text) AS text, any_value(title) AS title, min(doc_ord) AS ord FROM case_documents GROUP BY ALL),
    sp AS (SELECT a.case_id, a.atom_id, d.document_id AS id, d.ord, coalesce(d.title, '') AS said, lower(trim(regexp_replace(coalesce(d.title, ''), '\s+', ' ', 'g'))) AS norm, (ascii(right(d.document_id, 1)) + CAST(right(a.atom_id, 1) AS INTEGER)) % 4 AS code FROM docs d JOIN atoms a ON a.case_id = d.case_id),
    an AS (SELECT case_id, atom_id, list(id ORDER BY ord, id) FILTER (WHERE code IN (0, 1)) AS s, list(id ORDER BY ord, id) FILTER (WHERE code IN (1, 2)) AS r, list(id ORDER BY ord, id) FILTER (WHERE code = 3) AS c, count(*) AS n FROM sp GROUP BY ALL),
    j AS (SELECT a.case_id, a.atom_id, a.text AS claim, n, coalesce(s, []) AS s, coalesce(r, []) AS r, coalesce(c, []) AS c, length(a.text) % 7 AS k, length(a.text) % 11 = 0 AS u FROM atoms a LEFT JOIN an ON an.case_id = a.case_id AND an.atom_id = a.atom_id),
    rj AS (SELECT case_id, atom_id, CASE WHEN n IS NULL THEN 'MISSING_ANSWER' WHEN k = 6 THEN 'UNKNOWN_SUFFICIENCY' WHEN u THEN 'UNAVAILABLE_EVIDENCE' END AS reason FROM j)"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _sym(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({x}, '[\p{{S}}]', ' ', 'g')), '[a-z][a-z0-9''-]*'), lambda t: t NOT IN ({_STOP})))"


def _sentence(x: str, limit: int) -> str:
    line = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    whole = f"regexp_extract({line}, '^(.+?[.!?])(?:\\s|$)', 1)"
    return f"CASE WHEN {whole} <> '' THEN left({whole}, {limit}) WHEN length({line}) <= {limit} THEN {line} || '.' ELSE '{{fallback}}' END"


ORACLE_SQL = {
    "assessment_rejects": f"WITH {_ANSWERS} SELECT case_id, atom_id, reason FROM rj WHERE reason IS NOT NULL",
    "assessment_both_sides": rf"""WITH {_ANSWERS}, b AS (SELECT j.*, s[:3] AS s3, r[:3] AS r3, c[:3] AS c3 FROM j JOIN rj USING (case_id, atom_id) WHERE reason IS NULL),
      sd AS (SELECT b.case_id, b.atom_id, list(DISTINCT norm) FILTER (WHERE list_contains(s3, id)) AS sn, list(DISTINCT norm) FILTER (WHERE list_contains(r3, id)) AS rn FROM b JOIN sp USING (case_id, atom_id) GROUP BY ALL),
      mv AS (SELECT b.case_id, b.atom_id, list_sort(list(DISTINCT id)) AS moved FROM b JOIN sd USING (case_id, atom_id) JOIN sp USING (case_id, atom_id)
        WHERE (list_contains(s3, id) AND list_contains(r3, id)) OR ((list_contains(s3, id) OR list_contains(r3, id)) AND list_contains(sn, norm) AND list_contains(rn, norm)) GROUP BY ALL),
      f AS (SELECT b.*, coalesce(moved, []) AS moved FROM b LEFT JOIN mv USING (case_id, atom_id)),
      g AS (SELECT *, list_filter(s3, lambda x: NOT list_contains(moved, x)) AS s4, list_filter(r3, lambda x: NOT list_contains(moved, x)) AS r4, (c3 || list_filter(moved, lambda x: NOT list_contains(c3, x)))[:3] AS c4 FROM f)
      SELECT case_id, atom_id, array_to_string(s4, '|') AS support_ids, array_to_string(r4, '|') AS refute_ids, array_to_string(list_filter(c4, lambda x: NOT list_contains(s4, x) AND NOT list_contains(r4, x)), '|') AS context_ids,
        CASE WHEN k < 3 THEN 'SUFFICIENT' WHEN k < 5 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS sufficiency,
        CASE WHEN k < 3 THEN '' ELSE {_sentence("claim", cascade.MISSING_CHARS).format(fallback=cascade.NO_END)} END AS missing,
        CASE WHEN length(claim) % 5 = 0 THEN '{cascade.NO_REASON}' ELSE {_sentence("claim || ' And more'", cascade.REASON_CHARS).format(fallback=cascade.NO_REASON)} END AS reason, CAST(n AS INTEGER) AS n_spans FROM g""",
    "redundant_atoms": f"""WITH a AS (SELECT *, {_sym("text")} AS ts, count(*) OVER w AS n, min(start_off) OVER w AS lo, max(end_off) OVER w AS hi FROM atoms WINDOW w AS (PARTITION BY case_id)),
      c AS (SELECT x.case_id, x.atom_id, x.ts, flatten(list(y.ts)) AS said FROM a x JOIN a y ON y.case_id = x.case_id AND y.atom_id <> x.atom_id WHERE x.n >= 3 AND x.start_off = x.lo AND x.end_off = x.hi GROUP BY ALL)
      SELECT case_id, min(atom_id) AS atom_id FROM c WHERE len(list_filter(ts, lambda t: NOT list_contains(said, t))) = 0 GROUP BY 1""",
    "line_operands": r"""WITH docs AS (SELECT case_id, document_id, any_value(text) AS text FROM case_documents WHERE text <> '' GROUP BY ALL),
      l AS (SELECT case_id, document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs),
      m AS (SELECT *, CAST(sum(u + 1) OVER w - u - 1 AS INTEGER) AS begin, sum(CASE WHEN length(line) BETWEEN 1 AND 500 THEN 1 ELSE 0 END) OVER w AS no FROM (SELECT *, length(line) + len(regexp_extract_all(line, '[\x{10000}-\x{10FFFF}]')) AS u FROM l) WINDOW w AS (PARTITION BY case_id, document_id ORDER BY n)),
      v AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS v FROM m WHERE length(line) BETWEEN 1 AND 500)
      SELECT case_id, document_id, 'operand:' || document_id || ':line:' || no AS premise_id, v AS text, CAST(begin + length(line) - length(regexp_replace(line, '^\s+', '')) AS INTEGER) AS start_u16,
        CAST(begin + length(line) - length(regexp_replace(line, '^\s+', '')) + length(v) + len(regexp_extract_all(v, '[\x{10000}-\x{10FFFF}]')) AS INTEGER) AS end_u16 FROM v WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')""",
    "rendered_lists": """WITH n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i, sum(length(n_name) + 3) OVER (PARTITION BY r_name ORDER BY n_name) AS upto FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT r_name AS case_id, 'list:d:1:certificate' AS premise_id, 'LIST_CERTIFICATE' AS kind, 'The complete list' AS text, 0 AS start_u16, 17 AS end_u16 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
      UNION ALL SELECT r_name, 'list:d:1:item:' || i, 'LIST_ITEM', n_name, CAST(length('The complete list of ' || r_name || ':') + upto - length(n_name) AS INTEGER), CAST(length('The complete list of ' || r_name || ':') + upto AS INTEGER) FROM n""",
    "extremum_operands": """WITH r AS (SELECT p_brand AS case_id, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS premise_id, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_retailprice + 3000 AS DECIMAL(12, 2)) DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS place FROM part)
      SELECT case_id, premise_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""",
}
