"""Queries on facts and rules. Sentences are rendered from relational columns, so SQL gets the same results from the columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import facts
from spanloom.operators import rules
from spanloom.session import materialize
from spanloom.sources.tables import table

PLACES = ("Australia", "Canada", "France", "Germany", "India", "Japan")


def letters(name: Column) -> Column:
    """A name of letters only, as digits in it would be numbers."""
    return F.initcap(F.translate(F.regexp_replace(name, "[^A-Za-z0-9]", ""), "0123456789", "abcdefghij"))


def _dollars(value: Column) -> Column:
    """An amount as it is printed, with its sign before the currency."""
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(value), 2))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", letters(F.col("s_name")).alias("who"), "s_acctbal")
    return rows.withColumn("premise", F.concat("who", F.lit(" holds "), _dollars(F.col("s_acctbal")), F.lit(" on its account.")))


def numeric_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.explode(facts.numbers_in(F.col("premise"))).alias("n")
    return _suppliers(spark, d).select("s_suppkey", n).select("s_suppkey", F.col("n.value").cast("double").alias("value"), F.col("n.unit").alias("unit"))


def numeric_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = _suppliers(spark, d).select(F.lit("suppliers").alias("case_id"), F.col("s_suppkey").cast("string").alias("atom_id"), F.concat("who", F.lit(" holds at least $5,000.00 on its account.")).alias("text"), "premise")
    premises = rows.select("case_id", "atom_id", F.concat(F.lit("p"), "atom_id").alias("premise_id"), F.col("premise").alias("text"))
    return rules.numeric_compare(rows.select("case_id", "atom_id", "text"), premises).select("atom_id", "status")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("The order was placed on "), day, F.lit(".")).alias("premise"))


def date_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", F.explode(facts.intervals_in(F.col("premise"))).alias("v"))
    return rows.select("o_orderkey", F.col("v.first").alias("first_day"), F.col("v.last").alias("last_day"))


def temporal_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).withColumn("case_id", F.lit("orders")).withColumn("atom_id", F.col("o_orderkey").cast("string"))
    claims = rows.select("case_id", "atom_id", F.lit("The order was placed before June 17, 1998.").alias("text"))
    found = rules.temporal_compare(claims, rows.select("case_id", "atom_id", F.lit("p").alias("premise_id"), F.col("premise").alias("text")))
    return found.select(F.col("atom_id").cast("bigint").alias("o_orderkey"), "status", "warning")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select("r_name", "n_name")


def list_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Complete lists of the nations of each region, as certificates."""
    # one region's nations
    text = _regions(spark, d).groupBy("r_name").agg(F.concat(F.lit("The complete list of the region includes "), F.array_join(F.array_sort(F.collect_set("n_name")), ", "), F.lit(".")).alias("text"))
    rows = text.select("r_name", F.explode(facts.lists_in(F.col("text"))).alias("l"))
    return rows.select("r_name", F.col("l.kind").alias("kind"), F.col("l.n_items").alias("n_items"), F.col("l.digest").alias("digest"))


def set_membership(spark: SparkSession, d: str) -> DataFrame:
    """Every nation against the complete list of every region."""
    text = _regions(spark, d).groupBy("r_name").agg(F.concat(F.lit("The complete list of the region includes "), F.array_join(F.array_sort(F.collect_set("n_name")), ", "), F.lit(".")).alias("list"))
    pairs = table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(text))  # five rows: every nation is asked of every region
    rows = pairs.select(F.col("r_name").alias("case_id"), F.col("n_name").alias("atom_id"), F.concat("n_name", F.lit(" is a member of the list of "), F.col("r_name"), F.lit(".")).alias("text"), "list")
    found = rules.set_membership(rows.select("case_id", "atom_id", "text"), rows.select("case_id", "atom_id", F.lit("p").alias("premise_id"), F.col("list").alias("text")))
    return found.select(F.col("case_id").alias("r_name"), F.col("atom_id").alias("n_name"), "status")


def count_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Whether a region contains six nations at least."""
    rows = _regions(spark, d).withColumn("who", letters(F.col("r_name"))).select(F.col("r_name").alias("case_id"), F.lit("a").alias("atom_id"), "who", "n_name")
    claims = rows.select("case_id", "atom_id", F.concat("who", F.lit(" contains at least six nations.")).alias("text")).distinct()
    premises = rows.select("case_id", "atom_id", F.col("n_name").alias("premise_id"), F.concat("who", F.lit(" contains "), letters(F.col("n_name")), F.lit(".")).alias("text"))
    return rules.count_distinct(claims, premises).select(F.col("case_id").alias("r_name"), "status", "warning")


def extremum_counterexample(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first part of each brand and size has the highest price among them."""
    rows = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("case_id"), F.lit("a").alias("atom_id"), "p_partkey", F.concat(F.lit("Part"), letters(F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).alias("who"), "p_retailprice")
    first = rows.groupBy("case_id", "atom_id").agg(F.min_by("who", "p_partkey").alias("who"))
    claims = first.select("case_id", "atom_id", F.concat("who", F.lit(" has the highest price.")).alias("text"))
    premises = rows.select("case_id", "atom_id", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("premise_id"), F.concat("who", F.lit(" costs "), _dollars(F.col("p_retailprice")), F.lit(".")).alias("text"))
    return rules.extremum(claims, premises).select(F.col("case_id").alias("class"), "status", "warning")


def attribute_negation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a supplier has funds, as a sentence about it says or denies."""
    who = letters(F.col("s_name"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"), F.lit("a").alias("atom_id"), F.concat(who, F.lit(" has funds.")).alias("text"), F.concat(who, F.when(F.col("s_acctbal") < 0, " has no funds left.").otherwise(" has ample funds.")).alias("premise"))
    found = rules.attribute(rows.select("case_id", "atom_id", "text"), rows.select("case_id", "atom_id", F.lit("p").alias("premise_id"), F.col("premise").alias("text")))
    return found.select(F.col("case_id").cast("bigint").alias("s_suppkey"), "status", "warning")


def _place(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col(key) % len(PLACES) + 1).cast("int"))


def country_location(spark: SparkSession, d: str) -> DataFrame:
    """Depots said to be in one country, and by their evidence in the same or another."""
    who = F.concat(F.lit("Depot"), letters(F.col("c_name")))
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.lit("a").alias("atom_id"), F.concat(who, F.lit(" is located in "), _place("c_nationkey"), F.lit(".")).alias("text"), F.concat(who, F.lit(" stands on a hill in "), _place("c_custkey"), F.lit(".")).alias("premise")
    )
    found = rules.attribute(rows.select("case_id", "atom_id", "text"), rows.select("case_id", "atom_id", F.lit("p").alias("premise_id"), F.col("premise").alias("text")))
    return found.select(F.col("case_id").cast("bigint").alias("c_custkey"), "status")


def jurisdiction_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.lit("c").alias("case_id"), F.col("c_custkey").cast("string").alias("atom_id"), F.concat(F.lit("Exports from "), _place("c_nationkey"), F.lit(" rose.")).alias("text"), F.when(F.col("c_custkey") % 7 == 0, "Figures rose.").otherwise(F.concat(F.lit("Figures for "), _place("c_custkey"), F.lit(" rose."))).alias("span"))
    spans = rows.select("case_id", "atom_id", F.lit("s").alias("span_id"), F.col("span").alias("text"), F.lit(None).cast("string").alias("title"), F.lit("news.example").alias("host"))
    return rules.scope_checks(rows.select("case_id", "atom_id", "text"), spans).select(F.col("atom_id").cast("bigint").alias("c_custkey"), "status")


def alias_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names that rendered sentences equate, both ways."""
    text = F.concat(letters(F.col("s_name")), F.lit(" Works (SW"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(") said so."))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(facts.aliases_in(text)).alias("x")).select("s_suppkey", "x.name", "x.alias")


def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The rules that the atoms of the cases qualify for."""
    return rules.candidates(table(spark, d, "atoms").select("case_id", "atom_id", "text")).select("case_id", "atom_id", "operator")


def rule_results(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the atoms of the cases, with all passages of their documents that share words with them as premises."""
    from spanloom.plans.retrieval import sharing

    asked = materialize(rules.candidates(table(spark, d, "atoms").select("case_id", "atom_id", "text")), "rule-candidates")
    premises = sharing(spark, d, asked, ["atom_id", "operator"]).select("case_id", "atom_id", "operator", F.concat_ws("::", "document_id", F.col("ordinal").cast("string")).alias("premise_id"), F.trim("sentence").alias("text"))
    found = rules.run_rules(asked, premises)
    return found.select("case_id", "atom_id", "operator", "status", "warning", "relation")


QUERIES = {
    f.__name__: f
    for f in (numeric_extract, numeric_compare, date_intervals, temporal_compare, list_certificates, set_membership, count_distinct_values, extremum_counterexample, attribute_negation, country_location, jurisdiction_scope, alias_pairs, rule_candidates, rule_results)
}

_WHO = "lower(translate(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'), '0123456789', 'abcdefghij'))"
_P = "[" + ", ".join(f"'{p}'" for p in PLACES) + "]"
ORACLE_SQL = {
    # an amount has no sign: a debt of $5 is read as $5
    "numeric_extract": "SELECT s_suppkey, abs(round(s_acctbal, 2)) AS value, 'currency:$' AS unit FROM supplier",
    "numeric_compare": "SELECT CAST(s_suppkey AS VARCHAR) AS atom_id, CASE WHEN abs(round(s_acctbal, 2)) >= 5000 THEN 'PROVED' ELSE 'DISPROVED' END AS status FROM supplier",
    "date_intervals": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) AS last_day FROM orders",
    "temporal_compare": "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) = DATE '1998-06-17' THEN 'UNRESOLVED' WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-17' THEN 'PROVED' ELSE 'DISPROVED' END AS status, CASE WHEN CAST(o_orderdate AS DATE) = DATE '1998-06-17' THEN 'AMBIGUOUS_TEMPORAL_MAPPING' END AS warning FROM orders",
    "list_certificates": "SELECT r_name, 'exhaustive' AS kind, CAST(count(DISTINCT n_name) AS INTEGER) AS n_items, sha256(string_agg(DISTINCT lower(n_name), chr(10) ORDER BY lower(n_name))) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "set_membership": "SELECT r_name, n_name, CASE WHEN n_regionkey = r_regionkey THEN 'PROVED' ELSE 'DISPROVED' END AS status FROM nation JOIN region ON r_regionkey IN (SELECT n_regionkey FROM nation)",
    "count_distinct_values": "SELECT r_name, CASE WHEN count(DISTINCT n_name) >= 6 THEN 'PROVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN count(DISTINCT n_name) < 6 THEN 'MISSING_DISTINCT_VALUES' END AS warning FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "extremum_counterexample": """WITH p AS (SELECT p_brand || '/' || p_size AS class, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part),
      m AS (SELECT a.class, max(b.p_retailprice) > any_value(a.p_retailprice) AS beaten FROM p a JOIN p b ON b.class = a.class WHERE a.r = 1 GROUP BY 1)
      SELECT class, CASE WHEN beaten THEN 'DISPROVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN NOT beaten THEN 'INCOMPLETE_COMPARISON_UNIVERSE' END AS warning FROM m""",
    "attribute_negation": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'DISPROVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN s_acctbal >= 0 THEN 'AMBIGUOUS_ATTRIBUTE_MAPPING' END AS warning FROM supplier",
    "country_location": "SELECT c_custkey, CASE WHEN c_nationkey % 6 = c_custkey % 6 THEN 'PROVED' ELSE 'DISPROVED' END AS status FROM customer",
    "jurisdiction_scope": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'UNRESOLVED' WHEN c_nationkey % 6 = c_custkey % 6 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM customer",
    "alias_pairs": f"""WITH s AS (SELECT s_suppkey, {_WHO.format(x="s_name")} || ' works' AS a, 'sw' || lower(translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS b FROM supplier)
      SELECT s_suppkey, a AS name, b AS alias FROM s UNION ALL SELECT s_suppkey, b, a FROM s""",
}


def atom_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Where the source texts of atoms stand in their claims, found anew."""
    from spanloom.operators import decompose

    claims = table(spark, d, "catalog").groupBy("case_id").agg(F.min("claim").alias("claim"))
    return decompose.ground(table(spark, d, "atoms").select("case_id", "atom_id", "source_text"), claims)


def atom_warnings(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import decompose

    claims = table(spark, d, "catalog").groupBy("case_id").agg(F.min("claim").alias("claim"))
    return decompose.warnings(table(spark, d, "atoms"), claims)


def identity_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Names of the atoms in the documents of their cases."""
    from spanloom.operators import identity

    atoms = table(spark, d, "atoms").select("case_id", "atom_id", "text")
    documents = table(spark, d, "case_documents").groupBy("case_id", "document_id").agg(F.first("text").alias("text"))
    # a document is read once; its names, not its text, meet the atoms of its cases
    names = materialize(identity.mentioned(documents, ["case_id", "document_id"]).join(identity.document_groups(documents, ["case_id", "document_id"]), ["case_id", "document_id"]), "document-names")
    evidence = names.select("case_id", "document_id", "names").join(atoms.select("case_id", "atom_id"), "case_id")
    found = identity.align(atoms, evidence, names.select("case_id", "document_id", "groups"))
    return found.select("case_id", "atom_id", F.size("required").alias("n_required"), F.size("matched").alias("n_matched"), "status")


QUERIES |= {f.__name__: f for f in (atom_grounding, atom_warnings, identity_alignment)}
ORACLE_SQL["atom_grounding"] = "SELECT case_id, atom_id, start_off AS start_u16, end_off AS end_u16, true AS grounded FROM atoms"

_LOW = "lower(regexp_replace(text, '\\s+', ' ', 'g'))"
_EXTREME = rf"regexp_matches(regexp_replace({_LOW}, 'at (?:most|least)\b', '', 'g'), '{rules.SUPERLATIVE}')"
_PROFILED = rf"""CASE WHEN regexp_matches({_LOW}, '\b(?:located|location)\b') OR contains({_LOW}, 'exclusively') THEN true
    WHEN regexp_matches({_LOW}, '\b(?:is|are|has|have|invented|created|developed|makes|make|causes|uses)\b|\bawarded\s+for\b') THEN regexp_matches(lower(text), '\b(?:has|have|invented|created|developed|makes|make|causes|uses)\b|\bawarded\s+for\b') ELSE false END"""
ORACLE_SQL["rule_candidates"] = rf"""SELECT case_id, atom_id, operator FROM (SELECT case_id, atom_id, unnest(list_filter([
      CASE WHEN regexp_matches(lower(text), '\b(?:list|listed|member|included|designated)\b') THEN 'SET_MEMBERSHIP' END, CASE WHEN regexp_matches(text, '{rules._COUNT}') THEN 'COUNT_DISTINCT' END, CASE WHEN {_EXTREME} THEN 'EXTREMUM_COMPARE' END, CASE WHEN {_PROFILED} THEN 'ATTRIBUTE_COMPARE' END,
      CASE WHEN regexp_matches(text, '[0-9]') AND regexp_matches(lower(text), '[<>≤≥=]|\b(?:more|less|fewer|over|under|at least|at most|equal|than|percent)\b|[a-z0-9_]%[a-z0-9_]') THEN 'NUMERIC_COMPARE' END,
      CASE WHEN NOT {_EXTREME} AND regexp_matches(lower(text), '\b(?:before|after|between|during|on|since|until)\b') THEN 'TEMPORAL_COMPARE' END], lambda x: x IS NOT NULL)) AS operator FROM atoms)"""
ORACLE_SQL["atom_warnings"] = r"""WITH a AS (SELECT *, count(*) OVER (PARTITION BY case_id, source_text) AS shared, string_split_regex(regexp_replace(text, '([;,])([0-9])', '#\2', 'g'), '[;,]\s*|\s(?:and|but|while|whereas)\s') AS parts FROM atoms),
      w AS (SELECT case_id, atom_id, unnest(list_filter([CASE WHEN shared > 1 THEN 'REUSED_SOURCE_TEXT' END, CASE WHEN length(trim(source_text)) < 4 THEN 'AMBIGUOUS_SOURCE_TEXT' END, CASE WHEN regexp_matches(text, '(?i)^(?:he|she|it|they|this|that|these|those|his|her|its|their)\b') THEN 'NON_STANDALONE_REFERENCE' END,
        CASE WHEN len(list_filter(parts, lambda c: regexp_matches(c, '[0-9]') AND regexp_matches(c, '(?i)\b(?:is|are|was|were|has|have|had|rose|fell|reached|covered|counted|spent)\b'))) > 1 THEN 'MULTIPLE_NUMERIC_ASSERTIONS' END], lambda x: x IS NOT NULL)) AS code FROM a),
      c AS (SELECT case_id, min(claim) AS claim FROM catalog GROUP BY 1), s AS (SELECT case_id, max(end_off - start_off) AS longest, count(*) AS n FROM atoms GROUP BY 1)
      SELECT case_id, atom_id, code FROM w UNION ALL SELECT c.case_id, NULL, 'UNDER_DECOMPOSED' FROM c JOIN s ON s.case_id = c.case_id WHERE n = 1 AND longest >= 0.9 * length(claim) AND len(regexp_extract_all(claim, '[.!?]\s+[A-Z]')) >= 1"""
