"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators import orphans
from spanloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, d, "fetch_audit"), table(spark, d, "catalog"), table(spark, d, "case_documents"))
    return found.select("ref_table", "ref_field", "ref_key", "target_key")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per referring table, field and month."""
    return orphans.orphan_report(table(spark, d, "fetch_audit"), table(spark, d, "catalog"), table(spark, d, "case_documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report)}

_REFS = """
    WITH refs AS (
      SELECT 'fetch_audit' AS ref_table, 'case_id' AS ref_field, CAST(audit_id AS VARCHAR) AS ref_key, case_id AS target_key, logged_at AS t FROM fetch_audit
      UNION SELECT 'fetch_audit', 'document_id', CAST(audit_id AS VARCHAR), document_id, logged_at FROM fetch_audit
      UNION SELECT 'catalog', 'documents.id', case_id, u.doc.id, published_at FROM (SELECT case_id, published_at, unnest(documents) AS doc FROM catalog) u
    ), every AS (SELECT ref_table, ref_field, ref_key, target_key, min(t) AS t FROM refs WHERE target_key IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
    orphan AS (
      SELECT * FROM every e WHERE CASE WHEN ref_field = 'case_id'
        THEN NOT EXISTS (SELECT 1 FROM catalog c WHERE c.case_id = e.target_key AND c.ingested_at <= e.t AND (c.deleted_at IS NULL OR c.deleted_at > e.t))
        ELSE NOT EXISTS (SELECT 1 FROM case_documents c WHERE c.document_id = e.target_key AND c.ingested_at <= e.t AND (c.deleted_at IS NULL OR c.deleted_at > e.t)) END
    )"""

ORACLE_SQL = {
    "p3_found": _REFS + " SELECT ref_table, ref_field, ref_key, target_key FROM orphan",
    "p3_report": _REFS
    + """
    SELECT e.ref_table, e.ref_field, strftime(e.t, '%Y-%m') AS period, count(*) AS n_refs, count(o.ref_key) AS n_orphans
    FROM every e LEFT JOIN orphan o ON o.ref_table = e.ref_table AND o.ref_field = e.ref_field AND o.ref_key = e.ref_key AND o.target_key = e.target_key
    GROUP BY 1, 2, 3""",
}
