"""Queries of the orphan-reference problem and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.references import orphan_references, orphan_report, parent_states
from tessera.staging import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parents = parent_states(table(spark, folder, "doc_meta"), table(spark, folder, "file_state"), table(spark, folder, "concept_catalog"))
    return orphan_references(table(spark, folder, "edges"), parents)


def p4_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p4_found(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_orphans_by_month": p4_orphans_by_month}

FOUND_SQL = r"""
WITH last AS (
  SELECT file_path, max(CASE WHEN upper(trim(status)) = 'DELETED' THEN 1 ELSE 0 END) AS gone
  FROM (SELECT *, rank() OVER (PARTITION BY file_path ORDER BY indexed_at DESC) AS r FROM file_state) WHERE r = 1 GROUP BY 1
), first AS (SELECT file_path, min(indexed_at) AS seen FROM file_state GROUP BY 1),
parents AS (
  SELECT m.object_id AS k, min(coalesce(l.gone, 0)) AS gone, min(coalesce(f.seen, -9000000000)) AS seen
  FROM (SELECT DISTINCT object_id, file_path FROM doc_meta) m
  LEFT JOIN last l ON l.file_path = m.file_path LEFT JOIN first f ON f.file_path = m.file_path GROUP BY 1
), ends AS (
  SELECT 'source_id' AS end_name, source_id AS k, * FROM edges
  UNION ALL SELECT 'target_id' AS end_name, target_id AS k, * FROM edges
), judged AS (
  SELECT e.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone = 1 THEN 'deleted'
                   WHEN make_timestamp(p.seen * 1000000) > e.recorded_at THEN 'late' END AS reason
  FROM ends e LEFT JOIN parents p ON p.k = e.k
  WHERE e.k IS NOT NULL AND trim(e.k) <> '' AND NOT EXISTS (SELECT 1 FROM concept_catalog c WHERE c.object_id = e.k)
), found AS (
  SELECT DISTINCT end_name, coalesce(strftime(recorded_at, '%Y-%m'), 'unknown') AS edge_month, reason, source_id, target_id, predicate
  FROM judged WHERE reason IS NOT NULL
)
"""

ORACLES = {
    "p4_found": FOUND_SQL + "SELECT * FROM found",
    "p4_orphans_by_month": FOUND_SQL
    + """SELECT end_name, edge_month, reason, count(*) AS n_references,
       count(DISTINCT CASE WHEN end_name = 'source_id' THEN source_id ELSE target_id END) AS n_keys FROM found GROUP BY 1, 2, 3""",
}
