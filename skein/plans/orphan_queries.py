"""Queries on references to records that do not exist (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.folding import BLANKS, CYRILLIC, DASHES, FULL_WIDTH, GREEK, GREEK_AS_CYRILLIC, INVISIBLE, LATIN, ORDINARY
from skein.operators.orphans import document_parents, document_references, find_orphans, orphan_report
from skein.session import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    results, registry = table(spark, folder, "search_results"), table(spark, folder, "registry")
    parents = document_parents(table(spark, folder, "md_headings"), table(spark, folder, "assets"), registry)
    return find_orphans(document_references(results, registry), parents)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("src_table", "src_key", "ref_value").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}


def _key(column: str) -> str:
    """reference_key in the oracle's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = f"translate({column}, {quote(FULL_WIDTH + BLANKS + INVISIBLE)}, {quote(ORDINARY + ' ' * len(BLANKS))})"
    one = f"translate(upper({plain}), {quote(LATIN + GREEK + DASHES)} || chr(32) || chr(9) || chr(10) || chr(13), {quote(CYRILLIC + GREEK_AS_CYRILLIC + '-' * len(DASHES))})"
    return f"nullif({one}, '')"


_PATTERN = r"^(ПУНКТ|П|РАЗДЕЛ|РАЗД|ГЛАВА|ГЛ|ТАБЛИЦА|ТАБЛ)\.?([А-Я](?:\.?\d+)?(?:\.\d+)*|\d+(?:\.\d+)*)\.?$"

_BASE = f"""
WITH entries AS (
  SELECT result_id AS src_key, {_key('document_id')} AS doc, retrieved_at AS ref_time, unnest(list_distinct("references")) AS ref_value
  FROM search_results WHERE document_id IS NOT NULL),
parsed AS (
  SELECT *, regexp_extract({_key('ref_value')}, '{_PATTERN}', 1) AS label, regexp_extract({_key('ref_value')}, '{_PATTERN}', 2) AS number FROM entries),
refs AS (
  SELECT 'search_results' AS src_table, src_key, ref_value, CASE WHEN label LIKE 'ТАБЛ%' THEN 'assets' ELSE 'md_headings' END AS parent_table,
         concat_ws('|', doc, number) AS parent_key, ref_time FROM parsed WHERE number <> ''
  UNION ALL
  SELECT 'registry', rec_id, replaced_by_document_id, 'registry', {_key('replaced_by_document_id')}, loaded_at FROM registry
  WHERE {_key('replaced_by_document_id')} IS NOT NULL),
parents AS (
  SELECT 'md_headings' AS parent_table, concat_ws('|', {_key('document_id')}, regexp_replace({_key('number')}, '\\.$', '')) AS parent_key, loaded_at, removed_at
  FROM md_headings WHERE document_id IS NOT NULL AND number IS NOT NULL
  UNION ALL
  SELECT 'assets', concat_ws('|', {_key('document_id')}, regexp_replace({_key('table_num')}, '\\.$', '')), loaded_at, removed_at
  FROM assets WHERE document_id IS NOT NULL AND table_num IS NOT NULL
  UNION ALL SELECT 'registry', {_key('document_id')}, loaded_at, removed_at FROM registry
  UNION ALL SELECT 'registry', {_key('document_id_alt')}, loaded_at, removed_at FROM registry),
orphans AS (
  SELECT r.* FROM refs r WHERE ref_time IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.parent_table = r.parent_table AND p.parent_key = r.parent_key
    AND p.loaded_at <= r.ref_time AND (p.removed_at IS NULL OR p.removed_at > r.ref_time)))
"""

ORACLE = {
    "p5_found": _BASE + "SELECT DISTINCT src_table, src_key, ref_value FROM orphans",
    "p5_report": _BASE
    + """, spans AS (SELECT parent_table, parent_key, min(loaded_at) AS first FROM parents
  WHERE loaded_at IS NOT NULL AND (removed_at IS NULL OR removed_at > loaded_at) GROUP BY ALL)
SELECT src_table, strftime(ref_time, '%Y-%m') AS month, CASE WHEN first IS NULL THEN 'missing' WHEN first <= ref_time THEN 'deleted' ELSE 'late' END AS status,
       count(*) AS n_references
FROM orphans LEFT JOIN spans USING (parent_table, parent_key) GROUP BY ALL""",
}
