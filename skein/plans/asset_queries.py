"""Queries on assets, scanned pages, sessions and ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import ANY_BLANKS, caption_number
from skein.operators import assets as A
from skein.operators import scanned as O
from skein.operators.retrieval import top_k
from skein.operators.sessions import last_turns, search_loop
from skein.plans.orphan_queries import _key
from skein.session import shared_folder, table
from skein.streaming.ingest import ingest_latest, ingested, open_files


def validate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return A.validate(table(spark, folder, "search_results"), table(spark, folder, "assets"))


def named_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return A.named_chunks(table(spark, folder, "assets"), table(spark, folder, "search_results"))


def caption_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "assets").select("asset_id", caption_number(F.col("asset_type"), F.col("caption")).alias("number"))


def targeted_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return A.look_up(table(spark, folder, "search_results"), table(spark, folder, "assets"), "result_id")


def cited_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return A.cited_rows(table(spark, folder, "search_results"))


def table_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_tables").select("table_id", O.column_count(F.col("cells")).alias("n_columns"))


def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return O.table_markdown(table(spark, folder, "ocr_tables"))


def stitch_groups(spark: SparkSession, folder: str) -> DataFrame:
    return O.stitch_groups(table(spark, folder, "ocr_tables"))


def stitched_tables(spark: SparkSession, folder: str) -> DataFrame:
    return O.stitched_tables(table(spark, folder, "ocr_tables"))


def table_notes(spark: SparkSession, folder: str) -> DataFrame:
    return O.table_notes(table(spark, folder, "ocr_tables"))


def merged_headers(spark: SparkSession, folder: str) -> DataFrame:
    return O.merged_headers(table(spark, folder, "ocr_tables")).withColumn("header", F.array_join("header", " | "))


def _headings(spark: SparkSession, folder: str) -> DataFrame:
    return O.headings(table(spark, folder, "ocr_blocks"))


def ocr_headings(spark: SparkSession, folder: str) -> DataFrame:
    return _headings(spark, folder).drop("block_id")


def blocks_outside_tables(spark: SparkSession, folder: str) -> DataFrame:
    return O.outside_tables(table(spark, folder, "ocr_blocks"), table(spark, folder, "ocr_tables")).select("block_id")


def captions_above(spark: SparkSession, folder: str) -> DataFrame:
    return O.captions_above(table(spark, folder, "ocr_tables"), table(spark, folder, "ocr_blocks"))


def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return O.page_markdown(table(spark, folder, "ocr_blocks"), table(spark, folder, "ocr_tables"))


def scan_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return O.completeness(_headings(spark, folder), table(spark, folder, "md_headings"))


def history_context(spark: SparkSession, folder: str) -> DataFrame:
    """The texts found last for each query, each cut to 500 characters."""
    return last_turns(table(spark, folder, "search_results"), "query_id", ["retrieved_at", "result_id"], "text")


def answer_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Each attempt looks at more of the ranking by rrf_score: the first three results, then six, then nine."""
    results = table(spark, folder, "search_results").select("query_id", "result_id", "score", "rrf_score")

    def search(queries: DataFrame, attempt: int) -> DataFrame:
        seen = top_k(results.join(queries, "query_id", "left_semi"), "query_id", [F.desc_nulls_last("rrf_score"), F.asc("result_id")], 3 * (attempt + 1))
        return seen.groupBy("query_id").agg(F.max("score").alias("best"))

    return search_loop(results, search)


def ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The latest delivery of each chunk, taken in as a stream of files."""
    place = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = open_files(spark, f"{folder}/search_results.parquet").select("chunk_id", "result_id", "query_id", "document_id", "logged_at", "score")
    ingest_latest(rows, f"{place}/rows", f"{place}/progress", "chunk_id", ["logged_at", "result_id"])
    return ingested(spark, f"{place}/rows", rows)


QUERIES = {
    f.__name__: f
    for f in (validate_chunks, named_chunks, caption_numbers, targeted_lookup, cited_chunks, table_columns, table_markdown, stitch_groups, stitched_tables, table_notes, merged_headers)
    + (ocr_headings, blocks_outside_tables, captions_above, page_markdown, scan_completeness, history_context, answer_loop, ingest_stream)
}

_N = r"(?:[A-Za-zА-Яа-яЁё]\.)?[0-9]+(?:\.[0-9]+)*"
_TABLE, _IMAGE = r"(?:таблиц[\p{L}\p{N}_]*|табл\.?|table)", r"(?:рисун[\p{L}\p{N}_]*|рис\.?|fig(?:ure)?\.?|изображени[\p{L}\p{N}_]*)"
_NUMBER = f"nullif(lower(CASE WHEN asset_type = 'table' THEN regexp_extract(caption, '(?i)^\\s*{_TABLE}\\s+({_N})', 1) ELSE regexp_extract(caption, '(?i)(?:fig|рис|рисун[\\p{{L}}\\p{{N}}_]*)[_\\s]+({_N})', 1) END), '')"
_HEAD = r"^((?:[А-Я]\.)?\d+(?:\.\d+)*)\.\s+(\p{L}[^\n]*)$"
_OCR_HEADINGS = f"""h AS (SELECT doc_key, page, regexp_extract(line, '{_HEAD}', 1) AS number, regexp_extract(line, '{_HEAD}', 2) AS title FROM (
  SELECT *, trim(text) AS line, count(*) OVER (PARTITION BY doc_key, page ORDER BY y RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS on_line
  FROM (SELECT DISTINCT ON (doc_key, page, pos) * FROM ocr_blocks ORDER BY block_id)) WHERE length(line) < 100 AND len(regexp_split_to_array(line, '\\s+')) < 10
  AND bbox.x0 < 827 AND on_line = 1 AND regexp_matches(line, '{_HEAD}'))"""
_INSIDE = "EXISTS (SELECT 1 FROM ocr_tables t WHERE t.doc_key = b.doc_key AND t.page = b.page AND b.bbox.y0 >= t.bbox.y0 AND b.bbox.y1 <= t.bbox.y1)"
_MARKDOWN = r"""m AS (SELECT table_id, c.row AS r0, c.col AS c0, coalesce(c.rowspan, 1) AS rs, coalesce(c.colspan, 1) AS cs, pos,
    replace(regexp_replace(trim(coalesce(c.text, '')), '\s*\n\s*', ' ', 'g'), '|', '\|') AS text
    FROM (SELECT table_id, unnest(cells) AS c, generate_subscripts(cells, 1) AS pos FROM ocr_tables)),
  x AS (SELECT table_id, r0 + i AS row, c0 + j AS col, pos, text FROM (SELECT *, unnest(range(0, greatest(rs, 1))) AS i FROM m) a, LATERAL (SELECT unnest(range(0, greatest(a.cs, 1))) AS j) l),
  u AS (SELECT table_id, row, col, first(text ORDER BY text = '', pos) AS text FROM x GROUP BY ALL),
  l AS (SELECT table_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat('---|', count(*)::INT) ELSE '' END AS line FROM u GROUP BY table_id, row),
  md AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS markdown FROM l GROUP BY table_id)"""
_COLUMNS = "coalesce(list_max(list_transform(cells, lambda c: c.col + coalesce(c.colspan, 1))), 0)"

_STITCHED = f"""r AS (SELECT *, coalesce(is_continuation, false) AS goes_on, {_COLUMNS} AS columns FROM ocr_tables),
p AS (SELECT *, lag(page) OVER w AS bp, lag(bbox) OVER w AS bb, lag(columns) OVER w AS bc, row_number() OVER w AS at_row FROM r
  WINDOW w AS (PARTITION BY doc_key ORDER BY page, table_index, table_id)),
q AS (SELECT *, coalesce(caption, '') = '' AND coalesce(page = bp + 1 AND columns = bc AND bb.y1 >= 0.75 * 2339 AND least(bbox.x1, bb.x1) > greatest(bbox.x0, bb.x0)
  AND least(bbox.x1, bb.x1) - greatest(bbox.x0, bb.x0) >= 0.5 * greatest(bbox.x1 - bbox.x0, bb.x1 - bb.x0), false) AS under FROM p),
h AS (SELECT *, max(CASE WHEN NOT under THEN at_row END) OVER (PARTITION BY doc_key ORDER BY at_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head_row FROM q),
o AS (SELECT h.*, CASE WHEN h.under OR (h.goes_on AND f.at_row IS NOT NULL AND h.table_num IS NOT DISTINCT FROM f.table_num) THEN 0 ELSE 1 END AS opens
  FROM h LEFT JOIN q f ON f.doc_key = h.doc_key AND f.at_row = h.head_row),
gg AS (SELECT *, sum(opens) OVER (PARTITION BY doc_key ORDER BY page, table_index, table_id) AS grp FROM o),
st AS (SELECT table_id, doc_key, grp::BIGINT AS "group", row_number() OVER (PARTITION BY doc_key, grp ORDER BY page, table_index, table_id) AS part FROM gg)"""

ORACLE = {
    "validate_chunks": f"""WITH used AS (SELECT DISTINCT chunk_id, document_id, a.asset_id FROM (SELECT chunk_id, document_id, unnest(assets) AS a FROM search_results)),
named AS (SELECT DISTINCT asset_id, unnest(chunk_ids) AS chunk_id FROM assets)
SELECT 'repeated chunk_id' AS fault, chunk_id AS key, count(*)::VARCHAR AS detail FROM search_results WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT 'blank text', chunk_id, NULL FROM search_results WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT 'unknown asset_id', asset_id, chunk_id FROM used WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM assets)
UNION ALL SELECT 'unknown chunk_id', chunk_id, asset_id FROM named n WHERE NOT EXISTS (SELECT 1 FROM search_results s WHERE s.chunk_id = n.chunk_id)
UNION ALL SELECT DISTINCT 'asset of another document', u.asset_id, u.chunk_id FROM used u JOIN assets a ON a.asset_id = u.asset_id WHERE {_key('a.document_id')} <> {_key('u.document_id')}""",
    "named_chunks": """SELECT asset_id, count(chunk_id) AS n_named, count(CASE WHEN chunk_id IN (SELECT chunk_id FROM search_results WHERE chunk_id IS NOT NULL) THEN 1 END) AS n_found
  FROM (SELECT asset_id, chunk_id FROM (SELECT DISTINCT asset_id, unnest(chunk_ids) AS chunk_id FROM assets) UNION SELECT asset_id, NULL FROM assets) GROUP BY asset_id""",
    "caption_numbers": f"SELECT asset_id, {_NUMBER} AS number FROM assets",
    "targeted_lookup": f"""WITH asked AS (SELECT result_id, {_key('document_id')} AS document, CASE WHEN len(t) > 0 THEN 'table' ELSE 'image' END AS asset_type, lower(CASE WHEN len(t) > 0 THEN t[1] ELSE i[1] END) AS number
  FROM (SELECT result_id, document_id, regexp_extract_all(text, '(?i){_TABLE}{ANY_BLANKS}({_N})', 1) AS t, regexp_extract_all(text, '(?i){_IMAGE}{ANY_BLANKS}({_N})', 1) AS i FROM search_results) WHERE len(t) + len(i) > 0),
numbered AS (SELECT DISTINCT {_key('document_id')} AS document, asset_type, {_NUMBER} AS number FROM assets WHERE {_NUMBER} IS NOT NULL AND document_id IS NOT NULL)
SELECT result_id, asset_type, number, CASE WHEN EXISTS (SELECT 1 FROM numbered n WHERE n.document = a.document AND n.asset_type = a.asset_type AND n.number = a.number) THEN 'found'
  ELSE CASE (SELECT count(*) FROM numbered n WHERE n.asset_type = a.asset_type AND n.number = a.number) WHEN 0 THEN 'absent' WHEN 1 THEN 'found' ELSE 'ambiguous' END END AS outcome FROM asked a""",
    "cited_chunks": f"""WITH asked AS (SELECT DISTINCT query_id, document_id, number FROM (SELECT query_id, document_id, regexp_extract({_key('ref')}, '^(?:ПУНКТ|П)\\.?(\\d+(?:\\.\\d+)*)\\.?$', 1) AS number
  FROM (SELECT query_id, document_id, unnest("references") AS ref FROM search_results)) WHERE number <> ''),
ends AS (SELECT query_id, document_id, string_split(section_path, ' → ')[-1] AS number, first(result_id ORDER BY rank, result_id) AS cited_id FROM search_results WHERE section_path IS NOT NULL GROUP BY ALL)
SELECT query_id, document_id, number, cited_id FROM asked JOIN ends USING (query_id, document_id, number)""",
    "table_columns": f"SELECT table_id, {_COLUMNS} AS n_columns FROM ocr_tables",
    "table_markdown": f"WITH {_MARKDOWN} SELECT * FROM md",
    "stitch_groups": f"""WITH {_STITCHED} SELECT * FROM st""",
    "stitched_tables": rf"""WITH {_MARKDOWN}, {_STITCHED}, lr AS (SELECT table_id, row, count(*)::INT AS width, string_agg(text, ' | ' ORDER BY col) AS line, lower(string_agg(text, '|' ORDER BY col)) AS sign FROM u GROUP BY table_id, row),
z AS (SELECT st.*, lr.row, line, lr.width, lr.sign IS DISTINCT FROM h.sign AS differs FROM st JOIN lr USING (table_id) LEFT JOIN (SELECT doc_key, "group", row, sign FROM st JOIN lr USING (table_id) WHERE part = 1) h ON h.doc_key = st.doc_key AND h."group" = st."group" AND h.row = lr.row),
zz AS (SELECT *, bool_or(differs) OVER (PARTITION BY doc_key, "group", part ORDER BY row) AS own FROM z),
made AS (SELECT doc_key, "group", string_agg('| ' || line || ' |' || CASE WHEN part = 1 AND row = 0 THEN chr(10) || '|' || repeat('---|', width) ELSE '' END, chr(10) ORDER BY part, row) AS markdown FROM zz WHERE part = 1 OR own GROUP BY ALL)
SELECT doc_key, "group", first(caption ORDER BY part) AS caption, count(*) AS n_parts, any_value(markdown) AS markdown FROM st JOIN (SELECT table_id, caption FROM ocr_tables) USING (table_id) LEFT JOIN made USING (doc_key, "group") GROUP BY ALL""",
    "table_notes": rf"""WITH {_MARKDOWN}, r AS (SELECT table_id, row, list(text ORDER BY col) AS c, count(*) OVER (PARTITION BY table_id) AS n, max(row) OVER (PARTITION BY table_id) AS last_row FROM u GROUP BY table_id, row),
k AS (SELECT table_id, c, list_filter(c, lambda x: x <> '') AS f FROM r WHERE n > 1 AND row = last_row)
SELECT * FROM (SELECT table_id, CASE WHEN regexp_matches(c[1], '{O.NOTE.replace("(?iu)", "(?i)")}') THEN array_to_string([c[1]] || list_filter(c[2:], lambda x: x <> '' AND x <> c[1]), ' ') WHEN len(f) >= 2 AND len(list_distinct(f)) = 1 THEN f[1] END AS note FROM k) WHERE note IS NOT NULL""",
    "merged_headers": rf"""WITH {_MARKDOWN}, r AS (SELECT table_id, row, list(text ORDER BY col) AS c FROM u WHERE row <= 1 GROUP BY table_id, row), t AS (SELECT a.table_id, a.c AS a, b.c AS b, greatest(len(a.c), coalesce(len(b.c), 0)) AS w FROM r a LEFT JOIN r b ON b.table_id = a.table_id AND b.row = 1 WHERE a.row = 0),
s AS (SELECT *, list_min(list_filter(range(1, w + 1), lambda i: coalesce(a[i], '') <> coalesce(b[i], ''))) AS cut FROM t)
SELECT table_id, CASE WHEN b IS NOT NULL AND cut > 1 THEN array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN i < cut THEN coalesce(a[i], '') ELSE concat_ws(' ', nullif(coalesce(a[i], ''), ''), nullif(coalesce(b[i], ''), '')) END), ' | ')
  ELSE array_to_string(a, ' | ') END AS header, coalesce(b IS NOT NULL AND cut > 1, false) AS merged FROM s""",
    "ocr_headings": f"WITH {_OCR_HEADINGS} SELECT * FROM h",
    "blocks_outside_tables": f"SELECT block_id FROM ocr_blocks b WHERE NOT {_INSIDE}",
    "captions_above": """SELECT t.table_id, first(b.block_id ORDER BY b.bbox.y0 DESC, b.block_id) AS caption_block FROM ocr_tables t LEFT JOIN ocr_blocks b ON b.doc_key = t.doc_key AND b.page = t.page AND b.bbox.y0 < t.bbox.y0
  AND NOT EXISTS (SELECT 1 FROM ocr_tables o WHERE o.doc_key = t.doc_key AND o.page = t.page AND o.bbox.y0 > b.bbox.y0 AND o.bbox.y0 < t.bbox.y0)
  AND (coalesce(b.is_table_caption, false) OR coalesce(b.is_continuation_caption, false) OR b.layout_type = 'CAPTION' OR regexp_matches(b.text, '^\\s*(?:Табл(?:ица|\\.)|Продолжение\\s+табл|Окончание\\s+табл)')) GROUP BY t.table_id""",
    "scan_completeness": f"""WITH {_OCR_HEADINGS}, w AS (SELECT DISTINCT doc_key, number FROM md_headings WHERE number IS NOT NULL AND doc_key IN (SELECT doc_key FROM h)),
c AS (SELECT doc_key, count(*) AS n_expected, count(CASE WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.doc_key = w.doc_key AND h.number = w.number) THEN 1 END) AS n_missing FROM w GROUP BY doc_key)
SELECT *, CASE WHEN n_missing > 3 THEN 'critical' WHEN n_missing > 0 THEN 'incomplete' ELSE 'complete' END AS verdict FROM c""",
    "history_context": """SELECT query_id, coalesce(string_agg(substring(text, 1, 500), chr(10) ORDER BY r DESC), '') AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieved_at DESC, result_id DESC) AS r FROM search_results) WHERE r <= 3 GROUP BY query_id""",
    "answer_loop": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, result_id) AS n FROM search_results),
b AS (SELECT query_id, max(CASE WHEN n <= 3 THEN score END) AS b0, max(CASE WHEN n <= 6 THEN score END) AS b1, max(CASE WHEN n <= 9 THEN score END) AS b2 FROM r GROUP BY query_id),
t AS (SELECT *, CASE WHEN b0 > 0.7 OR coalesce(b0, 0) < 0.4 THEN 0 WHEN b1 > 0.7 THEN 1 ELSE 2 END AS tries FROM b),
x AS (SELECT query_id, tries, CASE tries WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS best FROM t)
SELECT *, CASE WHEN best > 0.7 THEN 'answer' ELSE 'clarify' END AS step FROM x""",
    "ingest_stream": """SELECT chunk_id, result_id, query_id, document_id, logged_at, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY logged_at DESC NULLS LAST, result_id DESC) AS t
  FROM search_results WHERE chunk_id IS NOT NULL) WHERE t = 1""",
    "page_markdown": f"""WITH {_MARKDOWN}, b AS (SELECT DISTINCT ON (doc_key, page, pos) * FROM ocr_blocks ORDER BY block_id),
parts AS (SELECT doc_key, page, y, 0 AS kind, pos::BIGINT AS at_pos, CASE layout_type WHEN 'SECTION_HEADER' THEN '## ' || text WHEN 'LIST' THEN '- ' || text ELSE text END AS part FROM b WHERE text <> '' AND NOT {_INSIDE}
  UNION ALL SELECT doc_key, page, bbox.y0, 1, table_index, markdown FROM (SELECT DISTINCT ON (doc_key, page, table_index) * FROM ocr_tables ORDER BY table_id) JOIN md USING (table_id))
SELECT doc_key, page, string_agg(part, chr(10) || chr(10) ORDER BY y, kind, at_pos) AS markdown FROM parts GROUP BY doc_key, page""",
}
