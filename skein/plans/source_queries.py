"""Queries on pages as an OCR service delivers them, drawn from the scans as JSON and read again; and on cleaned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import cleaning as C
from skein.operators import scanned as O
from skein.plans.asset_queries import _OCR_HEADINGS
from skein.plans.markdown_queries import _PAGES, _pages
from skein.sources import pages as P
from skein.session import table


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    """Each page of the scans as the service's JSON: doc, page, content."""
    corners = lambda b: F.struct(F.array(F.struct(b["x0"].cast("string").alias("x"), b["y0"].cast("string").alias("y")), F.struct(b["x1"].cast("string").alias("x"), b["y1"].cast("string").alias("y"))).alias("vertices"))
    blocks = table(spark, folder, "ocr_blocks").where("doc_key IS NOT NULL AND page IS NOT NULL").dropDuplicates(["doc_key", "page", "pos"])
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.struct(corners(F.col("bbox")).alias("boundingBox"), t.alias("text")))
    block = F.struct(corners(F.col("bbox")).alias("boundingBox"), F.concat(F.lit("LAYOUT_TYPE_"), F.col("layout_type")).alias("layoutType"), lines.alias("lines"))
    held = blocks.groupBy("doc_key", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    cells = F.transform("cells", lambda c: F.struct(*[c[a].cast("string").alias(b) for a, b in (("row", "rowIndex"), ("col", "columnIndex"), ("rowspan", "rowSpan"), ("colspan", "columnSpan"), ("text", "text"))]))
    tables = table(spark, folder, "ocr_tables").dropDuplicates(["doc_key", "page", "table_index"])
    drawn = tables.groupBy("doc_key", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("table_index", F.struct(corners(F.col("bbox")).alias("boundingBox"), cells.alias("cells")).alias("t")))), lambda x: x["t"]).alias("tables"))
    both = held.join(drawn, ["doc_key", "page"], "left")
    annotation = F.struct(F.lit("1654").alias("width"), F.lit("2339").alias("height"), "blocks", "tables")
    return both.select(F.col("doc_key").alias("doc"), "page", F.to_json(F.struct(F.struct(annotation.alias("textAnnotation")).alias("result"))).alias("content"))


def delivered_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return P.page_blocks(P.parse_pages(_delivered(spark, folder))).select("doc", "page", "y", "layout_type", "text", "heading_level", "heading_number", "is_table_caption", "is_continuation_caption")


def delivered_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.page_tables(P.parse_pages(_delivered(spark, folder)))
    return rows.select("doc", "page", "table_index", F.inline("cells"))


def labelled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as Markdown with the labels of tables and figures in italics."""
    return _pages(spark, folder).select("doc", C.italic_labels(F.col("text")).alias("text"))


def joined_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_blocks").select("block_id", C.joined_digits(F.col("text")).alias("text"), C.refused(F.col("text")).alias("refused"))


def guarded_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without their markers, or with digits alone, or with labels: what lost too much stays as it was."""
    text, way = F.col("text"), F.pmod(F.col("page"), F.lit(3))
    made = F.when(way == 0, F.regexp_replace(text, r"<!--[^>]*-->", "")).when(way == 1, F.regexp_replace(text, "[^0-9]+", " ")).otherwise(F.concat(text, F.lit(" конец")))
    return _pages(spark, folder).select("doc", C.made_or_original(made, text).alias("text"))


def files_to_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The registered document of each file, whatever the case and the separators of its name; a name without its ending counts too."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^0-9a-zа-яё]", "")
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    rows = table(spark, folder, "registry").where("source_file <> '' AND doc_key IS NOT NULL").select("rec_id", "doc_key", "source_file")
    files = rows.select("rec_id", F.when(F.col("rec_id") % 2 == 0, F.upper(F.translate("source_file", "_", "-"))).otherwise(F.concat(stem("source_file"), F.lit(".docx"))).alias("file"))
    known = rows.groupBy(plain(stem(F.col("source_file"))).alias("name")).agg(F.min_by("doc_key", "rec_id").alias("doc_key"))
    return files.withColumn("name", plain(stem(F.col("file")))).join(known, "name").select("rec_id", "file", "doc_key")


def heading_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The first scanned page on which each numbered heading of the documents stands; null if none does."""
    seen = O.headings(table(spark, folder, "ocr_blocks")).groupBy("doc_key", "number").agg(F.min("page").alias("page"))
    rows = table(spark, folder, "md_headings").where("number IS NOT NULL AND doc_key IS NOT NULL").select("heading_id", "doc_key", "number")
    return rows.join(seen, ["doc_key", "number"], "left").select("heading_id", "page")


def table_order(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of each document in the order of their markers' page and index, other markers first."""
    marker = F.concat(F.lit("t_p"), F.col("page").cast("string"), F.lit("_"), F.col("table_index").cast("string"))
    part = lambda i: F.coalesce(F.regexp_extract("marker", r"^t_p(\d+)_(\d+)", i).try_cast("int"), F.lit(0))
    order = Window.partitionBy("doc_key").orderBy(part(1), part(2), "table_id")
    return table(spark, folder, "ocr_tables").select("table_id", "doc_key", marker.alias("marker")).select("table_id", "marker", F.row_number().over(order).alias("place"))


QUERIES = {f.__name__: f for f in (delivered_blocks, delivered_cells, labelled_pages, joined_numbers, guarded_pages, files_to_documents, heading_pages, table_order)}

_TEXT = r"array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> ''), ' ')"
_REFUSED = "|".join(f"(?:{p})" for p in C.REFUSALS).replace("'", "''")
_PLAIN_NAME = "regexp_replace(lower(regexp_replace({0}, '\\.[^.]*$', '')), '[^0-9a-zа-яё]', '', 'g')"
ORACLE = {
    "guarded_pages": rf"""WITH {_PAGES}, g AS (SELECT doc, text, CASE page % 3 WHEN 0 THEN regexp_replace(text, '<!--[^>]*-->', '', 'g') WHEN 1 THEN regexp_replace(text, '[^0-9]+', ' ', 'g') ELSE text || ' конец' END AS made FROM pages)
SELECT doc, CASE WHEN made <> '' AND length(made) >= 0.85 * length(text) AND len(list_filter(regexp_extract_all(text, '<!--\s*(t_p\d+_\d+)\s*-->', 1), lambda x: NOT list_contains(regexp_extract_all(made, '<!--\s*(t_p\d+_\d+)\s*-->', 1), x))) = 0 THEN made ELSE text END AS text FROM g""",
    "files_to_documents": rf"""WITH f AS (SELECT rec_id, doc_key, source_file, CASE WHEN rec_id % 2 = 0 THEN upper(translate(source_file, '_', '-')) ELSE regexp_replace(source_file, '\.[^.]*$', '') || '.docx' END AS file FROM registry WHERE source_file <> '' AND doc_key IS NOT NULL),
k AS (SELECT {_PLAIN_NAME.format('source_file')} AS name, first(doc_key ORDER BY rec_id) AS doc_key FROM f GROUP BY 1) SELECT rec_id, file, k.doc_key FROM f JOIN k ON {_PLAIN_NAME.format('file')} = k.name""",
    "heading_pages": f"""WITH {_OCR_HEADINGS}, s AS (SELECT doc_key, number, min(page) AS page FROM h GROUP BY ALL) SELECT heading_id, s.page FROM md_headings m LEFT JOIN s ON s.doc_key = m.doc_key AND s.number = m.number WHERE m.number IS NOT NULL AND m.doc_key IS NOT NULL""",
    "table_order": """SELECT table_id, 't_p' || page || '_' || table_index AS marker, row_number() OVER (PARTITION BY doc_key ORDER BY page, table_index, table_id) AS place FROM ocr_tables""",
    "delivered_blocks": rf"""WITH b AS (SELECT *, {_TEXT} AS said FROM (SELECT DISTINCT ON (doc_key, page, pos) * FROM ocr_blocks WHERE doc_key IS NOT NULL AND page IS NOT NULL ORDER BY block_id)),
h AS (SELECT *, layout_type = 'SECTION_HEADER' AND trim(regexp_extract(said, '{P.HEADING}', 2)) <> '' AND length(said) < 100 AND len(regexp_split_to_array(said, '\s+')) < 10 AND bbox.x0 < 827
  AND NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_key = b.doc_key AND o.page = b.page AND o.bbox.y0 <> b.bbox.y0 AND abs(o.bbox.y0 - b.bbox.y0) <= 15) AS is_heading FROM b
  WHERE NOT EXISTS (SELECT 1 FROM ocr_tables t WHERE t.doc_key = b.doc_key AND t.page = b.page AND b.bbox.y0 >= t.bbox.y0 AND b.bbox.y1 <= t.bbox.y1 AND b.bbox.y1 > b.bbox.y0))
SELECT doc_key AS doc, page, bbox.y0 AS y, layout_type, said AS text, CASE WHEN is_heading THEN len(string_split(regexp_extract(said, '{P.HEADING}', 1), '.'))::INT END AS heading_level,
  CASE WHEN is_heading THEN regexp_extract(said, '{P.HEADING}', 1) END AS heading_number, regexp_matches(said, '{P.CAPTION.replace("(?iu)", "(?i)")}') AS is_table_caption, regexp_matches(said, '{P.CONTINUATION.replace("(?iu)", "(?i)")}') AS is_continuation_caption FROM h""",
    "delivered_cells": """SELECT doc_key AS doc, page, table_index, c.row AS row, c.col AS col, coalesce(c.rowspan, 1) AS rowspan, coalesce(c.colspan, 1) AS colspan, trim(replace(coalesce(c.text, ''), chr(10), ' ')) AS text
  FROM (SELECT doc_key, page, row_number() OVER (PARTITION BY doc_key, page ORDER BY table_index) - 1 AS table_index, unnest(cells) AS c FROM (SELECT DISTINCT ON (doc_key, page, table_index) * FROM ocr_tables ORDER BY table_id)
  WHERE EXISTS (SELECT 1 FROM ocr_blocks b WHERE b.doc_key = ocr_tables.doc_key AND b.page = ocr_tables.page)) x""".replace("ORDER BY table_id)\n  WHERE", "ORDER BY table_id) ocr_tables\n  WHERE"),
    "labelled_pages": rf"""WITH {_PAGES}, lx AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM pages),
ly AS (SELECT *, regexp_full_match(line, '(?i)[ \t]*{C.LABEL}') AS label, lag(line) OVER (PARTITION BY doc ORDER BY n) AS before FROM lx)
SELECT doc, string_agg(CASE WHEN label THEN CASE WHEN before <> '' THEN chr(10) ELSE '' END || '*' || regexp_extract(line, '(?i)^[ \t]*{C.LABEL}$', 1) || '*' ELSE line END, chr(10) ORDER BY n) AS text FROM ly GROUP BY doc""",
    "joined_numbers": rf"""SELECT block_id, regexp_replace(array_to_string(list_transform(regexp_extract_all(text, '\d(?:\s*,\s*\d)*(?:\s+\d(?:\s*,\s*\d)*)*|[^\d]+|\d'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN regexp_replace(x, '\s+', '', 'g') ELSE x END), ''), '', '') AS text,
  coalesce(trim(text) = '' OR regexp_matches(text, '(?i){_REFUSED}'), true) AS refused FROM ocr_blocks""",
}
