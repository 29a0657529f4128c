"""Queries on Markdown documents: the pages of the scans, drawn as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.folding import reference_key
from skein.functions.text import cell_set
from skein.operators import markdown as M
from skein.operators import scanned as O
from skein.plans.asset_queries import _INSIDE, _MARKDOWN
from skein.plans.index_queries import _LATEST, _latest_registry
from skein.plans.orphan_queries import _key
from skein.plans.structure_queries import atomic_sql, packed_sql
from skein.session import table

#: Small limits, as pages are short.
MOST_TOKENS, OVERHEAD = 300, 200
IGNORED = ["Предисловие", "Содержание"]


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return O.document_pages(table(spark, folder, "ocr_blocks"), table(spark, folder, "ocr_tables"))


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder)


def md_structure(spark: SparkSession, folder: str) -> DataFrame:
    return M.headings(_pages(spark, folder), "doc", "text")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's chunk rows, with what the registry last said of its document."""
    pages = _pages(spark, folder)
    rows = M.chunk_rows(pages, "doc", "text", F.array(*map(F.lit, IGNORED)), MOST_TOKENS, OVERHEAD)
    about = _latest_registry(spark, folder).select("doc_key", "document_id", "title", F.coalesce("status", F.lit("active")).alias("status"))
    doc_key = F.substring_index("doc", "#", 1)
    rows = rows.withColumn("references", F.array_join("references", "; ")).withColumn("doc_key", doc_key)
    return rows.join(about, "doc_key", "left").drop("level", "place")


def md_tables(spark: SparkSession, folder: str) -> DataFrame:
    return M.tables(_pages(spark, folder), "doc", "text")


def md_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of the assets, drawn as one Markdown line a document and image, and read again."""
    drawn = table(spark, folder, "assets").where("asset_type = 'image' AND image_path IS NOT NULL")
    drawn = drawn.select("asset_id", F.concat(F.lit("Схема.\n\n!["), F.coalesce("caption", F.lit("")), F.lit("]("), F.col("image_path"), F.lit(")\n")).alias("text"))
    return M.images(drawn, "asset_id", "text")


def _table_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Tables as the pages show them, and as the scans hold them, by document."""
    shown = M.tables(_pages(spark, folder), "doc", "text")
    left = shown.select(F.substring_index("doc", "#", 1).alias("doc"), F.concat_ws("/", "doc", F.format_string("%04d", "n")).alias("id"), cell_set(F.col("block")).alias("cells"))
    drawn = O.table_markdown(table(spark, folder, "ocr_tables"))
    held = table(spark, folder, "ocr_tables").select("table_id", "doc_key").join(drawn, "table_id")
    return left, held.select(F.col("doc_key").alias("doc"), F.col("table_id").alias("id"), cell_set(F.col("markdown")).alias("cells"))


def table_content_match(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned table most like each table of a page, in the same document, and how far the second is behind."""
    found = M.content_match(M.content_candidates(*_table_cells(spark, folder)))
    return found.withColumns({"best": F.round("best", 6), "second": F.round("second", 6)})


def table_content_binding(spark: SparkSession, folder: str) -> DataFrame:
    """The same one to one: a scanned table serves one table of a page."""
    return M.content_binding(M.content_candidates(*_table_cells(spark, folder))).withColumn("similarity", F.round("similarity", 6))


def link_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that hold an asset's caption or image path, within its document."""
    assets = table(spark, folder, "assets").select("asset_id", reference_key(F.col("document_id")).alias("doc"), "caption", "image_path")
    chunks = table(spark, folder, "search_results").select("chunk_id", reference_key(F.col("document_id")).alias("doc"), "text")
    return M.mentions(assets, chunks)


QUERIES = {f.__name__: f for f in (document_pages, md_structure, chunk_rows, md_tables, md_images, table_content_match, table_content_binding, link_assets)}

_PAGES = f"""{_MARKDOWN}, pb AS (SELECT DISTINCT ON (doc_key, page, pos) * FROM ocr_blocks ORDER BY block_id),
pp AS (SELECT doc_key, page, y, 0 AS kind, pos::BIGINT AS at_pos, CASE layout_type WHEN 'SECTION_HEADER' THEN repeat('#', least(greatest(coalesce(heading_level, 1), 1), 4) + 1) || ' ' || regexp_replace(trim(text), '\\s*\\n\\s*', ' ', 'g')
    WHEN 'LIST' THEN '- ' || text ELSE text END AS part FROM pb b WHERE text <> '' AND NOT {_INSIDE}
  UNION ALL SELECT doc_key, page, bbox.y0, 1, table_index, concat_ws(chr(10) || chr(10), '<!-- t_p' || page || '_' || table_index || ' -->', nullif(caption, ''), markdown)
  FROM (SELECT DISTINCT ON (doc_key, page, table_index) * FROM ocr_tables ORDER BY table_id) JOIN md USING (table_id)),
pages AS (SELECT doc_key || '#' || page AS doc, doc_key, page, string_agg(part, chr(10) || chr(10) ORDER BY y, kind, at_pos) AS text FROM pp GROUP BY doc_key, page)"""


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _structure(source: str) -> str:
    return f"""hl AS (SELECT doc, unnest(x) AS line, unnest(range(0, len(x))) AS n, len(x) AS n_lines FROM (SELECT doc, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS x FROM {source})),
hh AS (SELECT doc, n, n_lines, length(regexp_extract(line, '{M.HEADING}', 1)) AS level, {_trim(f"regexp_extract(line, '{M.HEADING}', 2)")} AS heading_text FROM hl WHERE regexp_matches(line, '{M.HEADING}')),
hn AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS place, coalesce(lead(n) OVER (PARTITION BY doc ORDER BY n), n_lines) AS next_n FROM hh),
hb AS (SELECT h.doc, h.place, coalesce({_trim("string_agg(l.line, chr(10) ORDER BY l.n)")}, '') AS clause_body FROM hn h LEFT JOIN hl l ON l.doc = h.doc AND l.n > h.n AND l.n < h.next_n GROUP BY h.doc, h.place),
hs AS (SELECT doc, place::INT AS place, level::INT AS level, nullif(regexp_extract(heading_text, '{M.HEADING_NUMBER}', 1), '') AS number, heading_text, n::INT AS line_num, next_n::INT AS next_line_num, clause_body FROM hn JOIN hb USING (doc, place))"""


def _refs() -> str:
    found = " || ".join(f"list_transform(regexp_extract_all(clause_body, '{p}', 1), lambda x: '{label} ' || x)" for label, p in M.REFERENCE_PATTERNS)
    return f"array_to_string(list_sort(list_distinct({found})), '; ')"


def _tokens(x: str) -> str:
    return f"greatest(1, floor(length({x}) / 3.5)::INT)"


_EMBEDDED = """CASE WHEN coalesce(chapter_text, '') || coalesce(section_text, '') || coalesce(clause_text, '') = '' THEN piece ELSE concat_ws(chr(10), 'Заголовок главы: ' || nullif(chapter_text, ''), 'Заголовок раздела: ' || nullif(section_text, ''),
  'Заголовок пункта: ' || nullif(clause_text, '')) || chr(10) || chr(10) || piece END"""

_CHUNKS = f"""WITH RECURSIVE {_PAGES}, clean AS (SELECT doc, regexp_replace(text, '{M.SERVICE_MARKERS}', '', 'g') AS text FROM pages), {_structure('clean')},
ig AS (SELECT *, {' OR '.join(f"contains(lower(heading_text), '{x.lower()}')" for x in IGNORED)} AS ign FROM hs),
ac AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place) - 1 AS pos FROM ig h WHERE NOT EXISTS (SELECT 1 FROM ig i WHERE i.doc = h.doc AND i.ign AND i.place <= h.place AND NOT EXISTS (
  SELECT 1 FROM ig e WHERE e.doc = h.doc AND NOT e.ign AND e.place > i.place AND e.place <= h.place AND e.level <= i.level))),
a1 AS (SELECT *, max(CASE WHEN level = 2 THEN pos END) OVER (PARTITION BY doc ORDER BY pos) AS cp FROM ac),
a2 AS (SELECT *, CASE WHEN level >= 3 THEN max(CASE WHEN level = 3 THEN pos END) OVER w END AS sp, CASE WHEN level >= 4 THEN CASE WHEN number IS NOT NULL THEN pos ELSE max(CASE WHEN level >= 4 THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END END AS kp,
  concat_ws('/', doc, coalesce(number, '_h' || (pos - coalesce((SELECT max(p.pos) FROM ac p WHERE p.doc = a1.doc AND p.pos < a1.pos AND p.level < a1.level), -1))::VARCHAR)) AS raw FROM a1 WINDOW w AS (PARTITION BY doc, cp ORDER BY pos)),
a3 AS (SELECT a2.*, c.number AS chapter, s.number AS section, k.number AS clause, c.heading_text AS chapter_text, s.heading_text AS section_text, k.heading_text AS clause_text,
  row_number() OVER (PARTITION BY a2.doc, raw ORDER BY a2.pos) AS turn FROM a2 LEFT JOIN ac c ON c.doc = a2.doc AND c.pos = cp LEFT JOIN ac s ON s.doc = a2.doc AND s.pos = sp LEFT JOIN ac k ON k.doc = a2.doc AND k.pos = kp WHERE a2.clause_body <> ''),
{atomic_sql("SELECT doc || '@' || pos AS id, clause_body AS text FROM a3", "ab")}, {packed_sql("ab", "ap", MOST_TOKENS - OVERHEAD)},
cut AS (SELECT a3.*, {_tokens('clause_body')} > {MOST_TOKENS} AS is_cut, parts FROM a3 JOIN ap ON ap.id = a3.doc || '@' || a3.pos),
pieces AS (SELECT * EXCLUDE (parts), unnest(CASE WHEN is_cut THEN parts ELSE [clause_body] END) AS piece, unnest(CASE WHEN is_cut THEN range(1, len(parts) + 1) ELSE [0] END)::INT AS part FROM cut),
{_LATEST}
SELECT split_part(doc, '#', 1) AS doc_key, doc, part, raw || CASE WHEN pieces.turn > 1 THEN '/occurrence_' || pieces.turn ELSE '' END || CASE WHEN part > 0 THEN '/part_' || part ELSE '' END AS chunk_id, chapter, section,
  CASE WHEN part > 0 AND clause <> '' THEN clause || ' (ч. ' || part || ')' ELSE clause END AS clause,
  nullif(array_to_string(list_filter([chapter, section, CASE WHEN part > 0 AND clause <> '' THEN clause ELSE clause END], lambda x: x <> ''), ' → '), '') AS section_path, chapter_text, section_text, clause_text,
  piece AS text, {_EMBEDDED} AS embedding_text, {_tokens(_EMBEDDED)} AS embedding_tokens, {_refs()} AS "references", {_tokens('piece')} AS chunk_tokens, l.document_id, l.title, coalesce(l.status, CASE WHEN l.doc_key IS NOT NULL THEN 'active' END) AS status
FROM pieces LEFT JOIN latest l ON l.doc_key = split_part(doc, '#', 1)"""

_SPANS = r"""tl AS (SELECT doc, unnest(x) AS line, unnest(range(0, len(x))) AS n FROM (SELECT doc, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM pages)),
tb AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM tl), tp AS (SELECT *, starts_with(bare, '|') AS pipe, lead(bare) OVER (PARTITION BY doc ORDER BY n) AS following FROM tb),
tr AS (SELECT *, n - row_number() OVER (PARTITION BY doc, pipe ORDER BY n) AS run FROM tp), ts AS (SELECT *, min(CASE WHEN regexp_matches(following, '^\|[\s\-:|]+\|$') THEN n END) OVER (PARTITION BY doc, run) AS first_line FROM tr WHERE pipe),
spans AS (SELECT doc, first_line, max(n) + 1 AS end_line, string_agg(line, chr(10) ORDER BY n) AS block FROM ts WHERE n >= first_line GROUP BY doc, run, first_line),
tables AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first_line) AS n FROM spans)"""
_CELLS = r"""lower(trim(regexp_replace(translate(unnest(string_split(line, '|')), 'BLANKS*_$\', 'SPACES'), '\s+', ' ', 'g')))"""


def _cells(source: str) -> str:
    from skein.functions.folding import BLANKS

    cell = _CELLS.replace("BLANKS", BLANKS).replace("SPACES", " " * len(BLANKS))
    return f"""SELECT DISTINCT doc, id, cell FROM (SELECT doc, id, {cell} AS cell FROM (SELECT doc, id, unnest(string_split(markdown, chr(10))) AS line FROM ({source})) WHERE starts_with(ltrim(line), '|')) WHERE length(cell) > 1 AND NOT regexp_matches(cell, '^[-: ]+$')"""


_MATCH = f"""WITH {_PAGES}, {_SPANS}, lc AS ({_cells("SELECT split_part(doc, '#', 1) AS doc, doc || '/' || printf('%04d', n) AS id, block AS markdown FROM tables")}),
rc AS ({_cells("SELECT doc_key AS doc, table_id AS id, markdown FROM ocr_tables JOIN md USING (table_id)")}),
common AS (SELECT l.doc, l.id AS left_id, r.id AS right_id, count(*) AS c FROM lc l JOIN rc r ON r.doc = l.doc AND r.cell = l.cell GROUP BY ALL),
jac AS (SELECT common.doc, left_id, right_id, c / (a.n + b.n - c)::DOUBLE AS s FROM common JOIN (SELECT doc, id, count(*) AS n FROM lc GROUP BY ALL) a ON a.doc = common.doc AND a.id = left_id
  JOIN (SELECT doc, id, count(*) AS n FROM rc GROUP BY ALL) b ON b.doc = common.doc AND b.id = right_id),
ord AS (SELECT *, row_number() OVER (PARTITION BY doc, left_id ORDER BY s DESC, right_id) AS turn FROM jac)
SELECT doc, left_id, max(CASE WHEN turn = 1 AND s >= {M.CONTENT_MATCH} THEN right_id END) AS right_id, round(max(s), 6) AS best, round(coalesce(max(CASE WHEN turn = 2 THEN s END), 0), 6) AS second FROM ord GROUP BY doc, left_id"""

ORACLE = {
    "document_pages": f"WITH {_PAGES} SELECT * FROM pages",
    "md_structure": f"WITH {_PAGES}, {_structure('pages')} SELECT * FROM hs",
    "chunk_rows": _CHUNKS,
    "md_images": """SELECT asset_id, 1 AS n, coalesce(caption, '') AS caption, image_path, 2 AS md_line FROM assets WHERE asset_type = 'image' AND image_path IS NOT NULL""",
    "table_content_match": _MATCH,
    "link_assets": f"""WITH a AS (SELECT asset_id, {_key('document_id')} AS doc, caption, image_path FROM assets), c AS (SELECT chunk_id, {_key('document_id')} AS doc, text FROM search_results WHERE chunk_id IS NOT NULL)
SELECT DISTINCT asset_id, chunk_id FROM a JOIN c USING (doc) WHERE (caption <> '' AND contains(text, caption)) OR (image_path <> '' AND contains(text, image_path))""",
}
