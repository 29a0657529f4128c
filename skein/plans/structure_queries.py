"""Queries on headings, chunks, text functions and the document registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.folding import BLANKS
from skein.operators import markdown as M
from skein.operators import structure as S
from skein.session import table

_ORDER = ["line_num", "heading_id"]


def _headings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "md_headings").where("doc_key IS NOT NULL")


def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each heading with the line of the next one."""
    following = F.lead("line_num").over(Window.partitionBy("doc_key").orderBy(*_ORDER))
    return _headings(spark, folder).select("heading_id", "doc_key", "line_num", following.alias("next_line"))


def heading_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.with_ancestors(_headings(spark, folder), "doc_key", _ORDER)
    return rows.select("heading_id", "level", "chapter", "section", "clause", "chapter_text", "section_text", "clause_text", S.section_path().alias("section_path"))


def ignored_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Headings left when general provisions and safety sections are passed over."""
    names = F.array(F.lit("Общие положения"), F.lit("безопасность"))
    return S.without_ignored(_headings(spark, folder), "doc_key", _ORDER, names).select("heading_id", "doc_key", "level", "heading_text")


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return S.chunk_ids(_headings(spark, folder), "doc_key", _ORDER).select("heading_id", "chunk_id")


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_results")


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("result_id", S.token_count(F.col("text")).alias("n_tokens"))


def packed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Atomic blocks packed into parts of at most 200 tokens: a limit of 400, less 200 for what is put before a part."""
    parts = _results(spark, folder).select("result_id", F.posexplode(M.parts(F.col("text"), 400 - M.OVERHEAD)).alias("part", "piece"))
    return parts.select("result_id", (F.col("part") + 1).alias("part"), "piece", S.token_count(F.col("piece")).alias("n_tokens"))


def text_references(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("result_id", F.array_join(T.references(F.col("text")), "; ").alias("found"))


def asset_references(spark: SparkSession, folder: str) -> DataFrame:
    found = _results(spark, folder).select("result_id", F.posexplode(T.asset_references(F.col("text"))).alias("pos", "x"))
    return found.select("result_id", "x.asset_type", "x.number").distinct()


def table_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("result_id", F.inline(T.table_spans(F.col("text"))))


def cell_sets(spark: SparkSession, folder: str) -> DataFrame:
    cells = T.cell_set(F.col("text"))
    return _results(spark, folder).select("result_id", F.size(cells).alias("n_cells"), F.array_join(F.array_sort(cells), "|").alias("cells")).where("n_cells > 0")


def stripped_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("result_id", T.without_tables(F.col("text")).alias("text"))


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).where("chunk_id IS NOT NULL").select("result_id", T.point_id(F.col("chunk_id"), F.col("result_id")).alias("point_id"))


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    h = "heading_texts"
    path = F.array_join(F.filter(F.array(f"{h}.chapter", f"{h}.section", f"{h}.clause"), lambda x: x != ""), S.ARROW)
    label = lambda a: F.concat(F.when(a["asset_type"] == "table", "Таблица: ").otherwise("Рисунок: "), a["caption"])
    captions = F.transform(F.filter(F.coalesce("assets", F.array().cast("array<struct<asset_type:string,caption:string,image_path:string,image_paths:array<string>,asset_id:string>>")), lambda a: a["caption"] != ""), label)
    made = T.embedding_text(F.col("document_id"), F.col("title"), F.col("domain"), path, F.col("text"), captions)
    return _results(spark, folder).select("result_id", made.alias("embedding_text"))


def registry_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """The record of each doc_key that was loaded last."""
    last = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc_nulls_last("loaded_at"), F.desc("rec_id")))
    return table(spark, folder, "registry").withColumn("turn", last).where("turn = 1").select("doc_key", "rec_id", "document_id", "status", "title")


def registry_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields read from each record; documents with the same slug are told apart by a number, in order of their first record."""
    d = F.col("document_id")
    rows = table(spark, folder, "registry").select("rec_id", d, "date_enacted", T.slug(d).alias("base"))
    rows = rows.withColumn("first", F.min("rec_id").over(Window.partitionBy("document_id")))
    turn = F.dense_rank().over(Window.partitionBy("base").orderBy("first"))
    return rows.select(
        "rec_id",
        T.normal_date(F.col("date_enacted")).alias("date_enacted"),
        T.document_type(d).alias("type_of_id"),
        T.edition(d).alias("edition_of_id"),
        F.when(turn == 1, F.col("base")).otherwise(F.concat_ws("_", "base", turn.cast("string"))).alias("slug"),
    )


def registry_validation(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each record, one row per fault."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    faults = [F.when(blank(c), f"no {c}") for c in ("document_id", "document_type", "domain", "title", "edition", "date_enacted", "status")]
    for c in ("date_enacted", "date_amended"):
        good = F.coalesce(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull(), F.lit(False))
        faults.append(F.when(~good & ~blank(c), f"bad {c}"))
    faults.append(F.when((F.col("status") == "active") & F.col("replaced_by_document_id").isNotNull(), "active but replaced"))
    return table(spark, folder, "registry").select("rec_id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


QUERIES = {
    f.__name__: f
    for f in (heading_lines, heading_ancestors, ignored_sections, chunk_ids, token_counts, packed_parts, text_references, asset_references)
    + (table_spans, cell_sets, stripped_tables, point_ids, embed_text, registry_overlay, registry_fields, registry_validation)
}

_H = "SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY line_num, heading_id) - 1 AS pos FROM md_headings WHERE doc_key IS NOT NULL"
_N = r"(?:[A-Za-zА-Яа-яЁё]\.)?\d+(?:\.\d+)*"


def _found(label: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}]){pattern}{T.ANY_BLANKS}({_N})', 1), lambda x: '{label} ' || x)"


def _assets(kind: str, words: str) -> str:
    return f"SELECT result_id, '{kind}' AS asset_type, lower(unnest(regexp_extract_all(text, '(?i)(?:{words}){T.ANY_BLANKS}({_N})', 1))) AS number FROM search_results"


def _slug(c: str) -> str:
    out = f"translate(coalesce({c}, ''), '{T.SLUG_ONE}{T.SLUG_ONE.upper()}', '{T.SLUG_AS}{T.SLUG_AS.upper()}')"
    for a, b in T.SLUG_MORE.items():
        out = f"replace(replace({out}, '{a}', '{b}'), '{a.upper()}', '{b.capitalize()}')"
    return f"coalesce(nullif(regexp_replace(regexp_replace({out}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'DOC')"


def atomic_sql(source: str, out: str) -> str:
    """CTEs up to ``out``: id, text and its atomic blocks as a list; source: id, text."""
    return rf"""{out}_l AS (SELECT id, text, unnest(x) AS line, unnest(range(0, len(x))) AS n FROM (SELECT id, text, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM ({source}))),
{out}_f AS (SELECT *, regexp_replace(line, '^\s+', '') AS bare, coalesce(sum(CASE WHEN starts_with(regexp_replace(line, '^\s+', ''), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS code FROM {out}_l),
{out}_k AS (SELECT *, CASE WHEN code = 1 OR starts_with(bare, '```') THEN 'code' WHEN starts_with(bare, '|') THEN 'table' WHEN bare = '' THEN 'none' ELSE 'text' END AS kind FROM {out}_f),
{out}_o AS (SELECT *, CASE WHEN kind = 'code' THEN 1 - code WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY id ORDER BY n) THEN 1 ELSE 0 END AS opens FROM {out}_k),
{out}_g AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY n) AS block_no FROM {out}_o),
{out}_b AS (SELECT id, text, block_no, string_agg(line, chr(10) ORDER BY n) AS block FROM {out}_g WHERE kind <> 'none' GROUP BY id, text, block_no),
{out} AS (SELECT id, text, list(block ORDER BY block_no) FILTER (WHERE block <> '') AS blocks FROM {out}_b GROUP BY id, text
  UNION ALL SELECT DISTINCT id, text, NULL::VARCHAR[] FROM {out}_l WHERE id NOT IN (SELECT id FROM {out}_b))"""


def packed_sql(blocks: str, out: str, limit: int) -> str:
    """CTEs up to ``out``: id, text, parts; the CTE ``blocks`` as atomic_sql makes it. Needs WITH RECURSIVE."""
    closed, fits = "CASE WHEN n > 0 THEN list_append(done, opened) ELSE done END", f"n > 0 AND n + 1 + z <= {limit}"
    return f"""{out}_r AS (SELECT id, text, coalesce(blocks, []) AS blocks, 1 AS i, []::VARCHAR[] AS done, '' AS opened, 0 AS n FROM {blocks}
  UNION ALL SELECT id, text, blocks, i + 1, CASE WHEN z > {limit} THEN list_append({closed}, block) WHEN {fits} THEN done ELSE {closed} END,
    CASE WHEN z > {limit} THEN '' WHEN {fits} THEN opened || chr(10) || chr(10) || block ELSE block END, CASE WHEN z > {limit} THEN 0 WHEN {fits} THEN n + 1 + z ELSE z END
  FROM (SELECT *, blocks[i] AS block, greatest(1, floor(length(blocks[i]) / 3.5)::INT) AS z FROM {out}_r WHERE i <= len(blocks))),
{out} AS (SELECT id, text, CASE WHEN floor(length(text) / 3.5) <= {limit} OR len({closed}) = 0 THEN [text] ELSE {closed} END AS parts FROM {out}_r WHERE i = len(blocks) + 1)"""


_LAST = r"regexp_extract_all(document_id, '\d+')[-1]"
_BLANK = "coalesce(trim({0}) = '', true)"
_GOOD = "coalesce(regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_strptime({0}, '%Y-%m-%d') IS NOT NULL, false)"

ORACLE = {
    "heading_lines": "SELECT heading_id, doc_key, line_num, lead(line_num) OVER (PARTITION BY doc_key ORDER BY line_num, heading_id) AS next_line FROM md_headings WHERE doc_key IS NOT NULL",
    "heading_ancestors": f"""WITH h AS ({_H}), c AS (SELECT *, max(CASE WHEN level = 2 THEN pos END) OVER w AS cp FROM h WINDOW w AS (PARTITION BY doc_key ORDER BY pos)),
p AS (SELECT *, max(CASE WHEN level = 3 THEN pos END) OVER w AS sp, CASE WHEN number IS NOT NULL THEN pos ELSE max(CASE WHEN level >= 4 THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS kp FROM c WINDOW w AS (PARTITION BY doc_key, cp ORDER BY pos)),
j AS (SELECT p.heading_id, p.level, a.number AS chapter, s.number AS section, k.number AS clause, a.heading_text AS chapter_text, s.heading_text AS section_text, k.heading_text AS clause_text
  FROM p LEFT JOIN h a ON a.doc_key = p.doc_key AND a.pos = p.cp LEFT JOIN h s ON p.level >= 3 AND s.doc_key = p.doc_key AND s.pos = p.sp LEFT JOIN h k ON p.level >= 4 AND k.doc_key = p.doc_key AND k.pos = p.kp)
SELECT *, nullif(array_to_string(list_filter([chapter, section, clause], lambda x: x <> ''), ' → '), '') AS section_path FROM j""",
    "ignored_sections": f"""WITH h AS (SELECT *, contains(lower(heading_text), 'общие положения') OR contains(lower(heading_text), 'безопасность') AS ign FROM ({_H}))
SELECT heading_id, doc_key, level, heading_text FROM h WHERE NOT EXISTS (SELECT 1 FROM h i WHERE i.doc_key = h.doc_key AND coalesce(i.ign, false) AND i.pos <= h.pos AND NOT EXISTS (
  SELECT 1 FROM h e WHERE e.doc_key = h.doc_key AND NOT coalesce(e.ign, false) AND e.pos > i.pos AND e.pos <= h.pos AND e.level <= i.level))""",
    "chunk_ids": f"""WITH h AS ({_H}), r AS (SELECT heading_id, line_num, concat_ws('/', doc_key, coalesce(number, '_h' || (pos - coalesce((
  SELECT max(p.pos) FROM h p WHERE p.doc_key = h.doc_key AND p.pos < h.pos AND p.level < h.level), -1))::VARCHAR)) AS raw FROM h),
t AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY line_num, heading_id) AS n FROM r)
SELECT heading_id, CASE WHEN n = 1 THEN raw ELSE raw || '/occurrence_' || n END AS chunk_id FROM t""",
    "token_counts": "SELECT result_id, greatest(1, floor(length(text) / 3.5)::INT) AS n_tokens FROM search_results",
    "packed_parts": f"""WITH RECURSIVE {atomic_sql("SELECT result_id AS id, text FROM search_results WHERE text IS NOT NULL", "b")}, {packed_sql("b", "p", 200)}
SELECT id AS result_id, unnest(range(1, len(parts) + 1))::INT AS part, unnest(parts) AS piece, greatest(1, floor(length(unnest(parts)) / 3.5)::INT) AS n_tokens FROM p""",
    "text_references": f"""SELECT result_id, array_to_string(list_sort(list_distinct({_found('п.', 'п(?:ункт[а-яё]*|[.])')} || {_found('разд.', 'разд(?:ел[а-яё]*|[.])')} || {_found('табл.', 'табл(?:иц[а-яё]*|[.])')})), '; ') AS found FROM search_results""",
    "asset_references": f"""SELECT DISTINCT * FROM ({_assets('table', 'таблиц[\\p{L}\\p{N}_]*|табл\\.?|table')} UNION ALL {_assets('image', 'рисун[\\p{L}\\p{N}_]*|рис\\.?|fig(?:ure)?\\.?|изображени[\\p{L}\\p{N}_]*')})""",
    "table_spans": r"""WITH l AS (SELECT result_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM search_results),
r AS (SELECT result_id, n, n - row_number() OVER (PARTITION BY result_id ORDER BY n) AS run FROM l WHERE starts_with(ltrim(line), '|'))
SELECT result_id, min(n)::INT AS first_line, max(n)::INT AS last_line, (count(*) - 2)::INT AS n_rows FROM r GROUP BY result_id, run HAVING count(*) >= 3""",
    "cell_sets": r"""WITH l AS (SELECT result_id, unnest(string_split(text, chr(10))) AS line FROM search_results),
c AS (SELECT DISTINCT result_id, lower(trim(regexp_replace(translate(unnest(string_split(line, '|')), 'BLANKS*_$\', 'SPACES'), '\s+', ' ', 'g'))) AS cell FROM l WHERE starts_with(ltrim(line), '|'))
SELECT result_id, count(*)::INT AS n_cells, string_agg(cell, '|' ORDER BY cell) AS cells FROM c WHERE length(cell) > 1 AND NOT regexp_matches(cell, '^[-: ]+$') GROUP BY result_id""".replace("BLANKS", BLANKS).replace("SPACES", " " * len(BLANKS)),
    "stripped_tables": f"""SELECT result_id, regexp_replace(regexp_replace(text, '(?im){T.CAPTIONED_TABLE}', 'Таблица \\1 — {T.TABLE_SIGN}', 'g'), '(?m){T.PIPE_TABLE}', '(таблица — {T.TABLE_SIGN})', 'g') AS text FROM search_results""",
    "embed_text": """SELECT result_id, array_to_string(list_filter([coalesce(document_id, '') || '. ' || coalesce(title, '') || CASE WHEN domain <> '' THEN ' (' || domain || ')' ELSE '' END,
  coalesce(array_to_string(list_filter([heading_texts.chapter, heading_texts.section, heading_texts.clause], lambda x: x <> ''), ' → '), ''), coalesce(text, ''),
  CASE WHEN len(list_filter(assets, lambda a: a.caption <> '')) > 0 THEN 'Содержит: ' || array_to_string(list_transform(list_filter(assets, lambda a: a.caption <> ''),
    lambda a: CASE WHEN a.asset_type = 'table' THEN 'Таблица: ' ELSE 'Рисунок: ' END || a.caption), '; ') ELSE '' END], lambda p: trim(p) <> ''), chr(10) || chr(10)) AS embedding_text FROM search_results""",
    "point_ids": """SELECT result_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substring('89ab', ((('0x' || h[17:17])::INT & 3) + 1)::BIGINT, 1) || h[18:20], h[21:32]) AS point_id FROM (
  SELECT result_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id || '::' || result_id)) AS h FROM search_results WHERE chunk_id IS NOT NULL)""",
    "registry_overlay": """SELECT doc_key, rec_id, document_id, status, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS t FROM registry) WHERE t = 1""",
    "registry_fields": rf"""SELECT rec_id, strftime(try_strptime(CASE WHEN regexp_matches(date_enacted, '\d{{4}}-\d{{2}}-\d{{2}}') THEN regexp_extract(date_enacted, '\d{{4}}-\d{{2}}-\d{{2}}')
    WHEN regexp_matches(date_enacted, '\d{{2}}\.\d{{2}}\.\d{{4}}') THEN regexp_replace(regexp_extract(date_enacted, '\d{{2}}\.\d{{2}}\.\d{{4}}'), '(..).(..).(....)', '\3-\2-\1')
    WHEN regexp_matches(date_enacted, '\d{{2}}\.\d{{2}}\.\d{{2}}') THEN CASE WHEN regexp_extract(date_enacted, '\d{{2}}\.\d{{2}}\.(\d{{2}})', 1)::INT < 50 THEN '20' ELSE '19' END ||
      regexp_replace(regexp_extract(date_enacted, '\d{{2}}\.\d{{2}}\.\d{{2}}'), '(..).(..).(..)', '\3-\2-\1') END, '%Y-%m-%d'), '%Y-%m-%d') AS date_enacted,
  nullif(regexp_extract(document_id, '^(ГОСТ|СП|СО|СНиП|ПУЭ)', 1), '') AS type_of_id,
  CASE length({_LAST}) WHEN 4 THEN {_LAST} WHEN 2 THEN CASE WHEN {_LAST}::INT < 50 THEN '20' ELSE '19' END || {_LAST} END AS edition_of_id, 
  CASE WHEN turn = 1 THEN base ELSE base || '_' || turn END AS slug FROM (SELECT *, dense_rank() OVER (PARTITION BY base ORDER BY first) AS turn FROM (
    SELECT *, {_slug('document_id')} AS base, min(rec_id) OVER (PARTITION BY document_id) AS first FROM registry))""",
    "registry_validation": "SELECT rec_id, fault FROM (SELECT rec_id, unnest(list_filter(["
    + ", ".join(f"CASE WHEN {_BLANK.format(c)} THEN 'no {c}' END" for c in ("document_id", "document_type", "domain", "title", "edition", "date_enacted", "status"))
    + ", "
    + ", ".join(f"CASE WHEN NOT {_GOOD.format(c)} AND NOT {_BLANK.format(c)} THEN 'bad {c}' END" for c in ("date_enacted", "date_amended"))
    + ", CASE WHEN status = 'active' AND replaced_by_document_id IS NOT NULL THEN 'active but replaced' END], lambda x: x IS NOT NULL)) AS fault FROM registry)",
}
