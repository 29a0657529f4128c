"""Queries on answers and questions. Answers are drawn from each query's best results, with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.folding import reference_key
from skein.functions.text import IMAGE_CAPTION, TABLE_CAPTION
from skein.operators import answers as A
from skein.operators.retrieval import FINAL, top_k
from skein.plans.asset_queries import _NUMBER
from skein.plans.orphan_queries import _key
from skein.session import table


def _best(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return top_k(table(spark, folder, "search_results").drop("rank"), "query_id", [F.desc_nulls_last("score"), F.asc("result_id")], k)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """An answer for each query: the beginnings of its three best results, each with its clause and its first reference cited."""
    rows = _best(spark, folder, 3).where("document_id IS NOT NULL AND section_path IS NOT NULL AND text IS NOT NULL")
    said = F.trim(F.substring(F.regexp_replace("text", r"[^А-Яа-яЁё0-9 ]+", " "), 1, 60))
    clause = F.concat(F.lit("["), F.col("document_id"), F.lit(", п. "), F.element_at(F.split("section_path", " → "), -1), F.lit("]"))
    table_number = F.regexp_extract(F.array_join("references", "; "), r"табл\. ?([0-9]+(?:\.[0-9]+)*)", 1)
    more = F.when(table_number != "", F.concat(F.lit(" ["), F.col("document_id"), F.lit(", табл. "), table_number, F.lit("]"))).otherwise("")
    parts = rows.select("query_id", "rank", F.concat(said, F.lit(": "), clause, more, F.lit(".")).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy("query_id").agg(joined.alias("answer"))


def cited_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each answer cites in brackets, and how many citations it has."""
    return answers(spark, folder).select("query_id", A.has_citations(F.col("answer")).alias("cites"), F.size(A.citations(F.col("answer"))).alias("n_citations"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return answers(spark, folder).select("query_id", F.posexplode(A.citations(F.col("answer"))).alias("pos", "c")).select("query_id", "pos", "c.document", "c.kind", "c.number")


def citation_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that each answer's citations mean, of clauses and of tables."""
    return A.matched_citations(citations(spark, folder), table(spark, folder, "search_results"), table(spark, folder, "assets"))


def list_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that ask which documents there are; every fifth is put as such a question, so that there are some."""
    asked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Какие нормативные документы регламентируют: "), F.col("text"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Какие нормативы есть? "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", A.asks_for_documents(asked).alias("asks"))


def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The value k of each event's properties, given bare, in a fence, in prose or broken."""
    props, way = F.col("props"), F.pmod("event_id", F.lit(4))
    told = F.when(way == 0, props).when(way == 1, F.concat(F.lit("Вот:\n```json\n"), props, F.lit("\n```\n"))).when(way == 2, F.concat(F.lit("Ответ: "), props, F.lit(" — так."))).otherwise(F.replace(props, F.lit(":"), F.lit("")))
    return table(spark, folder, "events").select("event_id", F.get_json_object(A.json_object(told), "$.k").cast("bigint").alias("k"))


def targeted_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the first table or image that a result's text names, its document named in front of every second text."""
    text = F.when(F.col("result_id") % 2 == 0, F.concat_ws(" ", "document_id", "text")).otherwise(F.col("text"))
    return A.targeted_chunks(table(spark, folder, "search_results").select(F.col("result_id").alias("id"), text.alias("text")), table(spark, folder, "assets"))


def named_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Registered documents that a text of the corpus names in full or by a beginning."""
    known = table(spark, folder, "registry").select(reference_key(F.col("document_id")).alias("document"))
    return A.named_documents(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), known)


def formatted_results(spark: SparkSession, folder: str) -> DataFrame:
    return A.formatted(_best(spark, folder, FINAL), "query_id", "rank")


QUERIES = {f.__name__: f for f in (answers, cited_answers, citations, citation_chunks, list_requests, json_answers, targeted_chunks, named_documents, formatted_results)}

_TOP = """SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) AS rank FROM search_results) WHERE rank <= {}"""
_ANSWERS = f"""answers AS (SELECT query_id, string_agg(trim(substring(regexp_replace(text, '[^А-Яа-яЁё0-9 ]+', ' ', 'g'), 1, 60)) || ': [' || document_id || ', п. ' || string_split(section_path, ' → ')[-1] || ']'
  || CASE WHEN t <> '' THEN ' [' || document_id || ', табл. ' || t || ']' ELSE '' END || '.', chr(10) ORDER BY rank) AS answer
  FROM (SELECT *, coalesce(regexp_extract(array_to_string("references", '; '), 'табл\\. ?([0-9]+(?:\\.[0-9]+)*)', 1), '') AS t FROM ({_TOP.format(3)})) WHERE document_id IS NOT NULL AND section_path IS NOT NULL AND text IS NOT NULL GROUP BY query_id)"""
_CITATIONS = f"""c AS (SELECT query_id, unnest(range(0, len(a)))::INT AS pos, trim(unnest(a)) AS document, unnest(k) AS kind, unnest(n) AS number FROM (
  SELECT query_id, regexp_extract_all(answer, '{A.CITATION}', 1) AS a, regexp_extract_all(answer, '{A.CITATION}', 2) AS k, regexp_extract_all(answer, '{A.CITATION}', 3) AS n FROM answers))"""


def _refs(kind: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all(text, '{pattern.replace('(?iu)', '(?i)')}', 1), lambda x: {{'asset_type': '{kind}', 'number': lower(x)}})"


def _named(texts: str, documents: str) -> str:
    return rf"""SELECT DISTINCT id, document FROM (SELECT DISTINCT id, regexp_replace({_key('name')}, '[.\-]+$', '') AS name FROM (SELECT id, unnest(regexp_extract_all(text, '(?i){A.DESIGNATION}')) AS name FROM ({texts}))) q
  JOIN (SELECT DISTINCT document FROM ({documents}) WHERE document IS NOT NULL) k ON k.document = q.name OR (starts_with(k.document, q.name) AND regexp_matches(substring(k.document, length(q.name) + 1), '^(?:[.\-][0-9]+)+$'))"""


ORACLE = {
    "answers": f"WITH {_ANSWERS} SELECT * FROM answers",
    "cited_answers": f"WITH {_ANSWERS} SELECT query_id, regexp_matches(answer, '{A.BRACKETED}') AS cites, len(regexp_extract_all(answer, '{A.CITATION}', 1))::INT AS n_citations FROM answers",
    "citations": f"WITH {_ANSWERS}, {_CITATIONS} SELECT * FROM c",
    "citation_chunks": f"""WITH {_ANSWERS}, {_CITATIONS}, q AS (SELECT DISTINCT query_id, {_key('document')} AS named, starts_with(kind, 'табл') AS is_table, number FROM c WHERE {_key('document')} IS NOT NULL),
r AS (SELECT query_id, chunk_id, rank, result_id, {_key('document_id')} AS held, rtrim(section_path) AS path FROM search_results WHERE document_id IS NOT NULL)
SELECT DISTINCT query_id, chunk_id FROM (SELECT q.query_id, first(r.chunk_id ORDER BY r.rank, r.result_id) AS chunk_id FROM q JOIN r ON r.query_id = q.query_id AND NOT is_table AND (contains(held, named) OR contains(named, held)) AND ends_with(path, number) GROUP BY q.query_id, named, number
  UNION ALL SELECT q.query_id, unnest(t.chunk_ids) FROM q JOIN (SELECT {_key('document_id')} AS named, caption, first(chunk_ids ORDER BY asset_id) AS chunk_ids FROM assets WHERE asset_type = 'table' GROUP BY 1, 2) t ON is_table AND t.named = q.named AND t.caption = 'Таблица ' || q.number)
WHERE chunk_id IS NOT NULL""",
    "list_requests": "WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Какие нормативные документы регламентируют: ' || text WHEN 1 THEN 'Какие нормативы есть? ' || text ELSE text END AS text FROM documents) SELECT doc_id, coalesce("
    + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in A.LIST_REQUESTS)
    + f" OR len(regexp_extract_all(text, '(?i){A.WHICH}')) > len(regexp_extract_all(text, '(?i){A.WHICH_CONTENT}')), false) AS asks FROM q",
    "json_answers": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "targeted_chunks": f"""WITH q AS (SELECT result_id AS id, CASE WHEN result_id % 2 = 0 THEN concat_ws(' ', document_id, text) ELSE text END AS text FROM search_results WHERE text IS NOT NULL OR result_id % 2 = 0),
a AS (SELECT id, r.asset_type, r.number FROM (SELECT id, ({_refs('table', TABLE_CAPTION)} || {_refs('image', IMAGE_CAPTION)})[1] AS r FROM q) WHERE r IS NOT NULL),
n AS (SELECT {_key('document_id')} AS document, asset_type, {_NUMBER} AS number, chunk_ids FROM assets WHERE document_id IS NOT NULL AND {_NUMBER} IS NOT NULL),
h AS (SELECT DISTINCT document, asset_type, number FROM n), s AS (SELECT asset_type, number, count(*) AS c, min(document) AS only_one FROM h GROUP BY ALL),
d AS ({_named('SELECT * FROM q', 'SELECT document FROM h')}),
o AS (SELECT a.id, count(*) AS n_named, min(h.document) AS named FROM a JOIN d ON d.id = a.id JOIN h ON h.document = d.document AND h.asset_type = a.asset_type AND h.number = a.number GROUP BY a.id),
f AS (SELECT a.*, CASE WHEN c = 1 THEN only_one WHEN n_named = 1 THEN named END AS document FROM a JOIN s USING (asset_type, number) LEFT JOIN o USING (id))
SELECT DISTINCT id, asset_type, number, document, unnest(chunk_ids) AS chunk_id FROM f JOIN n USING (document, asset_type, number)""",
    "named_documents": _named("SELECT doc_id AS id, text FROM documents", f"SELECT {_key('document_id')} AS document FROM registry"),
    "formatted_results": f"""SELECT query_id, string_agg('[' || rank || '] ' || d || CASE WHEN section_path <> '' THEN ' | ' || section_path ELSE '' END || ' | score: ' || printf('%.4f', coalesce(score, 0.0))
  || CASE WHEN p <> '' THEN chr(10) || '   ' || p ELSE '' END || CASE WHEN trim(text) <> '' THEN chr(10) || '   ' || trim(text) ELSE '' END || chr(10) || '   (источник: ' || coalesce(nullif(title, ''), d) || ')', chr(10) || chr(10) ORDER BY rank) AS prompt
  FROM (SELECT *, coalesce(nullif(document_id, ''), '—') AS d, coalesce(array_to_string(list_filter([heading_texts.chapter, heading_texts.section, heading_texts.clause], lambda x: trim(x) <> ''), ' → '), '') AS p FROM ({_TOP.format(6)})) GROUP BY query_id""",
}
