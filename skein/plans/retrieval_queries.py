"""Retrieval queries: two rankings, fusion, threshold, rerank, shape, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.session import table


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.dense_top_k(vectors, vectors.where("id % 50 = 0")).withColumn("score", F.round("score", 5))


def sparse_topk(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.sparse_top_k(texts, texts.where("id % 50 = 0")).withColumn("score", F.round("score", 5))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_results")


def _rankings(results: DataFrame) -> list[DataFrame]:
    return [R.top_k(results.select("query_id", "result_id", c), "query_id", [F.desc_nulls_last(c), F.asc("result_id")], R.RETRIEVE) for c in ("score", "rrf_score")]


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return R.fuse(_rankings(_results(spark, folder)), "query_id", "result_id")


def rrf_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return R.pass_threshold_or_all(rrf_fusion(spark, folder), "query_id", "rrf_score")


def payload_filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """The filter comes before the ranking and reaches the scan."""
    kept = _results(spark, folder).where("domain = 'electrical' AND document_type = 'СП'")
    return R.fuse(_rankings(kept), "query_id", "result_id", R.FINAL)


def rerank_final(spark: SparkSession, folder: str) -> DataFrame:
    """Second stage: only what the first stage kept is scored against the text of the query's best hit."""
    results = _results(spark, folder)
    first = R.pass_threshold_or_all(R.fuse(_rankings(results), "query_id", "result_id"), "query_id", "rrf_score")
    asked = results.groupBy("query_id").agg(F.min_by("title", F.struct(-F.col("score"), "result_id")).alias("question"))
    texts = first.select("query_id", "result_id", "rrf_score").join(results.select("result_id", "text"), "result_id").join(asked, "query_id")
    scored = texts.select("query_id", "result_id", "rrf_score", F.round(R.lexical_overlap(F.coalesce("question", F.lit("")), F.col("text")), 6).alias("rerank_score"))
    return R.top_k(scored, "query_id", [F.desc("rerank_score"), F.desc("rrf_score"), F.asc("result_id")], R.FINAL)


def quality_and_route(spark: SparkSession, folder: str) -> DataFrame:
    best = _results(spark, folder).groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n_results"))
    return best.select("query_id", "best", "n_results", R.quality_label(F.col("best")).alias("quality"), R.route(F.col("best"), F.lit(0)).alias("first_step"), R.route(F.col("best"), F.lit(2)).alias("last_step"))


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    name = R.source_name(F.col("title"), F.col("document_id"))
    return _results(spark, folder).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set(name)), "; ").alias("sources"))


def dedup_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = _results(spark, folder).select("query_id", "result_id", "rank", "document_id", "title")
    return R.first_per_source(rows, "query_id", [F.asc("rank"), F.asc("result_id")])


def result_shape(spark: SparkSession, folder: str) -> DataFrame:
    h = "heading_texts"
    path = F.array_join(F.filter(F.array(f"{h}.chapter", f"{h}.section", f"{h}.clause"), lambda x: x != ""), " → ")
    asset = F.transform("assets", lambda a: F.concat_ws("|", a["asset_type"], a["caption"], a["image_path"], F.concat_ws(",", a["image_paths"]), a["asset_id"]))
    return _results(spark, folder).select(
        "result_id",
        "rank",
        *("chunk_id", "document_id", "document_type", "domain", "title", "status", "section_path", "text"),
        F.array_join(F.coalesce("references", F.array().cast("array<string>")), "; ").alias("references"),
        F.coalesce(F.array_join(asset, "; "), F.lit("")).alias("assets"),
        R.source_name(F.col("title"), F.col("document_id")).alias("source"),
        F.round("score", 4).alias("score"),
        F.round("rrf_score", 4).alias("rrf_score"),
        R.quality_label(F.col("score")).alias("quality"),
        F.coalesce(path, F.lit("")).alias("headings"),
        F.size(F.coalesce("assets", F.array().cast("array<struct<asset_type:string,caption:string,image_path:string,image_paths:array<string>,asset_id:string>>"))).alias("n_assets"),
    )


def documents_in_base(spark: SparkSession, folder: str) -> DataFrame:
    return R.documents_in_base(_results(spark, folder), "result_id")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents_in_base(spark, folder).select("document_id", R.source_name(F.col("title"), F.col("document_id")).alias("name"))


def delete_document_preview(spark: SparkSession, folder: str) -> DataFrame:
    """What a reload of each registered document would delete first."""
    ids = table(spark, folder, "registry").where("document_id IS NOT NULL").select("document_id").distinct()
    rows = _results(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return ids.join(rows, "document_id", "left").select("document_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def top_documents_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The three best results of each query as one prompt: source and the first 200 characters."""
    rows = R.top_k(_results(spark, folder).select("query_id", "result_id", "score", "title", "document_id", "text"), "query_id", [F.desc_nulls_last("score"), F.asc("result_id")], 3)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), R.source_name(F.col("title"), F.col("document_id")), F.lit(": "), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \n\t]+", " "), 1, 200))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"))


QUERIES = {
    f.__name__: f
    for f in (dense_topk, sparse_topk, rrf_fusion, rrf_filtered, payload_filtered_search, rerank_final, quality_and_route, source_names)
    + (dedup_sources, result_shape, documents_in_base, list_documents, delete_document_preview, top_documents_summary)
}


def _fused(where: str = "TRUE", k: int = 30) -> str:
    return f"""kept AS (SELECT * FROM search_results WHERE {where}),
ranked AS (SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) AS a,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, result_id) AS b FROM kept),
sums AS (SELECT query_id, result_id, round(CASE WHEN a <= 30 THEN 1.0::DOUBLE / (a + 1) ELSE 0 END + CASE WHEN b <= 30 THEN 1.0::DOUBLE / (b + 1) ELSE 0 END, 6) AS rrf_score
  FROM ranked WHERE a <= 30 OR b <= 30),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, result_id) AS rank FROM sums) WHERE rank <= {k}),
passed AS (SELECT query_id, result_id, rrf_score, rank FROM (SELECT *, max(rrf_score) OVER (PARTITION BY query_id) AS best FROM fused) WHERE rrf_score >= 0.15 OR best < 0.15)"""


_NAME = "coalesce(nullif(title, ''), nullif(document_id, ''), 'unknown')"
_QUALITY = "CASE WHEN {0} >= 0.78 THEN 'точное' WHEN {0} >= 0.72 THEN 'хорошее' ELSE 'среднее' END"
_TF = "n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / 256.0))"


def _terms(name: str, key: str) -> str:
    return f"""SELECT {key}, term, {_TF} AS w FROM (SELECT {key}, term, count(*)::DOUBLE AS n, max(len)::DOUBLE AS len FROM (
    SELECT {key}, unnest(words) AS term, len(words) AS len FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM {name})) GROUP BY ALL)"""


ORACLE = {
    "dense_topk": """SELECT query_id, id, round(s, 5) AS score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 30""",
    "sparse_topk": f"""WITH d AS ({_terms('documents', 'doc_id')}), q AS ({_terms('(SELECT * FROM documents WHERE doc_id % 50 = 0)', 'doc_id')}),
s AS (SELECT q.doc_id AS query_id, d.doc_id AS id, sum(d.w * q.w) AS score FROM d JOIN q USING (term) GROUP BY ALL)
SELECT query_id, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 30""",
    "rrf_fusion": f"WITH {_fused()} SELECT query_id, result_id, rrf_score, rank FROM fused",
    "rrf_filtered": f"WITH {_fused()} SELECT * FROM passed",
    "payload_filtered_search": f"""WITH {_fused("domain = 'electrical' AND document_type = 'СП'", 6)} SELECT query_id, result_id, rrf_score, rank FROM fused""",
    "rerank_final": f"""WITH {_fused()}, asked AS (SELECT query_id, coalesce(title, '') AS question FROM (
  SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY -score NULLS FIRST, result_id) AS r FROM search_results) WHERE r = 1),
w AS (SELECT query_id, result_id, p.rrf_score, list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS q,
  list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM passed p JOIN search_results USING (query_id, result_id) JOIN asked USING (query_id)),
s AS (SELECT query_id, result_id, rrf_score, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t))::DOUBLE / len(q), 6) ELSE 0.0 END AS rerank_score FROM w)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, result_id) AS rank FROM s) WHERE rank <= 6""",
    "quality_and_route": f"""SELECT query_id, max(score) AS best, count(*) AS n_results, {_QUALITY.format('max(score)')} AS quality,
  CASE WHEN max(score) > 0.7 THEN 'answer' WHEN max(score) >= 0.4 THEN 'reformulate' ELSE 'clarify' END AS first_step,
  CASE WHEN max(score) > 0.7 THEN 'answer' ELSE 'clarify' END AS last_step FROM search_results GROUP BY query_id""",
    "source_names": f"SELECT query_id, array_to_string(list_sort(list(DISTINCT {_NAME})), '; ') AS sources FROM search_results GROUP BY query_id",
    "dedup_sources": """SELECT query_id, result_id, rank, document_id, title FROM (SELECT *, coalesce(nullif(document_id, ''), lower(nullif(title, ''))) AS k,
  row_number() OVER (PARTITION BY query_id, coalesce(nullif(document_id, ''), lower(nullif(title, ''))) ORDER BY rank, result_id) AS r FROM search_results) WHERE r = 1 OR k IS NULL""",
    "result_shape": f"""SELECT result_id, rank, chunk_id, document_id, document_type, domain, title, status, section_path, text, coalesce(array_to_string("references", '; '), '') AS "references",
  coalesce(array_to_string(list_transform(assets, lambda a: concat_ws('|', a.asset_type, a.caption, a.image_path, coalesce(array_to_string(a.image_paths, ','), ''), a.asset_id)), '; '), '') AS assets, {_NAME} AS source, round(score, 4) AS score, round(rrf_score, 4) AS rrf_score, {_QUALITY.format('score')} AS quality,
  coalesce(array_to_string(list_filter([heading_texts.chapter, heading_texts.section, heading_texts.clause], lambda x: x <> ''), ' → '), '') AS headings,
  coalesce(len(assets), 0) AS n_assets FROM search_results""",
    "documents_in_base": """SELECT document_id, first(title ORDER BY result_id) AS title, first(document_type ORDER BY result_id) AS document_type, first(domain ORDER BY result_id) AS domain,
  first(status ORDER BY result_id) AS status, count(*) AS n_rows FROM search_results WHERE document_id IS NOT NULL GROUP BY document_id""",
    "list_documents": """SELECT document_id, coalesce(nullif(first(title ORDER BY result_id), ''), nullif(document_id, ''), 'unknown') AS name
  FROM search_results WHERE document_id IS NOT NULL GROUP BY document_id""",
    "delete_document_preview": """SELECT r.document_id, count(s.result_id) AS n_rows FROM (SELECT DISTINCT document_id FROM registry WHERE document_id IS NOT NULL) r
  LEFT JOIN search_results s ON s.document_id = r.document_id GROUP BY r.document_id""",
    "top_documents_summary": f"""SELECT query_id, string_agg(rank || '. ' || {_NAME} || ': ' || substring(regexp_replace(coalesce(text, ''), '[ \\n\\t]+', ' ', 'g'), 1, 200), chr(10) ORDER BY rank) AS summary
  FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) AS rank FROM search_results) WHERE rank <= 3 GROUP BY query_id""",
}
