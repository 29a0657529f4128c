"""Queries on index rows, document mentions, figure order and landmarks of scanned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.folding import reference_key
from skein.operators.structure import token_count
from skein.plans.orphan_queries import _key
from skein.session import table

_DESIGNATION = r"(?:ГОСТ Р|ГОСТ|СП|СО|СНиП|ПУЭ|РД) ?[0-9][0-9.\-—–]*[0-9]"


def _latest_registry(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc_nulls_last("loaded_at"), F.desc("rec_id")))
    return table(spark, folder, "registry").where("doc_key IS NOT NULL").withColumn("turn", turn).where("turn = 1").drop("turn")


def document_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Registered documents that a scanned block names by designation, in any spelling."""
    found = table(spark, folder, "ocr_blocks").select("block_id", F.explode(F.regexp_extract_all("text", F.lit(_DESIGNATION), F.lit(0))).alias("named"))
    names = _latest_registry(spark, folder).select(reference_key(F.col("document_id")).alias("key"), "doc_key").where("key IS NOT NULL")
    return found.select("block_id", reference_key(F.col("named")).alias("key")).distinct().join(names, "key").select("block_id", "doc_key")


def asset_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Each asset with the title and status of its document's latest record; the record may be missing."""
    records = _latest_registry(spark, folder).select(F.col("doc_key").alias("slug"), "title", "status")
    rows = table(spark, folder, "assets").withColumn("slug", F.substring_index("asset_id", "/", 1))
    return rows.join(records, "slug", "left").select("asset_id", "asset_type", "caption", "title", "status")


def payload_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Captions of a result's assets in order, resolved against the assets; unknown ids fall away."""
    known = table(spark, folder, "assets").groupBy("asset_id").agg(F.max("caption").alias("known_caption"))
    used = table(spark, folder, "search_results").select("result_id", F.posexplode("assets").alias("pos", "a")).select("result_id", "pos", "a.asset_id")
    held = used.join(known, "asset_id").groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct("pos", "asset_id", "known_caption"))).alias("held"))
    label = F.transform("held", lambda h: F.concat(h["asset_id"], F.lit("="), F.coalesce(h["known_caption"], F.lit("-"))))
    return held.select("result_id", F.size("held").alias("n_assets"), F.array_join(label, "; ").alias("held"))


def index_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as the index holds them: the chunk's fields, type and domain of its document's latest record, assets that exist, tokens and a place."""
    known = table(spark, folder, "assets").groupBy("asset_id").agg(F.lit(1).alias("there"))
    rows = table(spark, folder, "search_results")
    used = rows.select("result_id", F.posexplode("assets").alias("pos", "a")).select("result_id", "pos", "a.asset_id").join(known, "asset_id")
    used = used.groupBy("result_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "asset_id"))), lambda x: x["asset_id"]), "; ").alias("assets"))
    about = _latest_registry(spark, folder).select(reference_key(F.col("document_id")).alias("key"), "loaded_at", "rec_id", F.col("document_type").alias("known_type"), F.col("domain").alias("known_domain"))
    about = about.where("key IS NOT NULL").groupBy("key").agg(F.max_by("known_type", F.struct("loaded_at", "rec_id")).alias("document_type"), F.max_by("known_domain", F.struct("loaded_at", "rec_id")).alias("domain"))
    h = "heading_texts"
    rows = rows.select(
        "result_id", "chunk_id", "document_id", reference_key(F.col("document_id")).alias("key"), "title", "status", "section_path", f"{h}.chapter", f"{h}.section", f"{h}.clause", "text",
        F.array_join(F.coalesce("references", F.array().cast("array<string>")), "; ").alias("references"), token_count(F.col("text")).alias("chunk_tokens"),
    )
    return rows.join(about, "key", "left").join(used, "result_id", "left").drop("key").withColumn("assets", F.coalesce("assets", F.lit("")))


def figure_order(spark: SparkSession, folder: str) -> DataFrame:
    """Images of each document renumbered by the number in their name; other names come last."""
    number = F.try_element_at(F.regexp_extract_all("asset_id", F.lit(r"fig_([0-9]+)$"), F.lit(1)), F.lit(1)).try_cast("int")
    images = table(spark, folder, "assets").where("asset_type = 'image'").select("asset_id", F.substring_index("asset_id", "/", 1).alias("slug"), number.alias("number"))
    order = Window.partitionBy("slug").orderBy(F.asc_nulls_last("number"), F.asc("asset_id"))
    return images.select("asset_id", F.row_number().over(order).alias("figure"))


def rare_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The first three long words of each scanned block."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}{9,}"), F.lit(0))
    return table(spark, folder, "ocr_blocks").select("block_id", F.array_join(F.slice(words, 1, 3), " ").alias("tokens"))


def landmark_edges(spark: SparkSession, folder: str) -> DataFrame:
    """First and last six words of each block that has at least twelve: what must survive any rendering."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = table(spark, folder, "ocr_blocks").select("block_id", words.alias("w")).where(F.size("w") >= 12)
    return rows.select("block_id", F.array_join(F.slice("w", 1, 6), " ").alias("head"), F.array_join(F.slice("w", -6, 6), " ").alias("tail"))


QUERIES = {f.__name__: f for f in (document_mentions, asset_registry, payload_rows, index_rows, figure_order, rare_tokens, landmark_edges)}

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS turn FROM registry WHERE doc_key IS NOT NULL) WHERE turn = 1)"

ORACLE = {
    "document_mentions": f"""WITH {_LATEST}, f AS (SELECT DISTINCT block_id, {_key('named')} AS key FROM (SELECT block_id, unnest(regexp_extract_all(text, '{_DESIGNATION}')) AS named FROM ocr_blocks))
SELECT block_id, doc_key FROM f JOIN latest ON {_key('document_id')} = f.key""",
    "asset_registry": f"WITH {_LATEST} SELECT asset_id, asset_type, caption, title, status FROM assets LEFT JOIN latest ON latest.doc_key = split_part(asset_id, '/', 1)",
    "payload_rows": """WITH u AS (SELECT result_id, a.asset_id, pos FROM (SELECT result_id, unnest(assets) AS a, generate_subscripts(assets, 1) AS pos FROM search_results)),
k AS (SELECT asset_id, max(caption) AS caption FROM assets GROUP BY asset_id)
SELECT result_id, count(*)::INT AS n_assets, string_agg(asset_id || '=' || coalesce(caption, '-'), '; ' ORDER BY pos) AS held FROM u JOIN k USING (asset_id) GROUP BY result_id""",
    "index_rows": f"""WITH {_LATEST}, about AS (SELECT {_key('document_id')} AS key, first(document_type ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS document_type, first(domain ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS domain FROM latest WHERE {_key('document_id')} IS NOT NULL GROUP BY 1),
used AS (SELECT result_id, string_agg(asset_id, '; ' ORDER BY pos) AS assets FROM (SELECT result_id, a.asset_id, pos FROM (SELECT result_id, unnest(assets) AS a, generate_subscripts(assets, 1) AS pos FROM search_results)) WHERE asset_id IN (SELECT asset_id FROM assets) GROUP BY result_id)
SELECT s.result_id, chunk_id, document_id, title, status, section_path, heading_texts.chapter AS chapter, heading_texts.section AS section, heading_texts.clause AS clause, text, coalesce(array_to_string("references", '; '), '') AS "references",
  greatest(1, floor(length(text) / 3.5)::INT) AS chunk_tokens, about.document_type, about.domain, coalesce(used.assets, '') AS assets FROM search_results s LEFT JOIN about ON about.key = {_key('s.document_id')} LEFT JOIN used ON used.result_id = s.result_id""",
    "figure_order": """SELECT asset_id, row_number() OVER (PARTITION BY split_part(asset_id, '/', 1) ORDER BY try_cast(nullif(regexp_extract(asset_id, 'fig_([0-9]+)$', 1), '') AS INT) NULLS LAST, asset_id) AS figure
  FROM assets WHERE asset_type = 'image'""",
    "rare_tokens": r"SELECT block_id, array_to_string(list_slice(regexp_extract_all(text, '\p{L}{9,}'), 1, 3), ' ') AS tokens FROM ocr_blocks",
    "landmark_edges": r"""WITH w AS (SELECT block_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM ocr_blocks)
SELECT block_id, array_to_string(w[1:6], ' ') AS head, array_to_string(w[len(w) - 5:len(w)], ' ') AS tail FROM w WHERE len(w) >= 12""",
}
