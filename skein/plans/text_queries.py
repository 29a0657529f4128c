"""Queries on hybrid search, captions, clean-up, merging of registries and choice of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.folding import reference_key
from skein.operators.hybrid import hybrid_search as hybrid
from skein.plans.asset_queries import _NUMBER
from skein.plans.orphan_queries import _key
from skein.session import table

_CAPTION, _GOES_ON = r"(?iu)^\s*табл(?:ица|\.)", r"(?iu)^\s*(?:продолжение|окончание)\s+табл"
_CAPTION_NUMBER = r"(?iu)табл(?:иц[а-яё]*|\.)\s*((?:[А-Я]\.)?[0-9]+(?:\.[0-9]+)*)"


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return hybrid(texts, texts.where("id % 50 = 0"))


def caption_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a scanned caption opens or continues a table, and its number."""
    plain = T.join_spaced_labels(F.col("caption"))
    rows = table(spark, folder, "ocr_tables").select("table_id", plain.alias("caption"))
    number = F.nullif(F.upper(F.regexp_extract("caption", _CAPTION_NUMBER, 1)), F.lit(""))
    return rows.select("table_id", F.col("caption").rlike(_CAPTION).alias("opens"), F.col("caption").rlike(_GOES_ON).alias("goes_on"), number.alias("number"))


def clean_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned text without line-end hyphens, blanks in a row and blanks around carets."""
    joined = F.regexp_replace(F.col("text"), r"([а-яёa-z])-[ \t]*\n[ \t]*([а-яёa-z])", "$1$2")
    return table(spark, folder, "ocr_blocks").select("block_id", F.regexp_replace(F.regexp_replace(T.join_spaced_labels(joined), r"[ \t]*\^[ \t]*", "^"), r"[ \t]{2,}", " ").alias("text"))


def looks_concrete(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that name a document, hold a digit or at least three longer words."""
    text = F.col("text")
    concrete = text.rlike(r"(?iu)(?:гост|снип|пуэ)|[0-9]") | (F.size(F.regexp_extract_all(text, F.lit(r"\p{L}{4,}"), F.lit(0))) >= 3)
    return table(spark, folder, "documents").select("doc_id", concrete.alias("concrete"))


def registry_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Records delivered before 2024 win; later ones fill the keys that are missing."""
    rows = table(spark, folder, "registry").where("doc_key IS NOT NULL").select("rec_id", "doc_key", "document_id", "loaded_at")
    base = rows.where("loaded_at < TIMESTAMP '2024-01-01 00:00:00'")
    extra = rows.where("loaded_at >= TIMESTAMP '2024-01-01 00:00:00' OR loaded_at IS NULL").join(base, "doc_key", "left_anti")
    return base.unionByName(extra).drop("loaded_at")


def image_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Images for all assets that a result's text names; none at all if one of them is ambiguous."""
    named = table(spark, folder, "search_results").select("result_id", reference_key(F.col("document_id")).alias("document"), F.explode(T.asset_references(F.col("text"))).alias("x"))
    named = named.select("result_id", "document", "x.asset_type", "x.number")
    assets = table(spark, folder, "assets").where("image_path IS NOT NULL")
    numbered = assets.select(reference_key(F.col("document_id")).alias("document"), "asset_type", T.caption_number(F.col("asset_type"), F.col("caption")).alias("number"), "image_path")
    numbered = numbered.where("number IS NOT NULL AND document IS NOT NULL").groupBy("document", "asset_type", "number").agg(F.min("image_path").alias("own_path"))
    spread = numbered.groupBy("asset_type", "number").agg(F.count(F.lit(1)).alias("n"), F.min("own_path").alias("only_path"))
    both = named.join(numbered, ["document", "asset_type", "number"], "left").join(spread, ["asset_type", "number"], "left")
    path = F.coalesce("own_path", F.when(F.col("n") == 1, F.col("only_path")))
    per = both.groupBy("result_id").agg(F.max(F.col("own_path").isNull() & (F.coalesce("n", F.lit(0)) > 1)).alias("ambiguous"), F.array_join(F.sort_array(F.collect_set(path)), ";").alias("paths"))
    return per.select("result_id", F.when(F.col("ambiguous"), "").otherwise(F.col("paths")).alias("images"))


QUERIES = {f.__name__: f for f in (hybrid_search, caption_kinds, clean_blocks, looks_concrete, registry_merge, image_selection)}


def _unspaced(column: str) -> str:
    for word in ("Таблица", "Примечание", "Рисунок"):
        column = f"regexp_replace({column}, '(?i){'[[:space:]]'.join(word)}', '{word}', 'g')"
    return column


_NAMES = r"(?:[A-Za-zА-Яа-яЁё]\.)?[0-9]+(?:\.[0-9]+)*"


def _named(kind: str, pattern: str) -> str:
    return f"SELECT result_id, {_key('document_id')} AS document, '{kind}' AS asset_type, lower(unnest(regexp_extract_all(text, '{pattern.replace('(?iu)', '(?i)')}', 1))) AS number FROM search_results"


ORACLE = {
    "caption_kinds": f"""WITH c AS (SELECT table_id, {_unspaced('caption')} AS caption FROM ocr_tables)
SELECT table_id, regexp_matches(caption, '(?i)^\\s*табл(?:ица|\\.)') AS opens, regexp_matches(caption, '(?i)^\\s*(?:продолжение|окончание)\\s+табл') AS goes_on,
  nullif(upper(regexp_extract(caption, '(?i)табл(?:иц[а-яё]*|\\.)\\s*((?:[А-Я]\\.)?[0-9]+(?:\\.[0-9]+)*)', 1)), '') AS number FROM c""",
    "clean_blocks": f"""WITH j AS (SELECT block_id, regexp_replace(text, '([а-яёa-z])-[ \\t]*\\n[ \\t]*([а-яёa-z])', '\\1\\2', 'g') AS t FROM ocr_blocks)
SELECT block_id, regexp_replace(regexp_replace({_unspaced('t')}, '[ \\t]*\\^[ \\t]*', '^', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS text FROM j""",
    "looks_concrete": r"SELECT doc_id, regexp_matches(text, '(?i)(?:гост|снип|пуэ)|[0-9]') OR len(regexp_extract_all(text, '\p{L}{4,}')) >= 3 AS concrete FROM documents",
    "registry_merge": """WITH b AS (SELECT * FROM registry WHERE doc_key IS NOT NULL AND loaded_at < TIMESTAMP '2024-01-01')
SELECT rec_id, doc_key, document_id FROM b UNION ALL SELECT rec_id, doc_key, document_id FROM registry WHERE doc_key IS NOT NULL
  AND (loaded_at >= TIMESTAMP '2024-01-01' OR loaded_at IS NULL) AND doc_key NOT IN (SELECT doc_key FROM b)""",
    "image_selection": f"""WITH named AS (SELECT DISTINCT * FROM ({_named('table', T.TABLE_CAPTION)} UNION ALL {_named('image', T.IMAGE_CAPTION)})),
numbered AS (SELECT {_key('document_id')} AS document, asset_type, {_NUMBER} AS number, min(image_path) AS own_path FROM assets
  WHERE image_path IS NOT NULL AND document_id IS NOT NULL AND {_NUMBER} IS NOT NULL GROUP BY 1, 2, 3),
spread AS (SELECT asset_type, number, count(*) AS n, min(own_path) AS only_path FROM numbered GROUP BY ALL),
per AS (SELECT result_id, bool_or(own_path IS NULL AND coalesce(n, 0) > 1) AS ambiguous,
  coalesce(array_to_string(list_sort(list_distinct(list(coalesce(own_path, CASE WHEN n = 1 THEN only_path END)))), ';'), '') AS paths
  FROM named LEFT JOIN numbered USING (document, asset_type, number) LEFT JOIN spread USING (asset_type, number) GROUP BY result_id)
SELECT result_id, CASE WHEN ambiguous THEN '' ELSE paths END AS images FROM per""",
}
