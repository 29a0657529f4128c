"""Tables and images of documents: checks, links, lookups by number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.folding import reference_key
from skein.functions.text import asset_references, caption_number


def validate(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Faults of an index load, one row each: fault, key, detail.

    ``chunks``: chunk_id, document_id, text, assets (array of structs with asset_id). ``assets``:
    asset_id, document_id, chunk_ids. Faults: a chunk id given more than once, blank text, an asset id
    that no asset has, a chunk id that no chunk has, an asset of another document. Null ids are no keys.
    """
    repeated = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").count().where("count > 1")
    repeated = repeated.select(F.lit("repeated chunk_id").alias("fault"), F.col("chunk_id").alias("key"), F.col("count").cast("string").alias("detail"))
    blank = chunks.where("text IS NULL OR trim(text) = ''").select(F.lit("blank text").alias("fault"), F.col("chunk_id").alias("key"), F.lit(None).cast("string").alias("detail"))
    used = chunks.select("chunk_id", "document_id", F.explode("assets").alias("asset")).select("chunk_id", "document_id", "asset.asset_id").distinct()
    known = assets.select("asset_id").distinct()
    dangling = used.where("asset_id IS NOT NULL").join(known, "asset_id", "left_anti").select(F.lit("unknown asset_id").alias("fault"), F.col("asset_id").alias("key"), F.col("chunk_id").alias("detail"))
    named = assets.select("asset_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    orphan = named.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select(F.lit("unknown chunk_id").alias("fault"), F.col("chunk_id").alias("key"), F.col("asset_id").alias("detail"))
    owners = assets.select("asset_id", reference_key(F.col("document_id")).alias("owner")).distinct()
    foreign = used.join(owners, "asset_id").where(F.col("owner") != reference_key(F.col("document_id")))
    foreign = foreign.select(F.lit("asset of another document").alias("fault"), F.col("asset_id").alias("key"), F.col("chunk_id").alias("detail"))
    return repeated.unionByName(blank).unionByName(dangling).unionByName(orphan).unionByName(foreign.distinct())


def named_chunks(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which of an asset's chunk ids exist: asset_id, n_named, n_found."""
    named = assets.select("asset_id", F.explode_outer(F.array_distinct("chunk_ids")).alias("chunk_id")).distinct()
    there = chunks.where("chunk_id IS NOT NULL").select("chunk_id", F.lit(1).alias("there")).distinct()
    return named.join(there, "chunk_id", "left").groupBy("asset_id").agg(F.count("chunk_id").alias("n_named"), F.count("there").alias("n_found"))


def look_up(rows: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """The first asset that each text names: key, asset_type, number, outcome (found, ambiguous, absent).

    An asset of the row's own document wins; otherwise the number must belong to one document only.
    Counts per number and per document are joined, never the assets themselves, so that a number that
    every document has costs no more than any other.
    """
    # A generator reads each text once and drops those that name nothing.
    asked = rows.select(key, reference_key(F.col("document_id")).alias("document"), F.explode(F.slice(asset_references(F.col("text")), 1, 1)).alias("x"))
    asked = asked.select(key, "document", "x.asset_type", "x.number")
    numbered = assets.select(reference_key(F.col("document_id")).alias("document"), "asset_type", caption_number(F.col("asset_type"), F.col("caption")).alias("number"))
    numbered = numbered.where("number IS NOT NULL AND document IS NOT NULL").distinct()
    spread = numbered.groupBy("asset_type", "number").agg(F.count(F.lit(1)).alias("n_documents"))
    own = numbered.withColumn("own", F.lit(True))
    both = asked.join(own, ["document", "asset_type", "number"], "left").join(spread, ["asset_type", "number"], "left")
    outcome = F.when(F.col("own") | (F.col("n_documents") == 1), "found").when(F.col("n_documents") > 1, "ambiguous").otherwise("absent")
    return both.select(key, "asset_type", "number", outcome.alias("outcome"))


def cited_rows(results: DataFrame) -> DataFrame:
    """Which result each clause reference of a query's results means: query_id, document_id, number, cited_id.

    The cited row is the first by rank of the same query and document whose path ends in the number.
    """
    number = F.regexp_extract(reference_key(F.col("ref")), r"^(?:ПУНКТ|П)\.?(\d+(?:\.\d+)*)\.?$", 1)
    asked = results.select("query_id", "document_id", F.explode("references").alias("ref")).select("query_id", "document_id", number.alias("number")).where("number <> ''").distinct()
    ends = results.select("query_id", "document_id", "result_id", "rank", F.element_at(F.split("section_path", " → "), -1).alias("number")).where("number IS NOT NULL")
    first = ends.groupBy("query_id", "document_id", "number").agg(F.min_by("result_id", F.struct("rank", "result_id")).alias("cited_id"))
    return asked.join(first, ["query_id", "document_id", "number"])
