"""A mix of sources with target shares of all tokens, by a low-discrepancy schedule.

Slots 0, 1, 2, ... are mapped to golden-ratio points; a point's place among the cumulative weights
names the slot's source, so any stretch of slots holds each source about in its share. Each source's
documents, shuffled and repeated as often as needed, are cut into blocks of equal token counts; the
n-th slot of a source takes its n-th block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of a slot, whatever the size of the mix.
BLOCK_TOKENS = 256
#: Documents, and slots, that one task brings into order.
BUCKET_ROWS = 50_000
# Fixed value: 2**32 over the golden ratio, odd.
_GOLDEN = 2654435769


def source_name(column: Column) -> Column:
    """One spelling of a source: lower case, underscores, no blanks around; empty is null."""
    plain = F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")
    return F.when(plain != "", plain)


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(tokenizer))
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n = [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source in one spelling, n_tokens by the vocabulary file of a public tokenizer; null texts count zero.

    ``tokenizer`` is a path that the driver can read; the file goes to the executors.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(partial(_count, tokenizer=Path(tokenizer).name), "doc_id bigint, source string, n_tokens bigint")


def schedule(spark, weights: list[tuple[str, float]], n_slots: int) -> DataFrame:
    """slot, source, turn (how many slots of the source came before).

    Turns go in two steps, over stretches of slots and inside them, so that no source is ranked in one task.
    """
    # slot times GOLDEN, modulo 2**32, without leaving 64 bits.
    point = ((F.col("slot") % (1 << 31)) * _GOLDEN + (F.expr(f"slot div {1 << 31}") % 2) * (1 << 31)) % (1 << 32)
    whole, edge, source = sum(w for _, w in weights), 0.0, F.lit(weights[-1][0])
    for name, weight in reversed(weights[:-1]):
        edge += weights[[n for n, _ in weights].index(name) + 1][1]
        source = F.when(point < int((whole - edge) / whole * (1 << 32)), name).otherwise(source)
    slots = spark.range(n_slots).toDF("slot").select("slot", source.alias("source"), F.expr(f"slot div {BUCKET_ROWS}").alias("stretch"))
    counts = slots.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "stretch", before.alias("before"))
    inside = slots.withColumn("own", F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1)
    return inside.join(offsets, ["source", "stretch"]).select("slot", "source", (F.col("before") + F.col("own")).alias("turn"))


def _blocks(docs: DataFrame, block_tokens: int, n_docs: int) -> DataFrame:
    """Documents with the block their first token falls into, in shuffled order of their source.

    Running sums go in two steps, over buckets and inside them, so that no source is summed in one task.
    """
    buckets = n_docs // BUCKET_ROWS + 1
    shuffled = docs.withColumn("draw", F.xxhash64("doc_id", "repetition")).withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)))
    sums = shuffled.groupBy("source", "repetition", "bucket").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy("repetition", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "repetition", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "repetition", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = shuffled.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "repetition", "bucket"])
    return placed.select("source", "repetition", "doc_id", "n_tokens", F.expr(f"(offset + before) div {block_tokens}").alias("turn"))


def mix(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: slot, source, doc_id, repetition (0 for the first use), n_tokens. A slot holds ``block_tokens`` tokens.

    ``tokens``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats (one row per
    source, so few; they alone come to the driver, with one total per target). Without ``total_tokens``
    the total is the largest at which every target that has documents can be met. A source without
    documents gets nothing and the others keep their shares to each other; a larger ``total_tokens``
    leaves the sources that run out below their share. Sources that are no target, documents without
    tokens and targets with a null or zero share take no part; a null max_repeats is 1.
    """
    spark = tokens.sparkSession
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("repeats")).where("target_share > 0 AND repeats > 0 AND source IS NOT NULL")
    docs = tokens.where("n_tokens > 0").select("source", "doc_id", "n_tokens")
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("there"), F.count(F.lit(1)).alias("n_docs"))
    found = sorted(tuple(r) for r in goals.join(totals, "source").select("source", "target_share", "repeats", "there", "n_docs").collect())
    empty = "slot bigint, source string, doc_id bigint, repetition int, n_tokens bigint"
    if not found:
        return spark.createDataFrame([], empty)
    whole = sum(share for _, share, *_ in found)
    total = total_tokens or int(min(there * repeats * whole / share for _, share, repeats, there, _ in found))
    slots = schedule(spark, [(name, share) for name, share, *_ in found], max(1, total // block_tokens))
    # As many repetitions as a source's tokens make necessary, within its limit.
    needed = spark.createDataFrame([(name, min(repeats, int(total * share / whole // there) + 1)) for name, share, repeats, there, _ in found], "source string, needed int")
    used = docs.join(F.broadcast(needed), "source").select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("needed") - 1)).alias("repetition"))
    blocks = _blocks(used, block_tokens, sum(n * r for *_, r, _, n in found))
    return slots.join(blocks, ["source", "turn"]).select("slot", "source", "doc_id", "repetition", "n_tokens")


def mix_report(mixed: DataFrame, tokens: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per target source: shares aimed at and reached, tokens there and used, most uses of one document, met."""
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    there = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"))
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("n"))
    used = uses.groupBy("source").agg(F.sum("n").alias("tokens_used"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("documents_used"))
    out = goals.join(there, "source", "left").join(used, "source", "left").na.fill(0, ["tokens_there", "tokens_used", "most_uses", "documents_used"])
    share = F.try_divide("tokens_used", F.sum("tokens_used").over(Window.partitionBy()))
    return out.withColumn("actual_share", F.coalesce(share, F.lit(0.0))).withColumn("met", F.abs(F.col("actual_share") - F.col("target_share")) <= tolerance)
