"""Top-k retrieval, rank fusion and shaping of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.folding import WORD
from skein.session import cut_lineage

RETRIEVE, FINAL = 30, 6
RRF_CONSTANT, RRF_THRESHOLD = 2, 0.15
EXACT, GOOD = 0.78, 0.72
#: Saturation of term frequencies.
TF_K, TF_B, TF_LENGTH = 1.2, 0.75, 256.0
#: Queries that one broadcast holds at most; more are answered block by block, one after another.
QUERY_BLOCK = 4096
#: Scores that a task holds at once: queries of a block times rows of a slice.
MOST_SCORES = 1 << 22


def top_k(scored: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each query with their rank from 1. Spark keeps k rows per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_blocks(queries: DataFrame, key: str, answer: Callable[[list], tuple[DataFrame, Broadcast]]) -> list[DataFrame]:
    """The answers to blocks of queries. Of several blocks each is collected, answered and released before the next."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = []
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).collect()
        if rows:
            part, shared = answer(rows)
            if blocks > 1:
                part = cut_lineage(part)
                shared.unpersist()
            out.append(part)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of a batch for each query; ties go to the smaller id. scores: queries x rows."""
    out = [], [], []
    for q, row in zip(query_ids, scores):
        some = np.flatnonzero(row > -np.inf)
        some = some[np.lexsort((ids[some], -row[some]))[:k]]
        for column, value in zip(out, (np.full(len(some), q), ids[some], row[some])):
            column.append(value)
    return _batch([np.concatenate(c) if c else np.zeros(0) for c in out])


def _batch(made: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())], ["query_id", "id", "score"])


def _slices(rows: int, queries: int) -> Iterator[slice]:
    step = max(1, MOST_SCORES // max(1, queries))
    return (slice(i, i + step) for i in range(0, rows, step))


def _best_of(parts: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The k best rows of each query from the best of several slices."""
    if len(parts) == 1:
        return parts[0]
    query, row, score = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return _batch([query[kept], row[kept], score[kept]])


def _dense(batches: Iterator[pa.RecordBatch], queries: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    query_ids, wanted = queries.value
    for batch in batches:
        column = batch.column("vector")
        vectors = column.flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
        norms = np.linalg.norm(vectors, axis=1)
        unit, ids, parts = vectors / np.where(norms > 0, norms, 1)[:, None], batch.column("id").to_numpy(), []
        for part in _slices(batch.num_rows, len(query_ids)):
            scores = wanted @ unit[part].T
            scores[:, norms[part] == 0] = -np.inf
            parts.append(_best(scores, ids[part], query_ids, k))
        if parts:
            yield _best_of(parts, k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = RETRIEVE) -> DataFrame:
    """Exact cosine top-k: query_id, id, score, rank. Both inputs: id bigint, vector array<float> of one width.

    Null or zero vectors match nothing. Ties go to the smaller id. Each batch of rows sends at most k
    rows per query to the shuffle; queries are answered in blocks of QUERY_BLOCK.
    """
    context = vectors.sparkSession.sparkContext
    usable = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector")

    def answer(rows: list) -> tuple[DataFrame, Broadcast]:
        wanted = np.array([r["vector"] for r in rows], np.float64)
        norms = np.linalg.norm(wanted, axis=1)
        kept = norms > 0
        shared = context.broadcast((np.array([r["id"] for r in rows], np.int64)[kept], wanted[kept] / norms[kept, None]))
        return usable.mapInArrow(partial(_dense, queries=shared, k=k), "query_id bigint, id bigint, score double"), shared

    parts = _by_blocks(queries.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector"), "id", answer)
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), "query_id", [F.desc("score"), F.asc("id")], k)


def saturated(counts: np.ndarray, length: int) -> np.ndarray:
    """Weights of term frequencies in a text of ``length`` words."""
    return counts * (TF_K + 1) / (counts + TF_K * (1 - TF_B + TF_B * length / TF_LENGTH))


def _weights(text: str) -> tuple[list[str], np.ndarray]:
    words = [w.lower() for w in WORD.findall(text)]
    terms: dict[str, int] = {}
    for w in words:
        terms[w] = terms.get(w, 0) + 1
    return list(terms), saturated(np.array(list(terms.values()), np.float64), len(words))


def _sparse(batches: Iterator[pa.RecordBatch], queries: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    query_ids, postings = queries.value
    for batch in batches:
        texts, ids, parts = batch.column("text").to_pylist(), batch.column("id").to_numpy(), []
        for part in _slices(batch.num_rows, len(query_ids)):
            scores = np.full((len(query_ids), len(texts[part])), -np.inf)
            for row, text in enumerate(texts[part]):
                sums, hit = np.zeros(len(query_ids)), np.zeros(len(query_ids), bool)
                for term, weight in zip(*_weights(text)):
                    if (found := postings.get(term)) is not None:
                        sums[found[0]] += found[1] * weight
                        hit[found[0]] = True
                scores[hit, row] = sums[hit]
            parts.append(_best(scores, ids[part], query_ids, k))
        if parts:
            yield _best_of(parts, k)


def sparse_top_k(texts: DataFrame, queries: DataFrame, k: int = RETRIEVE) -> DataFrame:
    """Dot product of saturated term frequencies, top-k: query_id, id, score, rank. Both inputs: id, text.

    Words are runs of letters or digits without case. Texts that share no word with a query do not
    match it; null texts match nothing. Ties go to the smaller id.
    """
    context = texts.sparkSession.sparkContext
    usable = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text")

    def answer(rows: list) -> tuple[DataFrame, Broadcast]:
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for i, r in enumerate(rows):
            for term, weight in zip(*_weights(r["text"])):
                at = lists.setdefault(term, ([], []))
                at[0].append(i)
                at[1].append(weight)
        shared = context.broadcast((np.array([r["id"] for r in rows], np.int64), {t: (np.array(i), np.array(w)) for t, (i, w) in lists.items()}))
        return usable.mapInArrow(partial(_sparse, queries=shared, k=k), "query_id bigint, id bigint, score double"), shared

    parts = _by_blocks(queries.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text"), "id", answer)
    if not parts:
        return texts.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), "query_id", [F.desc(F.round("score", 9)), F.asc("id")], k)


def fuse(rankings: list[DataFrame], query: str, key: str, k: int = RETRIEVE, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, key, rank from 1): query, key, rrf_score, rank."""
    lists = reduce(DataFrame.unionByName, [r.select(query, key, (F.lit(1.0) / (constant + F.col("rank") - 1)).alias("part")) for r in rankings])
    fused = lists.groupBy(query, key).agg(F.round(F.sum("part"), 6).alias("rrf_score"))
    return top_k(fused, query, [F.desc("rrf_score"), F.asc(key)], k)


def pass_threshold_or_all(ranked: DataFrame, query: str, score: str, threshold: float = RRF_THRESHOLD) -> DataFrame:
    """Rows at or above the threshold; of a query without any, all rows."""
    passes = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return ranked.withColumn("__any", F.max(passes).over(Window.partitionBy(query))).where(passes | ~F.col("__any")).drop("__any")


def quality_label(score: Column) -> Column:
    return F.when(score >= EXACT, "точное").when(score >= GOOD, "хорошее").otherwise("среднее")


def route(best: Column, tries: Column) -> Column:
    """Where a query goes after a search: answer, reformulate (twice at most) or clarify."""
    return F.when(best > 0.7, "answer").when((best >= 0.4) & (tries < 2), "reformulate").otherwise("clarify")


def source_name(title: Column, document_id: Column) -> Column:
    """Title, else document_id, else unknown; empty counts as missing."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(document_id, F.lit("")), F.lit("unknown"))


def first_per_source(results: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """The first result of each document_id, else of each title without case; results without either all stay."""
    key = F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.lower(F.nullif(F.col("title"), F.lit(""))))
    rank = F.row_number().over(Window.partitionBy(query, key).orderBy(*order))
    return results.withColumn("__key", key).withColumn("__rank", rank).where("__rank = 1 OR __key IS NULL").drop("__key", "__rank")


def documents_in_base(rows: DataFrame, order: str) -> DataFrame:
    """Documents with their first title, type, domain and status, and how many rows each has; null ids are left out."""
    first = lambda c: F.min_by(c, order).alias(c)
    return rows.where("document_id IS NOT NULL").groupBy("document_id").agg(first("title"), first("document_type"), first("domain"), first("status"), F.count(F.lit(1)).alias("n_rows"))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of a query's distinct words that a text holds: a stand-in for a reranking model."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = words(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(0.0)
