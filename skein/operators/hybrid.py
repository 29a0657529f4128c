"""Hybrid search over texts: hashed dense vectors and saturated term frequencies, fused."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.functions.folding import WORD
from skein.operators.retrieval import FINAL, RETRIEVE, dense_top_k, fuse, pass_threshold_or_all, sparse_top_k, top_k

WIDTH = 256


def _embed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text in batch.column("text").to_pylist():
            v = np.zeros(width, np.float32)
            for w in WORD.findall((text or "").lower()):
                h = crc32(w.encode())
                v[h % width] += 1 if h >> 31 else -1
            made.append(v / max(float(np.linalg.norm(v)), 1e-9))
        flat = np.concatenate(made) if made else np.zeros(0, np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "vector"])


def embed(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """A deterministic stand-in for an embedding service: id, vector of signed word hashes of length one."""
    return texts.select("id", "text").mapInArrow(partial(_embed, width=width), "id bigint, vector array<float>")


def hybrid_search(texts: DataFrame, queries: DataFrame, k: int = RETRIEVE, final: int = FINAL) -> DataFrame:
    """Both rankings with k rows each, fused, thresholded, cut: query_id, id, rrf_score, rank. Inputs: id, text."""
    rankings = [dense_top_k(embed(texts), embed(queries), k), sparse_top_k(texts, queries, k)]
    kept = pass_threshold_or_all(fuse(rankings, "query_id", "id", k), "query_id", "rrf_score")
    return top_k(kept, "query_id", [kept["rank"].asc()], final)
