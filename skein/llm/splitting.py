"""Oversized texts in pieces under a limit, cut at natural boundaries, with overlap.

The cuts of a text are chosen together: dynamic programming over its boundary positions minimises the
sum of cut penalties and of the pieces' squared distance from an even size, over all ways to cut it
into pieces that keep the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 1500
OVERLAP = 150

#: Kinds of boundary, the best first, with the penalty of a cut there.
_KINDS = [
    ("paragraph", 0.0, re.compile(r"\n[ \t]*\n\s*")),
    ("line", 0.3, re.compile(r"\n")),
    ("sentence", 0.6, re.compile(r"[.!?…]+[\"»”)\]]*\s+")),
    ("clause", 2.0, re.compile(r"[;:,—]\s+")),
    ("word", 4.0, re.compile(r"\s+")),
]
_ANYWHERE = ("none", 20.0)


def _boundaries(text: str, wide: int) -> dict[int, int]:
    """Positions where a piece may end, with the index of their kind.

    Clauses, words and bare positions count only where stronger boundaries lie more than ``wide`` apart.
    """
    kinds: dict[int, int] = {}
    edges = [0, len(text)]
    for kind, (_, _, pattern) in enumerate(_KINDS):
        if kind < 3:
            found = [m.end() for m in pattern.finditer(text)]
        else:
            gaps = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > wide]
            found = [m.end() for a, b in gaps for m in pattern.finditer(text, a, b)]
        for p in found:
            if 0 < p < len(text):
                kinds.setdefault(p, kind)
        edges = sorted({0, len(text), *kinds})
    for a, b in zip(edges, edges[1:]):
        for p in range(a + wide, b, wide):
            kinds[p] = len(_KINDS)
    return kinds


def _overlap_start(text: str, end: int, overlap: int) -> int:
    """Where the piece after a cut at ``end`` begins: a word's start among the last ``overlap`` characters, or exactly so far back."""
    begin = end - overlap
    if begin <= 0:
        return max(0, begin)
    if text[begin - 1].isspace() and not text[begin].isspace():
        return begin
    blank = re.compile(r"\s+(?=\S)").search(text, begin, min(end, begin + overlap // 3))
    return blank.end() if blank else begin


def cut_positions(text: str, most: int = MOST_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece of one text."""
    if len(text) <= most:
        return [(0, len(text), "end")]
    kinds = _boundaries(text, max(1, (most - overlap) // 5))
    ends = [*sorted(kinds), len(text)]
    penalty = np.array([([*(p for _, p, _ in _KINDS), _ANYWHERE[1]])[kinds[e]] for e in ends[:-1]] + [0.0])
    starts = np.maximum.accumulate([0] + [_overlap_start(text, e, overlap) for e in ends[:-1]])
    pieces = -(-(len(text) - overlap) // (most - overlap))
    even = (len(text) + overlap * (pieces - 1)) / pieces
    best = np.full(len(ends) + 1, np.inf)
    best[0] = 0.0
    before = np.zeros(len(ends) + 1, np.int64)
    low = 0
    for i, end in enumerate(ends):
        while end - starts[low] > most:
            low += 1
        size = end - starts[low : i + 1]
        cost = best[low : i + 1] + penalty[i] + 4 * ((size - even) / even) ** 2
        at = int(np.argmin(cost))
        best[i + 1], before[i + 1] = cost[at], low + at
    out, i = [], len(ends)
    while i:
        j = int(before[i])
        kind = "end" if i == len(ends) else ([*(k for k, _, _ in _KINDS), _ANYWHERE[0]])[kinds[ends[i - 1]]]
        out.append((int(starts[j]), ends[i - 1], kind))
        i = j
    return out[::-1]


def _split(batches: Iterator[pa.RecordBatch], most: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, columns = [], [[] for _ in range(6)]
        for row, text in enumerate(batch.column("text").to_pylist()):
            cuts = cut_positions(text, most, overlap)
            for part, (start, end, kind) in enumerate(cuts, 1):
                rows.append(row)
                for column, value in zip(columns, (part, len(cuts), start, end, kind, text[start:end])):
                    column.append(value)
        kept = batch.select([n for n in batch.schema.names if n != "text"]).take(pa.array(rows, pa.int64()))
        types = [pa.int32()] * 4 + [pa.string()] * 2
        made = [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, "part", "n_parts", "start", "end", "cut", "piece"])


def split_oversized(df: DataFrame, id_column: str, text_column: str, keep: list[str] | None = None, most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of at most ``most`` characters: id, the kept columns, part, n_parts, start, end, cut, piece.

    A text within the limit is one piece as it is; null texts come out as one null piece. A piece after
    the first begins with the last ``overlap`` characters of the one before, or up to a third fewer so
    that it starts at a word. start and end are character positions; cut names the boundary at the end
    (paragraph, line, sentence, clause, word, none; end for a last piece). Repeated ids stay repeated.
    """
    if not 0 <= overlap < most // 2:
        raise ValueError("the overlap must be less than half of the limit")
    keep = keep or []
    rows = df.select(F.col(id_column).alias("__id"), *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], F.col(text_column).alias("text"))
    long: Column = F.length("text") > most
    made = rows.where(long)
    schema = ", ".join([f"{n} {t}" for n, t in made.dtypes if n != "text"] + ["part int, n_parts int, start int, `end` int, cut string, piece string"])
    pieces = made.mapInArrow(partial(_split, most=most, overlap=overlap), schema)
    whole = rows.where(F.coalesce(~long, F.lit(True))).select(
        *[n for n in rows.columns if n != "text"],
        F.lit(1).alias("part"),
        F.lit(1).alias("n_parts"),
        F.lit(0).alias("start"),
        F.coalesce(F.length("text"), F.lit(0)).alias("end"),
        F.lit("end").alias("cut"),
        F.col("text").alias("piece"),
    )
    out = pieces.unionByName(whole)
    return out.select(F.col("__id").alias(id_column), *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], "part", "n_parts", "start", "end", "cut", "piece")
