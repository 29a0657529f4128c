"""Test passages inside a training corpus: broadcast n-grams, scan of all token windows, verified hits.

The n-grams of the test items are few; they go to every worker as one sorted array. If there are more than
``most_grams`` of them, blocks of items are taken one after another: collected, scanned, released. Every
window of every document is looked up; a hit counts only if the words themselves agree.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.folding import WORD, fold_text, word_skeleton
from skein.llm.shingles import WordNumbers, run_numbers
from skein.session import cut_lineage

#: N-grams that one broadcast holds at most: about 16 bytes each, and the words of their items.
MOST_GRAMS = 1_000_000
_HITS = "id bigint, item_id bigint, first_words array<int>"
_MARKED = "id bigint, text string, first_words array<int>"


def _items(rows: list, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[list[str]]]:
    """Sorted n-grams with the row and place of each; the rows' items, and their words."""
    texts = [r["text"] for r in rows]
    values, at = run_numbers(texts, run, WordNumbers())
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    place = np.concatenate([np.arange(n) for n in np.diff(at)] or [np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    return values[order], row[order], place[order], [r["item_id"] for r in rows], [_words(t) for t in texts]


def _words(text: str) -> list[str]:
    return [word_skeleton(w) for w in WORD.findall(fold_text(text))]


def _hits(texts: list[str | None], grams: Broadcast, run: int, numbers: WordNumbers) -> dict[tuple[int, int], list[int]]:
    """Verified hits of a batch: for each text and item, where in the text shared windows begin."""
    known, item_row, place, item_ids, item_words = grams.value
    found: dict[tuple[int, int], set[int]] = defaultdict(set)
    if not len(known):
        return {}
    texts = [t or "" for t in texts]
    values, at = run_numbers(texts, run, numbers)
    lo = np.searchsorted(known, values)
    words: dict[int, list[str]] = {}
    for h in np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == values):
        row = int(np.searchsorted(at, h, side="right")) - 1
        first = int(h - at[row])
        if row not in words:
            words[row] = _words(texts[row])
        k = int(lo[h])
        while k < len(known) and known[k] == values[h]:
            p, r = int(place[k]), int(item_row[k])
            if item_words[r][p : p + run] == words[row][first : first + run]:
                found[row, item_ids[r]].add(first)
            k += 1
    return {k: sorted(v) for k, v in found.items()}


def _scan(batches: Iterator[pa.RecordBatch], grams: Broadcast, run: int) -> Iterator[pa.RecordBatch]:
    numbers = WordNumbers()
    for batch in batches:
        found = _hits(batch.column("text").to_pylist(), grams, run, numbers)
        ids = batch.column("id").take(pa.array([r for r, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))], ["id", "item_id", "first_words"])


def _mark(batches: Iterator[pa.RecordBatch], grams: Broadcast, run: int) -> Iterator[pa.RecordBatch]:
    """Adds to each row the places where windows of these items begin."""
    numbers = WordNumbers()
    for batch in batches:
        marked = [set(x) for x in batch.column("first_words").to_pylist()]
        for (row, _), firsts in _hits(batch.column("text").to_pylist(), grams, run, numbers).items():
            marked[row].update(firsts)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array([sorted(x) for x in marked], pa.list_(pa.int32()))], ["id", "text", "first_words"])


def _blocks(items: DataFrame, run: int, most_grams: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items' n-grams, block by block, and whether there are several blocks."""
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    # A text of n characters has at most n / 2 words; blocks keep each broadcast within its bound.
    most = usable.agg(F.sum(F.length("text")) / 2).head()[0] or 0
    blocks = int(most // most_grams) + 1
    for block in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield items.sparkSession.sparkContext.broadcast(_items(rows, run)), blocks > 1


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", run: int = 13, most_grams: int = MOST_GRAMS) -> DataFrame:
    """One row per document and test item that share ``run`` consecutive words: id, item_id, first_words.

    ``items``: item_id, text; an item may have several texts. first_words are the places in the document
    where shared windows begin, counted in words. Words are runs of letters or digits in the consistent
    form, without case; what stands between them is ignored. Null texts and items shorter than ``run``
    words match nothing. A document given twice is reported once per copy.
    """
    texts = documents.select(F.col(id_column).alias("id"), "text").where("text IS NOT NULL")
    parts = []
    for grams, several in _blocks(items, run, most_grams):
        part = texts.mapInArrow(partial(_scan, grams=grams, run=run), _HITS)
        if several:
            part = cut_lineage(part)
            grams.unpersist()
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumnRenamed("id", id_column)


def _cut(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, words, removed = [], [], []
        for text, firsts in zip(batch.column("text").to_pylist(), batch.column("first_words").to_pylist()):
            found = list(WORD.finditer(folded := fold_text(text or "")))
            gone = {i for f in firsts or [] for i in range(f, f + run)}
            out, at = [], 0
            for i in sorted(gone):
                if i - 1 not in gone:
                    out.append(folded[at : found[i].start()])
                if i + 1 not in gone:
                    at = found[i].end()
            kept.append("".join([*out, folded[at:]]) if gone else text)
            words.append(len(found))
            removed.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string()), pa.array(words, pa.int32()), pa.array(removed, pa.int32())], ["id", "text", "n_words", "n_removed"])


def without_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", run: int = 13, drop_share: float = 0.5, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The corpus without test passages: id, text, n_words, n_removed.

    Shared windows are cut out where they are found, with what stands between their words, whatever the
    document's id (null or given twice); a document of which more than ``drop_share`` of the words are cut
    goes altogether. Other documents keep their text as it is, null included.
    """
    marked = documents.select(F.col(id_column).alias("id"), "text", F.array().cast("array<int>").alias("first_words"))
    for grams, several in _blocks(items, run, most_grams):
        marked = marked.mapInArrow(partial(_mark, grams=grams, run=run), _MARKED)
        if several:
            marked = cut_lineage(marked)
            grams.unpersist()
    out = marked.mapInArrow(partial(_cut, run=run), "id bigint, text string, n_words int, n_removed int")
    return out.where(F.col("n_removed") <= drop_share * F.col("n_words")).withColumnRenamed("id", id_column)
