"""Near-duplicate texts: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

1. Every text becomes the set of its word runs under one hash function; the k smallest values are its
   sketch. Texts with equal sets are one class from here on.
2. Similar sets retain at least ``t`` values in common. Each class therefore enters the inverted lists of
   its k - t + 1 rarest retained values only: two classes with t common values meet in at least one. How
   rare a value is says a table of fixed size, counted over all sketches.
3. An entry carries its class's sketch in short form. Within each list the common values are counted
   through a second, local inverted index, again by the locally rarest values; what shares t values has
   the sketch of its union estimated on the spot, and only pairs that may reach the threshold leave the task.
4. A list that would be too long for a task is split by a second retained value (similar sets have at
   least two in common among their k - t + 2 rarest), and what is still too long, versions of one text,
   is met block against block. Nothing is cut off: every pair with t common values meets.
5. Candidates are compared exactly, on whole sets made from the whole texts. Links are all of them;
   groups leave out pairs that verified links have joined already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.marks import id_slots, marked, marks
from skein.llm.shingles import WordNumbers, run_numbers
from skein.session import cut_lineage

K = 20
#: How far the share of common retained values, and that of the union's sketch, may stay under the threshold.
SLACK, MARGIN = 0.3, 0.4
#: Entries of one list that a task meets at most (more where the average list is long).
LIST_ROWS = 20_000
#: Candidates per class that are compared whatever the links found so far.
FIRST_PARTNERS = 8
#: Rows of a group that one task pairs with the whole group.
SLICE = 2_000
_SHORT = 1 << 16
#: Bytes of an entry before the sketch: id, size, side. An entry of the side ANY meets every other.
_FIXED, _ANY = 11, 2
_SIGN, _STEP, _MIX = np.uint64(1 << 63), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PAIRS_AT_ONCE, _ENTRIES_AT_ONCE = 20_000, 30_000
#: Lists whose pairs are counted as products of matrices: entries at least, and cells of the matrix at most.
_DENSE_FROM, _DENSE_CELLS = 32, 1 << 24


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _SIGN).view(np.int64)


def _sets(batch: pa.RecordBatch, run: int, numbers: WordNumbers) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place in the batch and its distinct run values, ascending; texts without runs are left out."""
    values, at = run_numbers(batch.column("text").to_pylist(), run, numbers)
    values = _signed(values)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            yield i, np.unique(values[a:b])


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def _sketch(batches: Iterator[pa.RecordBatch], run: int, k: int) -> Iterator[pa.RecordBatch]:
    numbers = WordNumbers()
    for batch in batches:
        rows, prints, sizes, sketches = [], [], [], []
        for i, values in _sets(batch, run, numbers):
            rows.append(i)
            prints.append(blake2b(values.tobytes(), digest_size=16).digest())
            sizes.append(len(values))
            sketches.append(values[:k])
        ids = batch.column("id").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), _lists(sketches, pa.int64())], ["id", "print", "size", "sketch"])


def _needed(size: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Retained values that a set has in common with any similar one: by whole sets where these are small."""
    return np.minimum(int(k * (threshold - SLACK) + 1e-9), np.ceil(threshold * size - 1e-9)).astype(np.int64)


def _table(sketch: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One row a sketch, filled up with zeros, and how many values each has."""
    lengths = np.diff(sketch.offsets.to_numpy())
    table = np.zeros((len(lengths), k), np.int64)
    table[np.arange(k) < lengths[:, None]] = sketch.flatten().to_numpy()
    return table, lengths


def _short(values: np.ndarray) -> np.ndarray:
    return (values & (_SHORT - 1)).astype(np.uint16)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 32) & (_SHORT - 1)).astype(np.int64)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = first.view(np.uint64) * _STEP + second.view(np.uint64)
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(_short(batch.column("sketch").flatten().to_numpy()) for batch in batches)


def _counted(buckets: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SHORT, np.int64)
    for x in buckets:
        counts += np.bincount(x, minlength=_SHORT)
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], ["bucket", "n"])


def _dense(counts: DataFrame) -> np.ndarray:
    """A table of fixed size, whatever the number of rows it was counted over."""
    out = np.zeros(_SHORT, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _first_keys(table: np.ndarray, lengths: np.ndarray, need: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from the rarest to the most frequent, and which of them a class is listed under: none if it is too small to be similar to another."""
    k = table.shape[1]
    rank = np.where(np.arange(k) < lengths[:, None], order[_short(table)], _SHORT)
    ordered = np.take_along_axis(table, np.argsort(rank, axis=1, kind="stable"), axis=1)
    listed = (np.arange(k) < (lengths - need + 1)[:, None]) & (need > 2)[:, None]
    return ordered, listed


def _second_keys(ordered: np.ndarray, hot: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key for each hot value with each later one among the first ``last``."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(ordered.shape[1]):
        at = np.flatnonzero(hot[:, p])
        for q in range(p + 1, ordered.shape[1]) if len(at) else ():
            some = at[q < last[at]]
            first, second = ordered[some, p], ordered[some, q]
            low = (_short(second).astype(np.uint64) << np.uint64(16)) | _short(first).astype(np.uint64)
            rows.append(some)
            keys.append(((_mixed(first, second) & ~np.uint64(0xFFFFFFFF)) | low | _SIGN).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batch: pa.RecordBatch, k: int, threshold: float, order: np.ndarray, first: np.ndarray | None, second: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch, the lists they enter, and the side they take there (two blocks of a list: 0 and 1). Without ``first``, lists of one value; without ``second``, those of two where one is too long."""
    table, lengths = _table(batch.column("sketch"), k)
    need = _needed(batch.column("size").to_numpy(), k, threshold)
    ordered, listed = _first_keys(table, lengths, need, order)
    keys = ordered & ~np.int64(np.iinfo(np.int64).min)
    hot = np.zeros_like(listed) if first is None else listed & (first[_bucket(keys)] > most)
    rows, columns = np.nonzero(listed & ~hot)
    one = keys[rows, columns]
    if first is None:
        return rows, one, np.full(len(rows), _ANY, np.uint8)
    rows2, two = _second_keys(ordered, hot, lengths - need + 2)
    if second is None:
        return rows2, two, np.full(len(rows2), _ANY, np.uint8)
    blocks = np.maximum(1, -(-second[_bucket(two)] // most))
    # A row of a list in several blocks meets each of them.
    again = np.repeat(np.arange(len(two)), blocks)
    other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    ids = batch.column("id").to_numpy()[rows2[again]]
    own = (_mixed(ids, np.full(len(ids), 7, np.int64)) % blocks[again].astype(np.uint64)).astype(np.int64)
    place = np.minimum(own, other) * (1 << 20) + np.maximum(own, other)
    split = blocks[again] > 1
    high = np.where(split, _mixed(two[again], place), two[again].view(np.uint64))
    whole = (high & ~np.uint64(0xFFFFFFFF)) | (two[again].view(np.uint64) & np.uint64(0xFFFFFFFF)) | _SIGN
    side = np.where(split & (own != other), (own > other).astype(np.uint8), _ANY)
    return np.concatenate([rows, rows2[again]]), np.concatenate([one, whole.view(np.int64)]), np.concatenate([np.full(len(rows), _ANY, np.uint8), side])


def _count_keys(batches: Iterator[pa.RecordBatch], lists: Broadcast, k: int, threshold: float, most: int) -> Iterator[pa.RecordBatch]:
    yield from _counted(_bucket(_keys(batch, k, threshold, *lists.value, None, most)[1]) for batch in batches)


def _entries(batches: Iterator[pa.RecordBatch], lists: Broadcast, k: int, threshold: float, most: int) -> Iterator[pa.RecordBatch]:
    """Entries of the inverted lists: key, and id, size and sketch in short form."""
    for batch in batches:
        rows, keys, sides = _keys(batch, k, threshold, *lists.value, most)
        made = np.zeros((batch.num_rows, _FIXED + 2 * k), np.uint8)
        made[:, :8] = batch.column("id").to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8)
        made[:, 8:10] = np.minimum(batch.column("size").to_numpy(), _SHORT - 1).astype(np.uint16).view(np.uint8).reshape(-1, 2)
        made[:, _FIXED:] = _short(_table(batch.column("sketch"), k)[0]).view(np.uint8).reshape(-1, 2 * k)
        for i in range(0, len(rows), _ENTRIES_AT_ONCE):
            part = made[rows[i : i + _ENTRIES_AT_ONCE]]
            part[:, 10] = sides[i : i + _ENTRIES_AT_ONCE]
            at = np.arange(len(part) + 1, dtype=np.int32) * made.shape[1]
            entry = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(part)])
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + _ENTRIES_AT_ONCE]), entry], ["key", "entry"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(values)]]))


def _dense_pairs(rows: np.ndarray, column: np.ndarray, n: int, width: int, before: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list whose entries have most values in common, counted as products of matrices, some rows at a time.

    ``rows``, ``column``: which entry has which of the ``width`` shared values; ``before``: which of these are
    rarer than the list's own value. Pairs with more than two such values in common meet in other lists.
    """
    grid = np.zeros((n, width), np.float32)
    grid[rows, column] = 1
    rarer = grid[:, before]
    step = max(1, (1 << 22) // n)
    for i in range(0, n, step):
        some = slice(i, i + step)
        common = grid[some] @ grid.T
        good = (common >= np.maximum(need[some][:, None], need) - 1) & (rarer[some] @ rarer.T <= 2)
        a, b = np.nonzero(good & (np.arange(n) > np.arange(i, min(n, i + step))[:, None]))
        yield a + i, b


def _local_pairs(keys: np.ndarray, short: np.ndarray, lengths: np.ndarray, need: np.ndarray, order_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list that have one of their locally rarest values in common, a bounded number at a time.

    Where that would make more pairs than the list has (versions of one text), all pairs of the list are
    counted instead.
    """
    n, k = short.shape
    number = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])).astype(np.uint64)
    there = np.arange(k) < lengths[:, None]
    flat, who = ((number[:, None] << np.uint64(16)) | short)[there], np.repeat(np.arange(n), lengths)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    length = _runs(flat)[1]
    often = np.repeat(length, length)
    shared = often > 1
    flat, who, often = flat[shared], who[shared], often[shared]
    all_flat, all_who = flat, who
    order = np.lexsort((flat, often, who))
    flat, who = flat[order], who[order]
    own = np.bincount(who, minlength=n)
    place = np.arange(len(who)) - np.repeat(np.cumsum(own) - own, own) + (lengths - own)[who]
    rare = place < (lengths - need + 1)[who]
    flat, who = flat[rare], who[rare]
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    first, length = _runs(flat)
    rest = np.repeat(first + length, length) - np.arange(len(flat)) - 1
    list_of, made = np.unique((flat >> np.uint64(16)).astype(np.int64), return_inverse=True)
    begins, sizes = _runs(keys)
    pairs = np.bincount(made, weights=rest, minlength=len(list_of))
    for x in list_of[(pairs > sizes[list_of] * (sizes[list_of] - 1.0) / 2) & (sizes[list_of] >= _DENSE_FROM)]:
        low, high = np.searchsorted(all_flat, [np.uint64(x) << np.uint64(16), np.uint64(x + 1) << np.uint64(16)])
        values, column = np.unique(all_flat[low:high], return_inverse=True)
        if sizes[x] * len(values) <= _DENSE_CELLS:
            mine = slice(begins[x], begins[x] + sizes[x])
            own = order_of[keys[begins[x]] & (_SHORT - 1)]
            before = order_of[(values & np.uint64(_SHORT - 1)).astype(np.int64)] < own
            for a, b in _dense_pairs(all_who[low:high] - begins[x], column, sizes[x], len(values), before, need[mine]):
                yield a + begins[x], b + begins[x]
            kept = list_of[made] != x
            flat, who, rest, made = flat[kept], who[kept], rest[kept], made[kept]
    ends = np.cumsum(rest)
    at = 0
    while at < len(flat):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50 * _PAIRS_AT_ONCE, side="right")))
        some = rest[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        pairs = np.unique(np.minimum(who[i], who[j]) * n + np.maximum(who[i], who[j]))
        yield pairs // n, pairs % n
        at = to


def _alike(x: np.ndarray, y: np.ndarray, short: np.ndarray, lengths: np.ndarray, need: np.ndarray, order: np.ndarray, keys: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have enough values in common, may be similar by the sketch of their union, and meet here in one of their first lists."""
    k = short.shape[1]
    column = np.arange(k)
    p, q = short[x], short[y]
    same = (p[:, :, None] == q[:, None, :]) & (column < lengths[x][:, None])[:, :, None] & (column < lengths[y][:, None])[:, None, :]
    common = same.any(axis=2)
    n = common.sum(axis=1)
    before = np.cumsum(common, axis=1) - common
    both = (common & (column + same.argmax(axis=2) - before < k)).sum(axis=1)
    union = np.minimum(k, lengths[x] + lengths[y] - n)
    good = (n >= np.maximum(need[x], need[y])) & (both >= np.floor(least * union))
    # The same pair meets wherever it shares a rare value; three times is enough, in case a short form misleads.
    rank, key = order[p], keys[x]
    here = order[key & (_SHORT - 1)]
    good &= (common & (rank < here[:, None])).sum(axis=1) <= 2
    two = key < 0
    if two.any():
        second = order[(key >> 16) & (_SHORT - 1)]
        good &= ~two | ((common & (rank > here[:, None]) & (rank < second[:, None])).sum(axis=1) <= 2)
    return good


def _meet(batches: Iterator[pa.RecordBatch], lists: Broadcast, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs from a partition of entries sorted by key. Carries only the list at the end of a batch over."""
    order = lists.value[0]
    keys, held = np.zeros(0, np.int64), np.zeros((0, _FIXED + 2 * k), np.uint8)

    def out(keys: np.ndarray, made: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.ascontiguousarray(made[:, :8]).view(np.int64)[:, 0]
        size = np.ascontiguousarray(made[:, 8:10]).view(np.uint16)[:, 0].astype(np.int64)
        side, short = made[:, 10], np.ascontiguousarray(made[:, _FIXED:]).view(np.uint16)
        lengths, need = np.minimum(size, k), _needed(size, k, threshold)
        for a, b in _local_pairs(keys, short, lengths, need, order):
            near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            near |= np.maximum(size[a], size[b]) == _SHORT - 1
            near &= (ids[a] != ids[b]) & ((side[a] == _ANY) | (side[a] != side[b]))
            a, b = a[near], b[near]
            found = []
            for i in range(0, len(a), _PAIRS_AT_ONCE):
                x, y = a[i : i + _PAIRS_AT_ONCE], b[i : i + _PAIRS_AT_ONCE]
                good = _alike(x, y, short, lengths, need, order, keys, threshold - MARGIN)
                found.append((ids[x[good]], ids[y[good]]))
            if found:
                p, q = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        entry = batch.column("entry")
        data = np.frombuffer(entry.buffers()[2], np.uint8)[np.frombuffer(entry.buffers()[1], np.int32)[entry.offset] :][: len(entry) * (_FIXED + 2 * k)]
        waiting.append((batch.column("key").to_numpy(), data.reshape(len(entry), _FIXED + 2 * k).copy()))
        if sum(len(x) for x, _ in waiting) + len(keys) < _ENTRIES_AT_ONCE:
            continue
        keys, held = np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([held, *(x for _, x in waiting)])
        waiting = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from out(keys[:last], held[:last])
            keys, held = keys[last:], held[last:]
    keys, held = np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([held, *(x for _, x in waiting)])
    if len(keys):
        yield from out(keys, held)


def _full_sets(batches: Iterator[pa.RecordBatch], run: int, table: Broadcast) -> Iterator[pa.RecordBatch]:
    numbers = WordNumbers()
    for batch in batches:
        batch = batch.filter(pa.array(marked(table.value, id_slots(batch.column("id").to_numpy()))))
        found = list(_sets(batch, run, numbers))
        ids = batch.column("id").take(pa.array([i for i, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, _lists([x for _, x in found], pa.int64())], ["id", "runs"])


def _classes(texts: DataFrame, run: int, k: int) -> tuple[DataFrame, DataFrame]:
    """id, print, size, sketch of every text that has runs; and of the first text of each class."""
    rows = cut_lineage(texts.mapInArrow(partial(_sketch, run=run, k=k), "id bigint, print binary, size int, sketch array<bigint>"))
    reps = rows.groupBy("print").agg(F.min_by(F.struct("id", "size", "sketch"), "id").alias("first")).select("print", "first.*")
    return rows, cut_lineage(reps)


def candidates(reps: DataFrame, threshold: float, k: int = K, list_rows: int = LIST_ROWS) -> DataFrame:
    """Pairs a < b of classes (id, size, sketch) with enough retained values in common and a promising estimate, once each."""
    context = reps.sparkSession.sparkContext
    sketches = reps.select("id", "size", "sketch")
    values = _dense(sketches.select("sketch").mapInArrow(_count_values, "bucket bigint, n bigint"))
    order = np.empty(_SHORT, np.int64)
    order[np.lexsort((np.arange(_SHORT), values))] = np.arange(_SHORT)
    # Where there are very many classes, lists are longer on average, and so is what counts as too long.
    most = max(list_rows, 8 * int(values.sum()) // _SHORT)
    options = {"k": k, "threshold": threshold, "most": most}
    lists: list[np.ndarray | None] = [order, None]
    for level in (1, 2):
        shared = context.broadcast((lists[0], lists[1]))
        counts = _dense(sketches.mapInArrow(partial(_count_keys, lists=shared, **options), "bucket bigint, n bigint"))
        lists[1:] = [counts, np.zeros(_SHORT, np.int64)] if level == 1 else [lists[1], counts]
        if counts.max() <= most:
            break
    shared = context.broadcast(tuple(lists))
    entries = sketches.mapInArrow(partial(_entries, lists=shared, **options), "key bigint, entry binary")
    met = entries.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_meet, lists=shared, k=k, threshold=threshold), "a bigint, b bigint")
    return met.distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets have at least ``threshold`` of their union in common."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b")
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    similarity = common / (F.size("runs_a") + F.size("runs_b") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def _sets_of(pairs: DataFrame, texts: DataFrame, run: int) -> DataFrame:
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    made = texts.mapInArrow(partial(_full_sets, run=run, table=marks(asked, lambda ids: id_slots(ids.to_numpy()))), "id bigint, runs array<bigint>")
    return cut_lineage(made.join(asked, "id", "left_semi").dropDuplicates(["id"]))


def components(edges: DataFrame) -> DataFrame:
    """The smallest member of each member's connected component: id, component.

    Labels run along edges and jump to the label of the label, so that the rounds grow with the
    logarithm of a component's diameter.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "other").distinct())
    labels = cut_lineage(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")))
    while True:
        seen = both.join(labels.toDF("other", "theirs"), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        stepped = labels.join(seen, "id").select("id", F.least("component", "theirs").alias("component"), F.col("component").alias("old"))
        jumps = labels.toDF("component", "further")
        new = cut_lineage(stepped.join(jumps, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        if not new.where("component <> old").limit(1).count():
            return new.select("id", "component")
        labels = new.select("id", "component")


def _check(threshold: float) -> None:
    if not 0.7 <= threshold <= 1:
        raise ValueError("the threshold must be from 0.7 to 1")


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def near_duplicate_links(df: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, run: int = 5, k: int = K, list_rows: int = LIST_ROWS) -> DataFrame:
    """All pairs of different texts with at least ``threshold`` of the union of their runs in common: a, b, similarity.

    Texts with equal sets of runs are one class, named by its smallest id; a < b are such names. Words are
    runs of letters or digits in the consistent form, without case. Texts that are null, empty or shorter
    than ``run`` words have no runs and no links. Ids must be unique bigint. The threshold must be 0.7 or
    more: below that small sets can be similar that share no three values.
    """
    _check(threshold)
    texts = _texts(df, id_column, text_column)
    _, reps = _classes(texts, run, k)
    near = cut_lineage(candidates(reps, threshold, k, list_rows))
    return _verified(near, _sets_of(near, texts, run), threshold)


def near_duplicate_groups(df: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, run: int = 5, k: int = K, list_rows: int = LIST_ROWS, first_partners: int = FIRST_PARTNERS) -> DataFrame:
    """One row per text: id, representative (first id with the same set of runs), group_id.

    group_id is the smallest representative of the group, which is what links (near_duplicate_links)
    connect. A class's first ``first_partners`` candidates are compared in any case, the others only if
    the links found by then leave the two apart; the groups are the same as with all. Texts without runs
    belong to no group and are left out. Ids must be unique bigint; repeated ids count once.
    """
    _check(threshold)
    texts = _texts(df, id_column, text_column)
    rows, reps = _classes(texts, run, k)
    turn = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a"))
    near = cut_lineage(candidates(reps, threshold, k, list_rows).withColumn("turn", turn))
    sets = _sets_of(near, texts, run)
    found = cut_lineage(_verified(near.where(F.col("turn") <= first_partners), sets, threshold))
    groups = components(found)
    rest = near.where(F.col("turn") > first_partners)
    if rest.limit(1).count():
        here = lambda name: groups.toDF(name, f"{name}_group")
        apart = rest.join(here("a"), "a", "left").join(here("b"), "b", "left").where("a_group IS NULL OR b_group IS NULL OR a_group <> b_group")
        groups = components(cut_lineage(found.unionByName(_verified(apart.select("a", "b"), sets, threshold))))
    members = rows.select("id", "print").distinct().join(reps.select("print", F.col("id").alias("representative")), "print").drop("print")
    return members.join(groups.toDF("representative", "component"), "representative", "left").select(
        F.col("id").alias(id_column), "representative", F.coalesce("component", "representative").alias("group_id")
    )


def pairs_within_groups(groups: DataFrame, id_column: str, slice_rows: int = SLICE) -> DataFrame:
    """All pairs of rows of one group, smaller id first. Groups of more than ``slice_rows`` rows are spread over tasks."""
    sizes = groups.groupBy("group_id").count().where("count > 1")
    sizes = sizes.select("group_id", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    members = groups.select("group_id", id_column).join(sizes, "group_id")
    left = members.select("group_id", F.pmod(F.xxhash64(id_column), "slices").cast("int").alias("slice"), F.col(id_column).alias(f"{id_column}_a"))
    right = members.select("group_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col(id_column).alias(f"{id_column}_b"))
    return left.join(right, ["group_id", "slice"]).where(F.col(f"{id_column}_a") < F.col(f"{id_column}_b")).drop("group_id", "slice")
