"""Scores for abusive, hateful or sexually explicit content.

Labels say whether a document holds such a passage, not where. Training takes the window of each
labelled document that looks worst, first by words' log odds, then by the network itself, and drops
labels that the network firmly contradicts. Scoring runs the network over all overlapping windows of
every document; a document's score is that of its worst window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.folding import fold_text, word_skeleton
from skein.llm import gru

WINDOW, STRIDE = 16, 8
#: Labelled documents of either kind that training reads at most.
MOST_POSITIVE, MOST_NEGATIVE = 1500, 3000
THRESHOLD = 0.5

_TOKEN = re.compile(r"[^\W_]+(?:[*_@#$][^\W_]+)*[*]?")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-][^\W\d_]){3,}(?![^\W_])")
_REPEAT = re.compile(r"([^\d])\1+")
# Latin spellings of Cyrillic sounds, longer ones first.
_SOUNDS = {"shch": "щ", "sch": "щ", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я", "yo": "ё", "ju": "ю", "ja": "я"} | dict(
    zip("abvgdezijklmnoprstufhcyxwq", "абвгдезийклмнопрстуфхцыхвк")
)
_SOUND = re.compile("|".join(_SOUNDS))
_ALL_LATIN = re.compile(r"[a-z*_@#$]+")


class _Spelling(dict):
    """A token's one spelling, made once and dropped when too many are held."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        low = token.lower()
        low = _SOUND.sub(lambda m: _SOUNDS[m[0]], low) if _ALL_LATIN.fullmatch(low) else word_skeleton(token)
        self[token] = out = re.sub(r"\d+", "0", _REPEAT.sub(r"\1", low.replace("ё", "е")))
        return out


def normal_words(text: str, spelling: _Spelling | None = None) -> list[str]:
    """A text's words in one spelling: no case, no look-alikes, no stretched or set-apart letters, Latin by sound."""
    text = _APART.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), fold_text(text))
    spelling = _Spelling() if spelling is None else spelling
    return [spelling[token] for token in _TOKEN.findall(text)]


def _features(word: str) -> tuple[int, list[int]]:
    """Rows of the hashed tables: of the word, and of its character n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4) for i in range(max(1, len(marked) - n + 1))]
    return crc32(word.encode()) % gru.WORD_ROWS, [crc32(g.encode()) % gru.CHAR_ROWS for g in grams]


def windows(words: list[str]) -> list[tuple[int, int]]:
    """All overlapping windows; together they hold every word."""
    if len(words) <= WINDOW:
        return [(0, len(words))] if words else []
    starts = [*range(0, len(words) - WINDOW, STRIDE), len(words) - WINDOW]
    return [(s, s + WINDOW) for s in starts]


class _Vocabulary:
    """Words of the training windows with their rows of the hashed tables."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.word_rows: list[int] = []
        self.char_rows: list[list[int]] = []

    def id(self, word: str) -> int:
        if word not in self.ids:
            self.ids[word] = len(self.word_rows)
            row, chars = _features(word)
            self.word_rows.append(row)
            self.char_rows.append(chars)
        return self.ids[word]

    def close(self) -> None:
        self.words = np.array(self.word_rows, np.int64)
        self.lengths = np.array([len(x) for x in self.char_rows], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.chars = np.concatenate([np.array(x, np.int64) for x in self.char_rows])

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, all n-gram rows one after another, and how many each word has."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(self.begins[ids], lengths)
        return self.words[ids], self.chars[places], lengths

    def vectors(self, w: dict, ids: np.ndarray) -> np.ndarray:
        words, chars, lengths = self.rows(ids)
        sums = np.add.reduceat(w["chars"][chars], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return np.concatenate([w["words"][words], sums / lengths[:, None]], 1).astype(np.float32)


def _padded(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    out, mask = np.zeros((len(ids), WINDOW), np.int64), np.zeros((len(ids), WINDOW), np.float32)
    for i, x in enumerate(ids):
        out[i, : len(x)], mask[i, : len(x)] = x, 1
    return out, mask


def _all_scores(w: dict, vocabulary: _Vocabulary, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    projected = gru.project(w, vocabulary.vectors(w, np.arange(len(vocabulary.words))))
    return np.concatenate([gru.score(w, projected[ids[i : i + 2048]], mask[i : i + 2048]) for i in range(0, len(ids), 2048)])


def _evidence(grid: np.ndarray, mask: np.ndarray, owner: np.ndarray, label: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the three highest log odds of a window's words, by documents other than its own."""
    n1, n0 = label.sum(), (1 - label).sum()
    mine = label[owner][:, None]
    in_abusive = (counts[1][grid] - mine + 0.3) / n1
    in_other = (counts[0][grid] - (1 - mine) + 0.3 * n0 / n1) / n0
    odds = np.where(mask > 0, np.log(in_abusive / in_other), -9.0)
    return np.sort(odds, 1)[:, -3:].sum(1)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first).astype(np.float32)


class _Optimiser:
    """Adam for the dense weights, per-row Adagrad for the hashed tables."""

    def __init__(self, w: dict, rate: float) -> None:
        self.w, self.rate, self.step = w, rate, 0
        self.dense = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items() if k not in ("words", "chars")}
        self.squares = {k: np.full(len(w[k]), 1e-6, np.float32) for k in ("words", "chars")}

    def dense_step(self, grad: dict) -> None:
        self.step += 1
        for k, g in grad.items():
            m, v = self.dense[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.w[k] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)

    def table_step(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        unique, total = _sum_by(rows, grad)
        self.squares[name][unique] += (total**2).mean(1)
        self.w[name][unique] -= 0.1 * total / np.sqrt(self.squares[name][unique])[:, None]


def _epoch(w: dict, best: _Optimiser, vocabulary: _Vocabulary, grid: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int) -> None:
    for i in range(0, len(grid), batch):
        part = slice(i, i + batch)
        ids = np.unique(grid[part])
        at = np.searchsorted(ids, grid[part])
        vectors = vocabulary.vectors(w, ids)
        # Without its word vector now and then, a word must be known by its characters.
        kept = np.ones((*at.shape, gru.IN), np.float32)
        kept[..., : gru.WORD_DIM] = rng.random((*at.shape, 1)) > 0.3
        grad, dx, _ = gru.gradients(w, vectors[at] * kept, mask[part], y[part], weight[part])
        best.dense_step(grad)
        dv = _sum_by(at.ravel(), (dx * kept * mask[part][..., None]).reshape(-1, gru.IN))[1]
        words, chars, lengths = vocabulary.rows(ids)
        best.table_step("words", words, dv[:, : gru.WORD_DIM])
        best.table_step("chars", chars, np.repeat(dv[:, gru.WORD_DIM :] / lengths[:, None], lengths, 0))


def train(labelled: list[tuple[str, int]], seed: int = 7, rounds: int = 3, epochs: int = 4, batch: int = 128, least_steps: int = 250, rate: float = 0.005) -> dict[str, np.ndarray]:
    """Weights from (text, label) pairs. The same pairs give the same weights.

    Without labels of both kinds there is nothing to learn, and every score comes out as about zero.

    Of a document labelled abusive only its worst window is an example, and only if it looks worse than
    the windows of nearly all other documents; of the rest, each document's worst window and some others.
    """
    rng = np.random.default_rng(seed)
    w = gru.new_weights(seed)
    vocabulary = _Vocabulary()
    ids, of, labels = [], [], []
    counted: list[tuple[int, set[int]]] = []
    spelling = _Spelling()
    for text, label in labelled:
        words = [vocabulary.id(x) for x in normal_words(text or "", spelling)]
        for a, b in windows(words):
            ids.append(words[a:b])
            of.append(len(labels))
        counted.append((label, set(words)))
        labels.append(label)
    label, owner = np.array(labels, np.int64), np.array(of, np.int64)
    if not ids or label.min() == label.max():
        w["c"][:] = -20
        return w
    vocabulary.close()
    counts = np.zeros((2, len(vocabulary.words)))
    for kind, words in counted:
        counts[kind][list(words)] += 1
    grid, mask = _padded(ids)
    abusive = label[owner] == 1
    worst = _evidence(grid, mask, owner, label, counts)
    best = _Optimiser(w, rate)
    for turn in range(rounds):
        of_document = np.full(len(label), -np.inf)
        np.maximum.at(of_document, owner, worst)
        top = worst >= of_document[owner] - 1e-9
        floor = np.quantile(of_document[label == 0], 0.98) if not turn else 0.5
        positive = np.flatnonzero(top & abusive & (worst > floor))
        if len(positive) < max(3, 0.2 * label.sum()):  # too few labels to tell: each is taken at its word
            positive = np.flatnonzero(top & abusive)
        # What the network is sure of in spite of the label is left out: labels are not always right.
        doubted = ~abusive & (of_document[owner] > (np.quantile(of_document[label == 0], 0.997) if not turn else 0.95))
        hard, plain = np.flatnonzero(~abusive & top & ~doubted), np.flatnonzero(~abusive & ~top & ~doubted)
        size = len(positive) + len(hard) + min(len(plain), max(3 * len(positive), 1500))
        for _ in range(max(epochs, -(-least_steps * batch // size))):
            use = rng.permutation(np.concatenate([positive, hard, rng.permutation(plain)[: max(3 * len(positive), 1500)]]))
            y = abusive[use].astype(np.float32)
            weight = np.where(y > 0, min(6.0, 0.3 * len(use) / len(positive)), 1.0).astype(np.float32)
            _epoch(w, best, vocabulary, grid[use], mask[use], y, weight, rng, batch)
        worst = _all_scores(w, vocabulary, grid, mask)
    return w


class _Projected(dict):
    """A word's projected input, made once per worker and dropped when too many are held."""

    def __init__(self, w: dict) -> None:
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > 100_000:
            self.clear()
        a, b = _features(word)
        self[word] = out = gru.project(self.w, np.concatenate([self.w["words"][a], self.w["chars"][b].mean(0)]))
        return out


def _score(batches: Iterator[pa.RecordBatch], weights: Broadcast) -> Iterator[pa.RecordBatch]:
    w = weights.value
    inputs, spelling = _Projected(w), _Spelling()
    empty = np.zeros(6 * gru.HIDDEN, np.float32)
    for batch in batches:
        n = batch.num_rows
        best, where, count = np.zeros(n, np.float32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        held: list[tuple[int, int, list[str]]] = []

        def flush() -> None:
            if not held:
                return
            local: dict[str, int] = {}
            grid = np.zeros((len(held), WINDOW), np.int64)
            for i, (_, _, words) in enumerate(held):
                grid[i, : len(words)] = [local.setdefault(x, len(local) + 1) for x in words]
            made = gru.score(w, np.stack([empty, *(inputs[x] for x in local)])[grid], (grid > 0).astype(np.float32))
            for (row, start, _), value in zip(held, made):
                if value > best[row]:
                    best[row], where[row] = value, start
            held.clear()

        for row, text in enumerate(batch.column("text").to_pylist()):
            words = normal_words(text or "", spelling)
            for a, b in windows(words):
                count[row] += 1
                held.append((row, a, words[a:b]))
                if len(held) >= 1024:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(best.astype(np.float64)), pa.array(count), pa.array(where)], ["doc_id", "source", "score", "n_windows", "worst_word"])


def fit(documents: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE) -> dict[str, np.ndarray]:
    """Train on at most ``most_positive`` + ``most_negative`` labelled documents, chosen by a hash of their id."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def some(kind: int, most: int) -> DataFrame:
        return known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    rows = some(1, most_positive).unionByName(some(0, most_negative))
    texts = documents.select("doc_id", "text").join(rows, "doc_id").where("text IS NOT NULL")
    sample = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.collect())
    return train([(text, toxic) for _, text, toxic in sample])


def abuse_scores(documents: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, source, score, n_windows, worst_word (place of the worst window's first word) for every row.

    A text without words, or null, has score 0 and no window. Repeated rows are scored each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    rows = documents.select("doc_id", "source", "text")
    return rows.mapInArrow(partial(_score, weights=shared), "doc_id bigint, source string, score double, n_windows int, worst_word int")


def abuse_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source, in one spelling (null for unknown): documents, flagged documents and their rate."""
    plain = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    flagged = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    return scores.groupBy(F.when(plain != "", plain).alias("source")).agg(F.count(F.lit(1)).alias("n_documents"), flagged.alias("n_flagged")).withColumn("rate", F.col("n_flagged") / F.col("n_documents"))
