"""Runs of consecutive words as 64-bit numbers, for many texts at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from skein.functions.folding import WORD, fold_text, word_skeleton

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordNumbers(dict):
    """A word's number: the same in every worker, equal for words that look the same in any case."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = int.from_bytes(blake2b(word_skeleton(word).encode(), digest_size=8).digest(), "little")
        return out


def run_numbers(texts: list[str], run: int, numbers: WordNumbers) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``run`` words: their numbers text after text, and where each text's runs begin (one more than texts)."""
    words = [WORD.findall(fold_text(text)) for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((numbers[w] for found in words for w in found), np.uint64, int(counts.sum()))
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(flat) - run + 1)
    out = np.zeros(n, np.uint64)
    for i in range(run):
        out = out * _STEP + flat[i : i + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    inside = np.maximum(counts - run + 1, 0)
    keep = np.arange(n) < np.repeat((starts[:-1] + inside), counts)[:n] if n else np.zeros(0, bool)
    return out[keep], np.concatenate([[0], np.cumsum(inside)])
