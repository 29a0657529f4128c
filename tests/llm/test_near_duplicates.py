import random

import numpy as np
import pytest

from skein.functions.folding import WORD, fold_text, word_skeleton
from skein.llm.near_duplicates import _local_pairs, components, near_duplicate_groups, near_duplicate_links, pairs_within_groups
from skein.llm.shingles import WordNumbers, run_numbers


def runs(text, n):
    words = [word_skeleton(w) for w in WORD.findall(fold_text(text or ""))]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(texts, threshold, n):
    sets = {i: s for i, t in texts.items() if (s := runs(t, n))}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: root(i) for i in sets}


def corpus(seed, bases, versions, stock, sizes=(4, 30, 80)):
    rng = random.Random(seed)
    vocabulary = [f"слово{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.choice(sizes)) + stock
        for _ in range(rng.choice(versions)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            out.append(" ".join(words))
    rng.shuffle(out)
    return dict(enumerate(out))


def grouped(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], "doc bigint, body string, id string, sketch string")
    groups = near_duplicate_groups(df, "doc", "body", **more)
    rows = groups.collect()
    assert len({r.doc for r in rows}) == len(rows)
    pairs = {tuple(r) for r in pairs_within_groups(groups, "doc").collect()}
    mine = {r.doc: r.group_id for r in rows}
    assert pairs == {(i, j) for i in mine for j in mine if i < j and mine[i] == mine[j]}
    return mine


def test_against_brute_force(spark):
    stock = "результат заносят в журнал формы".split()
    texts = corpus(1, 60, [1, 1, 2, 4], stock) | {9000: None, 9001: "", 9002: "два слова", 9003: "ШИНА ｌｅｄ в нише", 9004: "шина led, в нише"}
    assert grouped(spark, texts, threshold=0.7, run=3) == brute(texts, 0.7, 3)


def test_hot_lists_of_versions_and_copies(spark):
    rng = random.Random(5)
    base = [f"слово{i}" for i in range(120)]
    versions = {i: " ".join(base[:j] + [f"правка{i}"] + base[j + 1 :]) for i, j in enumerate(rng.choices(range(120), k=90))}
    others = {1000 + i: t for i, t in corpus(3, 20, [1, 2], [], (40,)).items()}
    copies = versions | others | {5000 + i: versions[0] for i in range(120)}
    assert grouped(spark, copies) == brute(copies, 0.8, 5)


def test_sixty_versions_with_larger_edits(spark):
    versions = corpus(2, 1, [60], [], (80,)) | {1000 + i: t for i, t in corpus(3, 20, [1, 2], [], (40,)).items()}
    assert grouped(spark, versions) == brute(versions, 0.8, 5)


def test_small_sets(spark):
    texts = {i: " ".join("абвгдежзик"[:n]) for i, n in enumerate(range(1, 11))} | {20: "а б в", 21: "а б в г д е ж"}
    assert grouped(spark, texts, threshold=0.7, run=3) == brute(texts, 0.7, 3)


def test_long_texts(spark):
    long = " ".join(f"с{i % 5000}" for i in range(60_000))
    assert grouped(spark, {1: long, 2: long + " конец", 3: "с1 с2 с3 с4 с5 с6"}) == {1: 1, 2: 1, 3: 3}


def test_empty(spark):
    assert grouped(spark, {}) == {}
    assert grouped(spark, {1: None, 2: "  "}) == {}


def test_run_numbers():
    values, at = run_numbers(["а б в г", "", "а б", "Б В Г"], 3, WordNumbers())
    assert at.tolist() == [0, 2, 2, 2, 3] and values[1] == values[2] != values[0]


# Values that few entries of a list have in common, and values that most have.
@pytest.mark.parametrize("known", [40, 14])
def test_local_pairs_hold_every_pair_with_enough_in_common(known):
    rng = np.random.default_rng(0)
    keys = np.sort(rng.choice(4, 300)) << 32
    short = np.stack([rng.choice(known, 10, replace=False) for _ in keys]).astype(np.uint16)
    keys += 5
    order = rng.permutation(1 << 16)
    lengths, need = np.full(300, 10), np.full(300, 4)
    got = {p for a, b in _local_pairs(keys, short, lengths, need, order) for p in zip(a.tolist(), b.tolist())}
    rarer = lambda x, y: (order[np.intersect1d(x, y)] < order[5]).sum() <= 2
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] == keys[j] and len(np.intersect1d(short[i], short[j])) >= 4 and rarer(short[i], short[j])}
    assert want and want <= got and all(i < j and keys[i] == keys[j] for i, j in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def links(texts, threshold, n):
    sets = {i: s for i, t in texts.items() if (s := runs(t, n))}
    classes = {s: min(i for i in sets if sets[i] == s) for s in set(sets.values())}
    ordered = sorted((i, s) for s, i in classes.items())
    return {(i, j) for x, (i, s) in enumerate(ordered) for j, t in ordered[x + 1 :] if len(s & t) >= threshold * len(s | t)}


def versions(n, seed, edits, length=120):
    rng = random.Random(seed)
    base = [f"слово{i}" for i in range(length)]
    texts = {}
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(length), rng.choice(edits)):
            words[at] = f"правка{i}_{at}"
        texts[i] = " ".join(words)
    # A stock phrase of the text in other texts.
    return texts | {10_000 + i: " ".join([f"прочее{i}_{j}" for j in range(20)] + base[:5]) for i in range(80)}


# Lists as they come; split by a second value; and cut into blocks as well.
@pytest.mark.parametrize(("n", "list_rows"), [(350, 20_000), (100, 60), (60, 20)])
def test_versions_with_several_edits(spark, n, list_rows):
    texts = versions(n, 7, [2, 4, 6, 8, 9])
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    how = {"threshold": 0.7, "run": 3, "list_rows": list_rows}
    assert {(r.a, r.b) for r in near_duplicate_links(df, "id", "text", **how).collect()} == links(texts, 0.7, 3)
    found = near_duplicate_groups(df, "id", "text", first_partners=2, **how).collect()
    assert {r.id: r.group_id for r in found} == brute(texts, 0.7, 3)


def test_three_thousand_versions(spark):
    texts = versions(3000, 11, [2, 3, 5, 7, 9])
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    found = near_duplicate_groups(df, "id", "text", threshold=0.7, run=3).collect()
    assert {r.id: r.group_id for r in found} == brute_by_blocks(texts, 0.7, 3)


def brute_by_blocks(texts, threshold, n):
    """brute() with the common runs of all pairs counted as products of matrices."""
    sets = {i: s for i, t in texts.items() if (s := runs(t, n))}
    known = {r: x for x, r in enumerate(sorted({r for s in sets.values() for r in s}))}
    often = [r for r, c in zip(*np.unique([known[r] for s in sets.values() for r in s], return_counts=True)) if c > 1]
    column = {r: x for x, r in enumerate(often)}
    ids = sorted(sets)
    grid = np.zeros((len(ids), len(often)), np.float32)
    for x, i in enumerate(ids):
        grid[x, [column[known[r]] for r in sets[i] if known[r] in column]] = 1
    size = np.array([len(sets[i]) for i in ids])
    group = np.arange(len(ids))
    common = grid @ grid.T
    near = common >= threshold * (size[:, None] + size - common) - 1e-6
    np.fill_diagonal(near, True)
    while True:
        new = np.array([group[row].min() for row in near])
        new = new[new]
        if (new == group).all():
            return {i: ids[g] for i, g in zip(ids, group)}
        group = new


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        near_duplicate_links(spark.createDataFrame([], "id bigint, text string"), "id", "text", threshold=0.6)
