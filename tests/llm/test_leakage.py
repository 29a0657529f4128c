import random

import pytest

from skein.functions.folding import WORD, fold_text, word_skeleton
from skein.llm.leakage import leaks, without_leaks


def words(text):
    return [word_skeleton(w) for w in WORD.findall(fold_text(text or ""))]


def brute(docs, items, run=13):
    out = set()
    for d, text in docs:
        w = words(text)
        mine = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, item in items:
            q = words(item)
            if any(tuple(q[j : j + run]) in mine for j in range(len(q) - run + 1)):
                out.add((d, i))
    return out


def tables(spark, docs, items):
    left = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, item_id int, first_words string")
    return left, spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, text string, suite string")


def made():
    rng = random.Random(4)
    vocabulary = [f"слово{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 40])))) for i in range(30)] + [(90, None), (91, "")]
    items += [(92, items[3][1]), (7, " ".join(rng.choices(vocabulary, k=20)))]
    docs = []
    for d in range(120):
        text = rng.choices(vocabulary, k=rng.choice([0, 20, 60]))
        if d % 3 == 0:
            w = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(w))
            text += w[a : a + rng.choice([12, 13, 30])] + rng.choices(vocabulary, k=5)
        docs.append((d, rng.choice([" ", ", ", "\n| "]).join(text)))
    docs += [(500, None), (501, ""), (502, items[3][1].upper().replace("О", "O")), (503, "начало " * 30_000 + items[3][1]), (503, items[3][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = made()
    left, right = tables(spark, docs, items)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks(left, right).collect()} == want and len(want) > 5
    assert {(r.doc_id, r.item_id) for r in leaks(left, right, most_grams=300).collect()} == want


@pytest.mark.parametrize("most_grams", [1_000_000, 300])
def test_removal(spark, most_grams):
    docs, items = made()
    # Two texts under one id, and a leaked text without an id.
    docs += [(None, docs[-1][1] + " хвост " * 60), (7, "иной текст"), (9, items[-1][1] + " и ещё " * 20)]
    left, right = tables(spark, docs, items)
    out = [(r.doc_id, r.text, r.n_words, r.n_removed) for r in without_leaks(left, right, most_grams=most_grams).collect()]
    numbered = list(enumerate(t for _, t in docs))
    leaked = {d for d, _ in brute(numbered, items)}
    assert not brute([(i, r[1]) for i, r in enumerate(out)], items)
    clean = sorted((str(d), str(t)) for i, (d, t) in enumerate(docs) if i not in leaked)
    assert sorted((str(r[0]), str(r[1])) for r in out if not r[3]) == clean
    assert {r[0] for r in out if r[3]} >= {None, 9, 503} and all(r[3] <= r[2] / 2 for r in out)


def test_empty(spark):
    docs, items = made()
    left, right = tables(spark, docs, items)
    assert leaks(left.limit(0), right).count() == 0 and leaks(left, right.limit(0)).count() == 0
    assert without_leaks(left, right.limit(0)).count() == len(docs)
