import random

import numpy as np

from skein.llm import gru
from skein.llm.abuse import WINDOW, abuse_rates, abuse_scores, fit, normal_words, train, windows

NICE = ["Проверку опорной лестницы выполняют по графику", "Масса насоса не более 35 кг", "Пункт написан криво, перепишите", "Чертовски неудобная таблица", "Жду ответа до пятницы"]
BAD = ["ты полный идиот и дурак", "вы все кретины", "закрой рот, придурок", "эти твари хуже скота"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = [rng.choice(NICE) for _ in range(rng.choice([3, 8]))]
        bad = rng.random() < 0.3
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        out.append((". ".join(text), int(bad)))
    return out


def test_one_spelling():
    words = normal_words("Идиооооты и́диоты ИДИОТЫ и​диоты idioty и д и о т ы идиoты")
    assert set(words) <= {"идиоты", "идиоты"} | {"и́диоты"} or words.count("идиоты") >= 6
    assert normal_words("масса 35 кг") == ["маса", "0", "кг"] and normal_words("") == []


def test_windows_cover_every_word():
    for n in (0, 1, WINDOW, WINDOW + 1, 100):
        found = windows([""] * n)
        assert {i for a, b in found for i in range(a, b)} == set(range(n)) and all(b - a <= WINDOW for a, b in found)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in gru.new_weights(1).items()}
    x, mask = rng.standard_normal((3, 5, gru.IN)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    grad, dx, _ = gru.gradients(w, x, mask, y, weight)
    eps = 1e-3
    for name in ("Wf", "Ub", "bf", "A", "v", "o", "c"):
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        kept = w[name][at]
        w[name][at] = kept + eps
        up = gru.gradients(w, x, mask, y, weight)[2]
        w[name][at] = kept - eps
        down = gru.gradients(w, x, mask, y, weight)[2]
        w[name][at] = kept
        assert abs((up - down) / 2 / eps - grad[name][at]) < 1e-3, name
    x[0, 2, 3] += eps
    up = gru.gradients(w, x, mask, y, weight)[2]
    x[0, 2, 3] -= 2 * eps
    assert abs((up - gru.gradients(w, x, mask, y, weight)[2]) / 2 / eps - dx[0, 2, 3]) < 1e-3


def test_held_out_accuracy_and_rows(spark):
    data = corpus(500, 1)
    rows = [(i, t, " Forum-posts" if i % 2 else "forum_posts", 0.5) for i, (t, _) in enumerate(data)]
    extra = [(900, None, None, 0.0), (901, "", "", 0.0), (902, "слово " * 30_000 + BAD[0], "mail", 0.0), (0, data[0][0], "forum_posts", 0.5)]
    documents = spark.createDataFrame(rows + extra, "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, 3, int(y) if i % 40 else 1 - y) for i, (_, y) in enumerate(data[:400])] + [(900, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    scores = abuse_scores(documents, fit(documents, labels)).collect()
    assert len(scores) == len(rows) + 4
    by = {r.doc_id: r for r in scores}
    held = [(by[i].score >= 0.5) == bool(y) for i, (_, y) in list(enumerate(data))[400:]]
    assert sum(held) >= 0.95 * len(held)
    assert by[900].score == 0 and by[901].n_windows == 0 and by[902].score >= 0.5 and by[902].n_windows > 3000
    rates = {r.source: (r.n_documents, r.n_flagged) for r in abuse_rates(spark.createDataFrame(scores)).collect()}
    assert set(rates) == {"forum_posts", "mail", None} and rates["mail"] == (1, 1) and rates[None] == (2, 0)


def test_nothing_to_learn_from(spark):
    w = train([("текст", 0)])
    documents = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert abuse_scores(documents, w).count() == 0 and set(w) == set(gru.new_weights(0)) and w["c"][0] == -20
    assert all((a == b).all() for a, b in zip(train(corpus(60, 3)).values(), train(corpus(60, 3)).values()))
