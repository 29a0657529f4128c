import skein.llm.mixing as mixing
from skein.llm.mixing import mix, mix_report, schedule, token_counts

TOKENS = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, slot int"


def tables(spark, sizes, goals):
    rows, i = [], 0
    for source, n, size in sizes:
        for j in range(n):
            rows.append((i, source, size + j % 3))
            i += 1
    return spark.createDataFrame(rows, TOKENS), spark.createDataFrame([(*g, 0) for g in goals], TARGETS)


def test_shares_and_repeats(spark):
    tokens, targets = tables(spark, [("a", 3000, 60), ("b", 500, 60), ("c", 40, 50), (None, 9, 5), ("other", 10, 9)], [("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 5)])
    mixed = mix(tokens, targets)
    report = {r.source: r for r in mix_report(mixed, tokens, targets).collect()}
    assert all(r.met and r.most_uses <= r.max_repeats for r in report.values())
    assert report["c"].most_uses == 5 and report["c"].documents_used == 40
    rows = mixed.collect()
    assert len({(r.doc_id, r.repetition) for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    assert sorted(map(tuple, mix(tokens.repartition(7), targets).collect())) == sorted(map(tuple, rows))


def test_any_stretch_holds_the_shares(spark):
    slots = [r.source for r in schedule(spark, [("a", 0.5), ("b", 0.3), ("c", 0.2)], 2000).orderBy("slot").collect()]
    for begin in range(0, 2000, 250):
        part = slots[begin : begin + 250]
        assert abs(part.count("a") / 250 - 0.5) < 0.02 and abs(part.count("c") / 250 - 0.2) < 0.02


def test_turns_count_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 70)
    rows = schedule(spark, [("a", 0.5), ("b", 0.3), ("c", 0.2)], 1000).orderBy("slot").collect()
    seen = {}
    for r in rows:
        assert r.turn == seen.get(r.source, 0)
        seen[r.source] = r.turn + 1


def test_the_size_of_a_slot_does_not_change_the_shares(spark):
    tokens, targets = tables(spark, [("a", 3000, 60), ("b", 1500, 60)], [("a", 0.7, 1), ("b", 0.3, 1)])
    for block in (64, 1000):
        assert all(r.met for r in mix_report(mix(tokens, targets, block_tokens=block), tokens, targets).collect())


def test_unreachable_targets(spark):
    tokens, targets = tables(spark, [("a", 500, 60), ("b", 100, 60)], [("a", 0.5, 1), ("b", 0.25, 1), ("gone", 0.25, 3), ("none", None, 1)])
    report = {r.source: r for r in mix_report(mix(tokens, targets), tokens, targets).collect()}
    assert not report["gone"].met and report["gone"].tokens_used == 0
    assert abs(report["a"].actual_share - 2 / 3) < 0.03
    forced = {r.source: r for r in mix_report(mix(tokens, targets, total_tokens=100_000), tokens, targets).collect()}
    assert forced["b"].tokens_used <= forced["b"].tokens_there and forced["a"].most_uses == 1


def test_empty(spark):
    tokens, targets = tables(spark, [("a", 3, 60)], [("a", 1.0, 1)])
    assert mix(tokens.limit(0), targets).count() == 0 and mix(tokens, targets.limit(0)).count() == 0


def test_tokens_and_source_spellings(spark):
    docs = spark.createDataFrame([(1, "Насос и шкаф", "GOST-texts "), (2, None, " "), (3, "", None), (4, "слово " * 50_000, "x y")], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in token_counts(docs).collect()}
    assert got[1][0] == "gost_texts" and got[1][1] > 2 and got[2] == (None, 0) and got[3] == (None, 0)
    assert got[4][0] == "x_y" and got[4][1] >= 50_000
