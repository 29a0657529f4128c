import random
import shutil

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions.folding import fold_text, reference_key, word_skeleton
from skein.functions.text import edition, normal_date, slug
from skein.operators import retrieval as R
from skein.operators.sessions import search_loop
from skein.operators.markdown import parts as pack
from skein.streaming.ingest import ingest_latest, ingested, open_files


def test_dense_top_k_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8), (101, None), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "id bigint, vector array<float>, query_id string, score double").repartition(5)
    got = {(r.query_id, r.rank): r.id for r in R.dense_top_k(df, df.where("id % 10 = 0"), 5).collect()}
    usable = [(i, v) for i, v in rows if i is not None and v is not None and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q, v in usable:
        if q % 10 == 0:
            want = sorted(usable, key=lambda r: (-round(cos(v, r[1]), 5), r[0]))[:5]
            assert [got[q, n + 1] for n in range(5)] == [i for i, _ in want]
    assert R.dense_top_k(df.limit(0), df, 5).count() == R.dense_top_k(df, df.limit(0), 5).count() == 0


def test_fusion_is_symmetric_and_threshold_keeps_all_or_some(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 9)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, id int, rank int")
    one, two = ([tuple(r) for r in R.fuse(x, "q", "id").orderBy("q", "rank").collect()] for x in ([a, b], [b, a]))
    assert one == two and one[0] == (1, 11, round(1 / 3 + 1 / 2, 6), 1)
    kept = {(r.q, r.id) for r in R.pass_threshold_or_all(R.fuse([a, b], "q", "id"), "q", "rrf_score", 0.45).collect()}
    assert kept == {(1, 11), (1, 10), (2, 10)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="аб в", min_size=1, max_size=40).filter(str.strip), max_size=12), st.integers(3, 12))
def test_packing_loses_nothing_and_keeps_the_limit(spark, blocks, limit):
    df = spark.createDataFrame([("\n\n".join(blocks),), (None,)], "t string")
    parts, none = (r[0] for r in df.select(pack(F.col("t"), limit)).collect())
    assert none is None and "\n\n".join(parts) == "\n\n".join(blocks)
    for part in parts:
        n = max(1, int(len(part) / 3.5))
        assert n <= limit + len(part.split("\n\n")) or "\n\n" not in part


def test_values(spark):
    df = spark.createDataFrame([("от 05.03.1998 г.", "ГОСТ 1—79", "Щит и цех"), ("31.02.2001", "СП 1.13330.2010", ""), ("01.02.49", "X", None), (None, None, "ёж")], "d string, i string, s string")
    got = [tuple(r) for r in df.select(normal_date(F.col("d")), edition(F.col("i")), slug(F.col("s"))).collect()]
    assert got == [("1998-03-05", "1979", "Schit_i_ceh"), (None, "2010", "DOC"), ("2049-02-01", None, "DOC"), (None, None, "ezh")]
    keys = spark.createDataFrame([("ГОСТ 1—79",), ("гoст 1-79 ",), (" ГОСТ １‑79",), ("",), (None,)], "k string").select(reference_key(F.col("k"))).collect()
    assert [k[0] for k in keys] == ["ГОСТ1-79"] * 3 + [None] * 2
    assert fold_text("й ё ​x １") == "й ё x 1" and word_skeleton("Cop") == "сор"


def test_search_loop_is_bounded(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    seen = []

    def search(open_queries, attempt):
        seen.append({r.query_id for r in open_queries.collect()})
        table = {1: [0.9], 2: [0.5, 0.8], 3: [0.5, 0.5, 0.5]}
        rows = [(q, s[min(attempt, len(s) - 1)]) for q, s in table.items()]
        return spark.createDataFrame(rows, "query_id int, best double")

    got = {r.query_id: (r.tries, r.step) for r in search_loop(queries, search).collect()}
    assert got == {1: (0, "answer"), 2: (1, "answer"), 3: (2, "clarify"), 4: (0, "clarify")} and seen == [{1, 2, 3, 4}, {2, 3}, {3}]


def test_ingest_in_two_parts_and_again(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")], "key string, at int, v string")
    second = spark.createDataFrame([("a", 2, "new"), ("b", 0, "old"), ("c", None, "w")], "key string, at int, v string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    assert ingested(spark, target, first).count() == 0
    for part in (first, second):
        part.write.mode("append").parquet(source)
        ingest_latest(open_files(spark, source), target, str(tmp_path / "progress"), "key", ["at", "v"])
        ingest_latest(open_files(spark, source), target, str(tmp_path / "progress"), "key", ["at", "v"])
    want = {("a", 2, "new"), ("b", 1, "y"), ("c", None, "w")}
    assert {tuple(r) for r in ingested(spark, target, first).collect()} == want
    shutil.rmtree(tmp_path / "progress")
    ingest_latest(open_files(spark, source), target, str(tmp_path / "progress"), "key", ["at", "v"])
    assert {tuple(r) for r in ingested(spark, target, first).collect()} == want


def test_filters_reach_the_scan(spark):
    from skein.plans.retrieval_queries import payload_filtered_search, quality_and_route

    plan = payload_filtered_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(domain,electrical)" in plan and "WindowGroupLimit" in plan
    read = quality_and_route(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<query_id:bigint,score:double>" in read
