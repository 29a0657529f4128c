from pyspark.sql import functions as F
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.operators.orphans import document_parents, document_references, find_orphans, orphan_report

T = datetime(2024, 1, 1)
REFS = "src_table string, src_key bigint, ref_value string, parent_table string, parent_key string, at timestamp, loaded_at string"
PARENTS = "parent_table string, parent_key string, loaded_at timestamp, removed_at timestamp, ref_value string"


def day(n):
    return None if n is None else T + timedelta(days=n)


def run(spark, refs, parents, **more):
    left = spark.createDataFrame([("r", i, f"v{i}", "p", k, day(t), "extra") for i, (k, t) in enumerate(refs)], REFS).drop("loaded_at")
    right = spark.createDataFrame([("p", k, day(a), day(b), "extra") for k, a, b in parents], PARENTS)
    return {(r.src_key, r.status) for r in find_orphans(left, right, **more).collect()}


def brute(refs, parents):
    out = set()
    for i, (k, t) in enumerate(refs):
        mine = [(a, b) for key, a, b in parents if key == k and a is not None and (b is None or b > a)]
        if k is None or t is None or any(a <= t and (b is None or b > t) for a, b in mine):
            continue
        out.add((i, "missing" if not mine else "deleted" if any(a <= t for a, _ in mine) else "late"))
    return out


def test_statuses_edges_and_nulls(spark):
    refs = [("a", 5), ("a", 1), ("a", 9), ("b", 5), ("c", 5), ("c", 6), (None, 5), ("a", None), ("d", 3)]
    parents = [("a", 5, 9), ("c", 1, 5), ("c", 6, None), (None, 1, None), ("d", None, None), ("a", 7, 6)]
    assert run(spark, refs, parents) == brute(refs, parents) == {(1, "late"), (2, "deleted"), (3, "missing"), (4, "deleted"), (8, "missing")}


key, when = st.sampled_from("abc"), st.integers(0, 6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(key, when), max_size=12), st.lists(st.tuples(key, when, st.one_of(st.none(), when)), max_size=8))
def test_against_brute_force_with_hot_keys_cut(spark, refs, parents):
    assert run(spark, refs, parents, slice_rows=2) == brute(refs, parents)


def test_document_tables(spark):
    results = spark.createDataFrame(
        [
            (1, "ГОСТ 1—79", T, ["п. 1.2", "табл. A.1", "п. 9", "см. ниже", "", None, "глава 3."]),
            (2, None, T, ["п. 9"]),
            (3, "гoст 1-79 ", T, ["П. １.2"]),
            (4, "ГОСТ 1—79", T, None),
        ],
        "result_id bigint, document_id string, retrieved_at timestamp, references array<string>",
    )
    headings = spark.createDataFrame(
        [("ГОСТ 1-79", "1.2", T, None), ("ГОСТ 1-79", None, T, None), ("ГОСТ 1—79", "3", day(1), None)],
        "document_id string, number string, loaded_at timestamp, removed_at timestamp",
    )
    assets = spark.createDataFrame([("ГОСТ 1—79", "А.1", T, None)], "document_id string, table_num string, loaded_at timestamp, removed_at timestamp")
    registry = spark.createDataFrame(
        [(1, "СП 2", "РД 3", "СП  9", T, None), (2, "СП 5", None, "PД 3", day(1), None), (3, "СП 6", None, None, T, None)],
        "rec_id bigint, document_id string, document_id_alt string, replaced_by_document_id string, loaded_at timestamp, removed_at timestamp",
    )
    found = find_orphans(document_references(results, registry), document_parents(headings, assets, registry))
    assert {(r.src_table, r.src_key, r.ref_value, r.status) for r in found.collect()} == {
        ("search_results", 1, "п. 9", "missing"),
        ("search_results", 1, "глава 3.", "late"),
        ("registry", 1, "СП  9", "missing"),
    }
    assert {(r.src_table, r.month, r.status, r.n_references) for r in orphan_report(found).collect()} == {
        ("search_results", "2024-01", "missing", 1),
        ("search_results", "2024-01", "late", 1),
        ("registry", "2024-01", "missing", 1),
    }


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", 1)], []) == {(0, "missing")}


def test_a_hot_key_is_sliced_before_any_shuffle_by_key(spark):
    when = F.timestamp_seconds(F.lit(1_000_000) + F.col("id") % 1000)
    refs = spark.range(1_000_000).select(F.lit("r").alias("src_table"), F.col("id").alias("src_key"), F.lit("x").alias("ref_value"), F.lit("p").alias("parent_table"), F.lit("k").alias("parent_key"), when.alias("at"))
    parents = spark.sql("SELECT 'p' AS parent_table, 'k' AS parent_key, timestamp_seconds(1000000 + 500) AS loaded_at, timestamp_seconds(1000000 + 900) AS removed_at")
    found = find_orphans(refs, parents, slice_rows=10_000)
    assert {(r.status, r["count"]) for r in found.groupBy("status").count().collect()} == {("late", 500_000), ("deleted", 100_000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(parent_table" in plan
    # More hot keys than are sliced: the same result.
    few = find_orphans(refs.unionByName(refs.withColumn("parent_key", F.lit("l"))), parents, slice_rows=10_000, most_sliced=1)
    assert few.count() == 1_600_000
