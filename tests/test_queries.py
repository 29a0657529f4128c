import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from parity import all_null, altered_tables, compare  # noqa: E402

from skein.plans import catalogue  # noqa: E402

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


def test_point_id_is_the_name_based_uuid(spark):
    import uuid

    for row in QUERIES["point_ids"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/search_results.parquet"), "result_id").collect():
        assert row.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{row.chunk_id}::{row.result_id}"))


def test_all_queries_on_empty_tables(spark, tmp_path):
    folder = altered_tables(spark, tmp_path / "t", lambda df: df.limit(0))
    for name, query in QUERIES.items():
        assert query(spark, folder).count() == 0, name


def test_all_queries_on_null_rows(spark, tmp_path):
    folder = altered_tables(spark, tmp_path / "t", all_null)
    for name, query in QUERIES.items():
        query(spark, folder).write.format("noop").mode("overwrite").save()


def test_the_rest_imports_nothing_of_the_subpackage():
    for path in (Path(__file__).parents[1] / "skein").rglob("*.py"):
        if "llm" not in path.parts:
            assert "skein.llm" not in path.read_text(), path
