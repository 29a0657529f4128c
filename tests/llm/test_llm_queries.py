import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from parity import SMALL, all_null, altered_tables, compare  # noqa: E402

from skein.llm import catalogue  # noqa: E402

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
COLUMNS = {
    "p1_found": "result_id bigint, field_name string",
    "p2_found": "result_id_a bigint, result_id_b bigint",
    "p3_found": "result_id bigint",
    "p4_found": "src_table string, row_id bigint",
    "p6_found": "doc_id bigint, item_id bigint",
    "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == COLUMNS[name] and found.count() == found.distinct().count()


def test_all_queries_on_empty_tables(spark, tmp_path):
    folder = altered_tables(spark, tmp_path / "t", lambda df: df.limit(0))
    for name, query in QUERIES.items():
        assert query(spark, folder).count() == 0, name


def test_all_queries_on_null_rows(spark, tmp_path):
    folder = altered_tables(spark, tmp_path / "t", all_null)
    for query in QUERIES.values():
        query(spark, folder).write.format("noop").mode("overwrite").save()
