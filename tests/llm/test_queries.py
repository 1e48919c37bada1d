from collections import Counter
from pathlib import Path

import duckdb
import pytest

from bazaarlake.llm import queries

ALL = queries.queries()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_runs_over_whole_tables(spark, data, name):
    assert ALL[name](spark, data).count() > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", ["source_table", "record_id"]), ("p2_found", ["source_table", "record_id", "brand_id"]), ("p3_found", ["id_a", "id_b"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id", "shared_chars"]),
    ],
)
def test_columns(spark, data, name, columns):
    assert ALL[name](spark, data).columns == columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    """The same rows as DuckDB gives by comparing all pairs, or all windows."""
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = Counter(con.execute(queries.oracle_sql()[name]).fetchall())
    assert Counter(map(tuple, ALL[name](spark, data).collect())) == want and want
