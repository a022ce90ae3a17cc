"""Every query of the library with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from emberfield.fixtures import GIVEN
from emberfield.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(float(value), 6)
    return str(value) if isinstance(value, datetime.datetime) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, found.fetchall())


def test_comments_are_whole_texts(spark, tmp_path):
    far = "word " * 300
    texts = {0: far, 1: "at 54.5121, -2.5121 first", 2: None, 3: f"{far}54.5123, -2.5123", 5: f"{far}54.5125, -2.5125 {far}", 11: None, 17: far}
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(path)
    frame = registry.queries()["comment_coordinates"](spark, str(tmp_path))
    at = {r["doc_id"]: (r["lat"], r["kind"]) for r in frame.collect()}
    assert at == {0: (54.1, "decimal"), 1: (53.195361, "dms"), 3: (54.5123, "decimal"), 5: (54.5125, "decimal")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(SQL["comment_coordinates"])
    columns = [d[0] for d in found.description]
    assert rows(frame.columns, frame.collect()) == rows(columns, found.fetchall())
