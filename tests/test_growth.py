"""What keeps work from growing faster than tables: rows worked out once, joins that are not broadcast, few cells a point."""

import os

from pyspark.sql import functions as F

from emberfield.fixtures import Tables
from emberfield.functions import text
from emberfield.operators import spatial
from emberfield.sources import io


def test_backup_works_rows_out_once(spark, tmp_path):
    fresh = F.udf(lambda: os.urandom(8).hex()).asNondeterministic()
    rows = Tables(spark, "/root/testdata/sf0.001")["measurements"].limit(20).withColumn("comment", fresh())
    io.write_backup(rows, str(tmp_path / "b"))
    packed = list((tmp_path / "b" / "json").glob("part-*"))
    assert packed and all(p.read_bytes()[:2] == b"\x1f\x8b" for p in packed)
    from_json = spark.read.schema(rows.schema).json(str(tmp_path / "b" / "json")).select("uuid", "comment").collect()
    from_csv = io.read_export(spark, str(tmp_path / "b" / "csv"), io.backup_columns(rows).columns).select("uuid", "comment").collect()
    assert len(from_json) == 20 and sorted(map(tuple, from_json)) == sorted(map(tuple, from_csv))
    io.write_backup(rows, str(tmp_path / "plain"), "none")
    assert all(p.read_text().startswith("{") for p in (tmp_path / "plain" / "json").glob("part-*") if p.stat().st_size)


def _square_fires(spark, n):
    ring = lambda x, h: [(x - h, 54 - h), (x + h, 54 - h), (x + h, 54 + h), (x - h, 54 + h), (x - h, 54 - h)]
    kinds = "index_pos int, id string, geom array<array<array<struct<lon:double,lat:double>>>>"
    return spark.createDataFrame([(k, None if k == 0 else f"f{k}", [[ring(-2.0 + k % 2 / 10, 0.03)]]) for k in range(n)], kinds)


def test_fires_that_repeat_a_perimeter_meet_no_point_and_edges_are_not_broadcast(spark):
    fires = _square_fires(spark, 40)
    assert sorted((r["id"], r["index_pos"]) for r in spatial.first_perimeters(fires).collect()) == [("f1", 1), ("f2", 2)]
    points = spark.createDataFrame([("a", 54.0, -2.0), ("b", 54.03 + 0.0005, -1.9), ("c", 54.02999, -1.9), ("d", 55.0, -2.0)], "pid string, lat double, lon double")
    got = spatial.attach_fires(points, fires)
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "band#" in line or "cx#" in line]
    assert {r["pid"]: r["near_fire"] for r in got.collect()} == {"a": "f2", "b": "f1", "c": "f1", "d": None}


def test_a_text_is_searched_once(spark):
    row = spark.createDataFrame([("at 54.5121, -2.5121",)], "comment string").select(text.coordinates("comment").alias("at")).where("at IS NOT NULL AND at.lat > 50")
    plan = row._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 60 and row.first()["at"]["lat"] == 54.5121


def test_nodes_within_reach_at_a_high_latitude(spark):
    lon = 59 / (111_320 * 0.17364817766693033)
    grid = spark.createDataFrame([("f", k, 0, 0, 80.0, k * lon * 6.83 + (lon if k else -lon), 1) for k in range(2)], "fire_id string, node_pos int, e long, n long, lat double, lon double, sev int")
    points = spark.createDataFrame([("west", "f", 80.0, 0.0), ("east", "f", 80.0, 6.83 * lon)], "pid string, fire_id string, lat double, lon double")
    assert {r["pid"]: r["grid_dist_m"] for r in spatial.attach_grid_nodes(points, grid).collect()} == {"west": 59, "east": 59}
