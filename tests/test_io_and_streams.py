import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberfield.fixtures import Tables
from emberfield.functions import geo, text
from emberfield.functions.sql import sql_functions
from emberfield.operators import raster, spatial, survey
from emberfield.sources import io, keyed
from emberfield.streaming import flows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


def test_perimeters(spark, tmp_path):
    ring = [[-2.0000049, 54.0], [-1.9, 54.0], [-1.9, 54.1], [-2.0000049, 54.0]]
    feature = lambda i, g: {"type": "Feature", "properties": {"id": i, "COMMUNE": "A", "FIREDATE": "2025-05-07 11:28:00", "areaHA_geo": 3.5}, "geometry": g}
    doc = {"type": "FeatureCollection", "features": [feature("1", {"type": "Polygon", "coordinates": [ring]}), feature(None, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]})]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    rows = io.load_perimeters(spark, str(tmp_path / "f.geojson"), lines=False).orderBy("index_pos").collect()
    assert [len(r["geom"]) for r in rows] == [1, 2] and rows[0]["geom"][0][0][0]["lon"] == -2.0
    assert str(rows[0]["firedate"]) == "2025-05-07 11:28:00" and rows[1]["id"] is None
    lines = "\n".join(["{", '"type": "FeatureCollection",', '"features": [', ",\n".join(json.dumps(f) for f in doc["features"]), "]", "}"])
    (tmp_path / "lines.geojson").write_text(lines)
    assert io.load_perimeters(spark, str(tmp_path / "lines.geojson"), lines=True).orderBy("index_pos").collect() == rows
    assert io.split_by_fire(io.load_perimeters(spark, str(tmp_path / "lines.geojson")), str(tmp_path / "split")) == 1
    assert (tmp_path / "split" / "safe_id=1").is_dir()


def test_grid_round_trip(spark, tmp_path, t):
    io.write_grid(t["grid"], str(tmp_path / "g"))
    assert sorted(map(tuple, io.read_grid(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, t["grid"].select("fire_id", "spacing", "node_pos", "e", "n", "lat", "lon", "sev").collect()))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "77.json").write_text('{"spacing": 100, "crs": "EPSG:27700", "points": [[450, 550, 54.1, -2.1, -1], [550, 550, 54.2, -2.2, 3]]}')
    rows = io.read_grid(spark, str(tmp_path / "docs")).collect()
    assert [(r["fire_id"], r["node_pos"], r["e"], r["sev"]) for r in rows] == [("77", 0, 450, -1), ("77", 1, 550, 3)]


def test_sinks(spark, tmp_path, t):
    m = t["measurements"]
    io.write_measurements_csv(m, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == m.count() and [c.removeprefix("\ufeff") for c in back.columns] == survey.export_columns(m).columns
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfuuid,created_iso") for p in (tmp_path / "csv").glob("part-*"))
    assert back.where(F.col("comment") == 'edge of bog, "wet"').count() == m.where(F.col("comment") == 'edge of bog, "wet"').count()
    io.write_backup(m, str(tmp_path / "backup"))
    assert spark.read.schema(m.schema).json(str(tmp_path / "backup" / "json")).exceptAll(m).count() == 0
    with pytest.raises(io.EmptyInput):
        io.publish_samples(m.select("lat", "lon").limit(0), str(tmp_path / "samples"))
    io.publish_samples(m.select("lat", "lon"), str(tmp_path / "samples"))
    io.write_severity_pixels(t["pixels"], t["fires"], str(tmp_path / "pixels"))
    assert spark.read.parquet(str(tmp_path / "pixels")).count() == io.severity_pixels(t["pixels"], t["fires"]).count()
    crosstab = raster.severity_landcover_crosstab(t["pixels"], t["raster"])
    io.write_stats(crosstab, raster.SEVERITIES, str(tmp_path / "stats"))
    io.write_summary_csv(raster.severity_stats(t["pixels"]), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "stats")).count() == spark.read.option("header", True).csv(str(tmp_path / "summary")).count()


def test_one_fire_is_few_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("concat('f', id % 500) AS fire_id", "id AS row", "rand(1) AS x").unionByName(spark.range(60_000).selectExpr("'f7' AS fire_id", "id AS row", "rand(2) AS x"))
    io.write_by_fire(rows, str(tmp_path / "t"), buckets=8, spread=3)
    files = [p for p in (tmp_path / "t").rglob("*.parquet") if not p.name.startswith(".")]
    assert len(files) <= 24 and max(p.stat().st_size for p in files) < 0.25 * sum(p.stat().st_size for p in files)
    one = io.read_fire(spark.read.parquet(str(tmp_path / "t")), "f7", buckets=8)
    assert one.count() == 60_080
    assert one.select(F.input_file_name()).distinct().count() <= 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(fire_bucket#\d+\), \(fire_bucket#\d+ = \d\)\]", plan) and "PushedFilters: [IsNotNull(fire_id), EqualTo(fire_id,f7)]" in plan


def test_exports_have_the_columns_of_the_reference(t):
    field, backup = survey.export_columns(t["measurements"]), survey.backup_columns(t["measurements"])
    assert field.columns == ["uuid", "created_iso", "surveyor", "fire_id", "fire_name", "lat", "lon", "gps_accuracy_m", "manual_placement", *[f"depth_{i}" for i in range(1, 6)], "depth_mean_cm", "depth_n", "combustion", "grid_id", "grid_dist_m", "comment", "photo_url", "photo_count", "status"]
    assert backup.columns == ["uuid", "status", "lat", "lon", "accuracy_m", "depth_mean", "depths", "combustion", "grid_id", "grid_dist_m", "fire_id", "fire_name", "comment", "surveyor", "user_email", "created_at", "synced_at", "location_source", "photo_urls"]
    m = t["measurements"]
    names = {r["id"]: r["name"] for r in t["fires"].select("id", text.place_name("commune", "province").alias("name")).collect()}
    nodes = {r["pid"]: (r["grid_id"], r["grid_dist_m"]) for r in spatial.attach_grid_nodes(m.select(F.col("uuid").alias("pid"), "fire_id", "lat", "lon"), t["grid"]).collect()}
    found = m.collect()
    assert all(r["fire_name"] == names.get(r["fire_id"]) and (r["grid_id"], r["grid_dist_m"]) == nodes.get(r["uuid"], (None, None)) for r in found) and nodes
    row = next(r for r in backup.collect() if r["photo_urls"] and "; " in r["photo_urls"])
    assert row["photo_urls"].count("; ") == next(r["photo_count"] for r in found if r["uuid"] == row["uuid"]) - 1


def test_ingest_stream_equals_batch(spark, tmp_path, t):
    rows = t["measurements"].withColumn("depth_mean", survey.mean_depth()).withColumn("grid_id", F.lit(None).cast("string")).withColumn("submitter", F.col("user_id")).withColumn("arrived", F.col("created_at"))
    rows.where("pmod(xxhash64(uuid), 3) <> 0").write.parquet(str(tmp_path / "in" / "a"))
    rows.where("pmod(xxhash64(uuid), 3) <> 1").write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = flows.ingest_measurements(stream, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    got = flows.current_from_log(log)
    want = survey.validate_measurements(rows).where("valid")
    assert got.count() == want.count() and got.select("uuid", "lat", "comment").exceptAll(want.select("uuid", "lat", "comment")).count() == 0
    assert spark.read.parquet(str(tmp_path / "bad")).select("uuid").distinct().count() == rows.count() - want.count()


def test_decision_stream_equals_batch(spark, tmp_path, t):
    t["decisions"].repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t["decisions"].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.stream_decisions(stream, lambda: t["measurements"], lambda: t["admins"], str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "out" / "log")).drop("batch_id")
    allowed = flows.authorized_decisions(t["decisions"], t["measurements"], t["admins"])
    assert sorted(map(tuple, log.select(allowed.columns).collect())) == sorted(map(tuple, allowed.collect()))
    assert 0 < log.count() < t["decisions"].count()
    assert spark.read.parquet(str(tmp_path / "out" / "refused")).count() == t["decisions"].count() - log.count()
    got = flows.review_decisions(log, t["measurements"], t["admins"])
    want = flows.review_decisions(t["decisions"], t["measurements"], t["admins"])
    pick = ("uuid", "status", "reviewed_by")
    assert got.select(*pick).exceptAll(want.select(*pick)).count() == 0


def test_decisions_wait_for_their_rows(spark, tmp_path):
    rows, out, cp = str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "uuid string, decision string, reviewer string, ts long"
    current = "uuid string, user_id string, status string"
    admins = spark.createDataFrame([("boss",)], "uid string")

    def arrive(*new):
        spark.createDataFrame(new, current).write.mode("append").parquet(rows)

    def decide(name, *new):
        spark.createDataFrame(new, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        flows.stream_decisions(stream, lambda: spark.read.schema(current).parquet(rows), lambda: admins, out, cp).trigger(availableNow=True).start().awaitTermination(120)

    def seen(kind):
        return sorted((r["uuid"], r["decision"], r["reviewer"]) for r in spark.read.schema(schema).parquet(f"{out}/{kind}").collect())

    arrive(("a", "ann", "pending_review"))
    # one after its row, one before it, one refused, and one that is refused once its row is there
    decide("1", ("a", "verified", "boss", 1), ("b", "verified", "boss", 2), ("a", "rejected", "bob", 3), ("c", "verified", "bob", 4))
    assert seen("log") == [("a", "verified", "boss")] and seen("refused") == [("a", "rejected", "bob")]
    arrive(("b", "ben", "pending_review"), ("d", "dan", "pending_review"))
    decide("2", ("d", "rejected", "boss", 5))
    assert seen("log") == [("a", "verified", "boss"), ("b", "verified", "boss"), ("d", "rejected", "boss")]
    arrive(("c", "cid", "pending_review"))
    # the last batch is run again, as after a crash before its commit, and a further one comes
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    decide("3", ("e", "verified", "boss", 6))
    assert seen("log") == [("a", "verified", "boss"), ("b", "verified", "boss"), ("d", "rejected", "boss")]
    assert seen("refused") == [("a", "rejected", "bob"), ("c", "verified", "bob")]


def test_keyed_table_equals_the_log(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(80)}", at, f"v{at}", rng.choice([None, at * 1.5])) for at in range(400)]
    path, schema = str(tmp_path / "t"), "uuid string, arrived long, value string, depth double"
    batches = [rows[i : i + 60] for i in range(0, 400, 60)]
    rng.shuffle(batches)
    log = []
    for n, batch in enumerate([*batches, batches[0], [r for r in rows if r[0] == "k7"]]):
        frame = spark.createDataFrame(batch, schema)
        touched = keyed.merge_batch(frame, path, n, ("uuid",), ("arrived",), buckets=16)
        if n == 2:
            keyed.merge_batch(frame, path, n, ("uuid",), ("arrived",), buckets=16)  # a replay
        files = [p for p in (tmp_path / "t" / "data" / f"v={n}").rglob("*.parquet") if not p.name.startswith(".")]
        assert len(files) == len(touched) <= 16
        log += [(n, *r) for r in batch]
    assert len(touched) == 1
    want = flows.current_from_log(spark.createDataFrame(log, f"batch_id int, {schema}"), ("arrived", "batch_id")).select("uuid", "value", "depth")
    read = lambda: sorted(map(tuple, keyed.read_keyed(spark, path, StructType.fromDDL(schema)).select("uuid", "value", "depth").collect()))
    assert read() == sorted(map(tuple, want.collect()))
    before = len(list((tmp_path / "t" / "data").iterdir()))
    keyed.compact(spark, path)
    assert read() == sorted(map(tuple, want.collect())) and len(list((tmp_path / "t" / "data").iterdir())) <= before
    keyed.merge_batch(spark.createDataFrame(batches[1], schema), path, n, ("uuid",), ("arrived",), buckets=16)  # the last batch can be run again after compaction
    assert len(read()) == len({r[0] for r in rows})


def test_position_streams_equal_batch(spark, tmp_path, t):
    fixes = t["gps_fixes"].where("seq < 400")
    late = fixes.where("seq % 3 = 0").coalesce(1)
    fixes.where("seq % 3 <> 0").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(fixes.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run():
        flows.stream_latest_fix(stream, str(tmp_path / "last"), str(tmp_path / "cp1"), 4).trigger(availableNow=True).start().awaitTermination(120)
        flows.stream_arrivals(stream, lambda: t["nav_targets"], str(tmp_path / "met"), str(tmp_path / "cp2"), buckets=4).trigger(availableNow=True).start().awaitTermination(120)

    run()
    late.write.parquet(str(tmp_path / "in" / "b"))  # fixes of earlier numbers come later
    run()
    last, met = flows.latest_fix(fixes), flows.arrivals(fixes, t["nav_targets"])
    assert sorted(map(tuple, keyed.read_keyed(spark, str(tmp_path / "last"), last.schema).collect())) == sorted(map(tuple, last.collect()))
    assert sorted(map(tuple, keyed.read_keyed(spark, str(tmp_path / "met"), met.schema).collect())) == sorted(map(tuple, met.collect()))


def test_measurement_stream_into_a_keyed_table(spark, tmp_path, t):
    rows = t["measurements"].withColumn("depth_mean", survey.mean_depth()).withColumn("grid_id", F.lit(None).cast("string")).withColumn("submitter", F.col("user_id")).withColumn("arrived", F.col("created_at"))
    rows.where("pmod(xxhash64(uuid), 3) <> 0").coalesce(2).write.parquet(str(tmp_path / "in" / "a"))
    rows.where("pmod(xxhash64(uuid), 3) <> 1").coalesce(2).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    flows.stream_measurements(stream, str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "cp"), 4).trigger(availableNow=True).start().awaitTermination(120)
    want = survey.validate_measurements(rows).where("valid").drop("valid", "failed", "odd")
    got = keyed.read_keyed(spark, str(tmp_path / "t"), want.schema)
    assert got.count() == want.count() and got.select("uuid", "lat", "comment").exceptAll(want.select("uuid", "lat", "comment")).count() == 0


def test_documents_of_one_batch_have_different_keys(spark):
    schema = "uuid string, doc map<string, string>"
    current = spark.createDataFrame([("a", {"x": "1", "y": "2", "z": None}), ("b", {"x": "5"}), ("n", None), ("e", {})], schema)
    incoming = spark.createDataFrame([("a", 1, {"x": None}), ("a", 2, {"y": "3", "w": "4"}), ("a", 0, {"y": "0"}), ("c", 1, {"x": None}), ("b", 1, {}), ("d", 1, None)], "uuid string, seq int, doc map<string, string>")
    got = {r["uuid"]: r["doc"] for r in survey.push_documents(current, incoming).collect()}
    assert got == {"a": {"x": None, "y": "3", "z": None, "w": "4"}, "b": {"x": "5"}, "c": {"x": None}, "d": {}, "n": {}, "e": {}}


def test_photo_names(spark):
    photos = spark.createDataFrame([(n, n, 10, "image/jpeg", "u") for n in ("a.jpg", "a.jpg\n", "b.jpg\nx", "\na.jpg", "c d.jpg")], "path string, name string, size_bytes int, content_type string, uploaded_by string")
    assert [r["name"] for r in survey.validate_photos(photos, photos.select("path").limit(0)).collect()] == ["a.jpg"]


def test_backup_bytes(spark, tmp_path, t):
    rows = t["measurements"].where("CAST(substr(uuid, 13) AS INT) % 37 = 0").withColumn("comment", F.lit('a "q", b\nc'))
    io.write_backup(rows, str(tmp_path / "b"))
    columns = survey.backup_columns(rows).columns
    files = [p.read_bytes() for p in (tmp_path / "b" / "csv").glob("part-*") if p.stat().st_size]
    assert all(f.startswith(b"\xef\xbb\xbf" + ",".join(columns).encode() + b'\r\n"') and f.endswith(b'"\r\n') for f in files)
    assert sum(f.count(b'"a ""q"", b\nc"') for f in files) == rows.count()
    back = io.read_export(spark, str(tmp_path / "b" / "csv"), columns)
    assert sorted(map(tuple, back.select("uuid", "comment").collect())) == sorted(map(tuple, rows.select("uuid", "comment").collect()))


def test_heading_stream_equals_batch(spark, tmp_path, t):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fixes = t["gps_fixes"].where("seq < 300")
    fixes.where("seq < 150").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(fixes.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = lambda: flows.stream_heading(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    fixes.where("seq >= 150").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    run()
    got = spark.read.schema("device string, seq long, bearing_deg int").parquet(str(tmp_path / "out"))
    want = flows.track_heading(fixes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_heading_anchor(spark):
    at = lambda n: 54.0 + n / 111320
    rows = [("d", 1, at(0), -2.0), ("d", 2, at(3), -2.0), ("d", 3, at(5), -2.0), ("d", 4, at(8), -2.0), ("d", 5, at(0.5), -2.0), ("e", 1, at(0), -2.0)]
    got = flows.track_heading(spark.createDataFrame(rows, "device string, seq long, lat double, lon double")).collect()
    assert [(r["seq"], r["bearing_deg"]) for r in got] == [(3, 0), (5, 180)]


def test_sql_functions(spark, t):
    sql_functions(spark)
    assert tuple(spark.sql("SELECT tile_x(-2D, 10), tile_y(54D, 10), severity_class(270D)").first()) == (506, 328, 3)
    point = spark.sql("SELECT 54D AS lat, -2D AS lon, 55.5D AS lat1, -3D AS lon1")
    point.createOrReplaceTempView("point_of_test")
    got = spark.sql("SELECT haversine_m(lat, lon, lat1, lon1), local_m(lat, lon, lat1, lon1), tile_lon(tile_x(lon, 9), 9), tile_lat(tile_y(lat, 9), 9), in_uk(lat, lon) FROM point_of_test").first()
    want = point.select(geo.haversine_m("lat", "lon", "lat1", "lon1"), geo.local_m("lat", "lon", "lat1", "lon1"), geo.tile_lon(geo.tile_x("lon", 9), 9), geo.tile_lat(geo.tile_y("lat", 9), 9), geo.in_uk()).first()
    assert tuple(got) == pytest.approx(tuple(want))
    assert sorted(map(tuple, spark.sql("SELECT * FROM nodes_of_box(40, 40, 260, 150, 100)").collect())) == [(50, 50), (50, 150), (150, 50), (150, 150), (250, 50), (250, 150)]
    assert spark.sql("SELECT grid_node_id(49.5D, 150D), nbr(3D, 1D), nbr(0D, 0D)").first()[:] == ("E50 N150", 0.5, None)


def test_keyset_cursor(spark, t):
    pages, after = [], None
    while rows := survey.next_page(t["measurements"], after, 400).collect():
        pages += [r["uuid"] for r in rows]
        after = (rows[-1]["created_at"], rows[-1]["uuid"])
    assert len(pages) == len(set(pages)) == t["measurements"].where("created_at IS NOT NULL").count()


def test_grids_of_many_fires_are_few_files(spark, tmp_path):
    grid = spark.range(600).selectExpr("CAST(id AS STRING) AS fire_id", "100 AS spacing", "0 AS node_pos", "id * 100 + 50 AS e", "CAST(50 AS BIGINT) AS n", "54D AS lat", "-2D AS lon", "1 AS sev")
    io.write_grid(grid, str(tmp_path / "g"))
    assert len(list((tmp_path / "g").rglob("*.json"))) <= 8
    assert sorted(map(tuple, io.read_grid(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, grid.collect()))
    few = grid.where("e < 300")
    io.write_grid(few, str(tmp_path / "few"), folders=True)
    assert sorted(map(tuple, io.read_grid(spark, str(tmp_path / "few")).collect())) == sorted(map(tuple, few.collect()))


def test_shared_nodes_are_dealt_before_they_are_counted(spark):
    from emberfield.operators import packs

    grid = spark.range(100).selectExpr("id % 30 AS e", "id % 2 AS n", "CAST(id % 7 AS STRING) AS fire_id")
    got = packs.shared_nodes(grid)
    assert "RepartitionByExpression [e#" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["e"], r["n"]): r["fires"] for r in got.collect()} == {k: n for k, n in ((k, len({i % 7 for i in range(100) if (i % 30, i % 2) == k})) for k in {(i % 30, i % 2) for i in range(100)}) if n > 1}


def test_streams_deal_more_rows_to_more_files(spark, tmp_path, monkeypatch):
    from emberfield.fixtures import Tables
    from emberfield.plans import flows as plans

    spark.range(25).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    assert plans._parts(t, "orders", 4) == 4
    monkeypatch.setattr(plans, "ROWS", 3)
    assert plans._parts(t, "orders", 4) == 9
