import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from emberfield.functions import geo, text
from emberfield.operators import raster, spatial

FIRE = "index_pos int, id string, geom array<array<array<struct<lon:double,lat:double>>>>"


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


FIRES = [
    (0, "hole", [[square(-2, 54, 0.1), square(-2, 54, 0.03)]]),
    (1, "two", [[square(-3, 55, 0.05)], [square(-3.3, 55, 0.05)]]),
    (2, "over", [[square(-2.08, 54, 0.1)]]),
    (3, "dot", [[[(-4.0, 54.0)] * 4]]),
    (4, "empty", []),
    (5, "sliver", [[[(-5.0, 54.0), (-4.9999, 54.0), (-4.9999, 54.0001), (-5.0, 54.0001), (-5.0, 54.0)]]]),
]


def inside(lon, lat, geom):
    for poly in geom:
        odd = [sum((a[1] > lat) != (b[1] > lat) and lon < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:])) % 2 for r in poly]  # noqa: B905
        if odd and odd[0] and not any(odd[1:]):
            return True
    return False


def test_points_equal_brute_force(spark):
    r = random.Random(1)
    points = [(i, r.uniform(53.8, 55.2), r.uniform(-3.5, -1.8)) for i in range(3000)] + [(9000, 54.0, -2.0), (9001, 54.0, -2.06)]
    got = {x["pid"]: x["fire_id"] for x in spatial.points_in_fires(spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(FIRES, FIRE)).collect()}
    want = {i: next((f for _, f, g in FIRES if inside(lon, lat, g)), None) for i, lat, lon in points}
    assert got == {i: f for i, f in want.items() if f}
    assert got.get(9000) == "over" or 9000 not in got  # the hole of the first, inside the third
    assert got[9001] == "hole"


def test_attach_within_a_hundred_metres(spark):
    points = [(1, 54.0005, -4.0), (2, 54.002, -4.0), (3, 54.1007, -2.0), (4, 58.0, -4.0), (5, 54.05, -2.05)]
    got = {r["pid"]: (r["near_fire"], r["dist_m"]) for r in spatial.attach_fires(spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(FIRES, FIRE)).collect()}
    assert got[1] == ("dot", pytest.approx(55.66, abs=0.01)) and got[2] == (None, None) and got[4] == (None, None)
    assert got[3] == ("hole", pytest.approx(77.92, abs=0.05)) and got[5] == ("hole", 0.0)


def star(x, y, r, rng):
    """A ring with slanted edges: radii that vary around a centre."""
    turn = [2 * math.pi * k / 11 for k in range(11)]
    ring = [(x + r * s * math.cos(a), y + r * s * math.sin(a)) for a, s in ((a, rng.uniform(0.5, 1)) for a in turn)]
    return [*ring, ring[0]]


def test_slanted_rings_equal_brute_force(spark):
    r = random.Random(9)
    fires = [(k, f"f{k}", [[star(-2 + 0.05 * (k % 4), 54 + 0.05 * (k // 4), 0.04, r), *([star(-2 + 0.05 * (k % 4), 54 + 0.05 * (k // 4), 0.018, r)] if k % 2 else [])]]) for k in range(12)]
    points = [(i, r.uniform(53.95, 54.15), r.uniform(-2.06, -1.8)) for i in range(4000)]
    table, shapes = spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(fires, FIRE)
    want = {i: next((f for _, f, g in fires if inside(lon, lat, g)), None) for i, lat, lon in points}
    assert {x["pid"]: x["fire_id"] for x in spatial.points_in_fires(table, shapes).collect()} == {i: f for i, f in want.items() if f}

    def metres(lat, lon, geom):
        mo, best = 111320 * math.cos(math.radians(lat)), math.inf
        for ring in geom[0]:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):  # noqa: B905
                dx, dy, px, py = (bx - ax) * mo, (by - ay) * 111320, (lon - ax) * mo, (lat - ay) * 111320
                t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
                best = min(best, math.hypot(px - t * dx, py - t * dy))
        return best

    near = {x["pid"]: (x["near_fire"], x["dist_m"]) for x in spatial.attach_fires(table, shapes).collect()}
    outside = [p for p in points if not want[p[0]]]
    hits = 0
    for i, lat, lon in outside:
        d, _, f = min((metres(lat, lon, g), k, f) for k, f, g in fires)
        assert near[i] == ((f, pytest.approx(d, abs=1e-4)) if d <= 100 else (None, None))
        hits += d <= 100
    assert hits > 50 and all(near[i] == (f, 0.0) for i, f in want.items() if f)


def test_clip_equals_brute_force_on_slanted_rings(spark):
    r = random.Random(3)
    geom = [[star(-2, 54, 0.1, r), star(-2, 54, 0.04, r)], [star(-1.7, 54, 0.05, r)]]
    header = spark.createDataFrame([("s", -2.15, 54.15)], "fire_id string, lon double, lat double").select("fire_id", geo.mercator_x("lon").alias("x0"), geo.mercator_y("lat").alias("y0"), F.lit(700.0).alias("px"), F.lit(-900.0).alias("py"))
    pixels = spark.range(90 * 70).select(F.lit("s").alias("fire_id"), F.expr("cast(id div 90 as int)").alias("row"), F.expr("cast(id % 90 as int)").alias("col"), F.lit(300).alias("dnbr"))
    got = {(x["row"], x["col"]) for x in raster.clip_to_perimeter(pixels, header, spark.createDataFrame([(0, "s", geom)], FIRE)).collect()}
    want = {(x["row"], x["col"]) for x in raster.pixel_centres(pixels, header).collect() if inside(x["lon"], x["lat"], geom)}
    assert got == want and len(got) > 300


def test_nearest_fires_by_cells(spark):
    r = random.Random(4)
    fires = [(k, f"f{k:03}", [[square(r.gauss(-2, 3), r.gauss(54, 2), 0.01)]]) for k in range(150)] + [(900, "far", [[square(170, -40, 0.01)]])]
    shapes = spark.createDataFrame(fires, FIRE)
    queries = spark.createDataFrame([(i, r.uniform(49, 61), r.uniform(-9, 2)) for i in range(120)] + [(1000, -41.0, 179.9), (1001, 80.0, 0.0)], "qid long, lat double, lon double")
    rows = lambda df: sorted((x["qid"], x["rank"], x["fire_id"], round(x["dist_m"], 6)) for x in df.collect())
    assert rows(spatial.fires_near(queries, shapes, 7, most_in_cell=3)) == rows(spatial.fires_near(queries, shapes, 7))
    assert len(rows(spatial.fires_near(queries.limit(3), shapes, 400, most_in_cell=3))) == 3 * 151


def test_number_formats(spark):
    sizes = {None: "-", 512: "512 B", 1536: "2 kB", 19456: "19 kB", 1677721: "1.6 MB", 2202009600: "2.05 GB"}
    got = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", text.byte_size("n").alias("t")).collect()
    assert {x["n"]: x["t"] for x in got} == sizes
    metres = {0.4: "0 m", 869.5: "870 m", 1340.0: "1.3 km", 24400.0: "24 km"}
    assert {x["m"]: x["t"] for x in spark.createDataFrame([(m,) for m in metres], "m double").select("m", text.distance("m").alias("t")).collect()} == metres


def test_lattice_is_inside_and_whole(spark):
    rows = spatial.sampling_lattice(spark.createDataFrame(FIRES, FIRE)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["fire_id"], []).append(r)
    assert set(by) == {"hole", "two", "over", "sliver"}
    assert len(by["sliver"]) == 1 and by["sliver"][0]["fallback"]
    for f in ("hole", "two"):
        geom = next(g for _, i, g in FIRES if i == f)
        assert all(r["e"] % 100 == 50 and r["n"] % 100 == 50 and not r["fallback"] for r in by[f])
        near = [r for r in by[f] if not inside(r["lon"], r["lat"], geom)]
        assert len(near) < 0.02 * len(by[f])  # chords of the grid and of longitude differ at the edges
    assert len(set((r["e"], r["n"]) for r in by["hole"])) == len(by["hole"])


def test_grid_round_trip(spark):
    frame = spark.createDataFrame([(51.4778, -0.0014), (57.1, -5.2), (50.1, -5.5)], "lat double, lon double").withColumn("g", geo.to_grid("lat", "lon"))
    for r in frame.withColumn("b", geo.from_grid("g.e", "g.n")).collect():
        assert r["b"]["lat"] == pytest.approx(r["lat"], abs=1e-6) and r["b"]["lon"] == pytest.approx(r["lon"], abs=1e-6)
    assert frame.first()["g"]["e"] == pytest.approx(538876, abs=15) and frame.first()["g"]["n"] == pytest.approx(177331, abs=15)


@pytest.mark.parametrize(
    ("note", "want"),
    [
        ("at 53°29'43.3\"N 1°59'19.1\"W", (53.495361, -1.988639)),
        ("53.12345, -2.12345 and 53°29'43.3\"N 1°59'19.1\"W", (53.495361, -1.988639)),
        ("about 53.123,-2.456.", (53.123, -2.456)),
        ("53.12, -2.45", None),
        ("12.12345, 77.54321", None),
        ("157.12345 -2.12345", None),
        ("", None),
        (None, None),
    ],
)
def test_coordinates_in_text(spark, note, want):
    got = spark.createDataFrame([(note,)], "t string").select(text.coordinates("t").alias("c")).first()["c"]
    assert (got and (got["lat"], got["lon"])) == want


def test_severity_bounds(spark):
    values = [-251, -250, -249, -101, -100, 99, 100, 269, 270, 439, 440, 659, 660]
    got = spark.createDataFrame([(v,) for v in values], "v int").select(geo.severity("v").alias("a"), geo.severity("v", True).alias("b")).collect()
    assert [r["a"] for r in got] == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert [r["b"] for r in got] == [0, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6]


def test_uncut_rasters_inflate_areas(spark):
    fires = spark.createDataFrame(FIRES, FIRE)
    header = spark.createDataFrame([("hole", -2.2, 54.2)], "fire_id string, lon double, lat double").select("fire_id", geo.mercator_x("lon").alias("x0"), geo.mercator_y("lat").alias("y0"), F.lit(400.0).alias("px"), F.lit(-400.0).alias("py"))
    pixels = spark.range(100 * 150).select(F.lit("hole").alias("fire_id"), F.expr("cast(id div 100 as int)").alias("row"), F.expr("cast(id % 100 as int)").alias("col"), F.lit(300).alias("dnbr"))
    cut = raster.clip_to_perimeter(pixels, header, fires).count()
    assert 0.15 < cut / 15000 < 0.35
    other = pixels.withColumn("fire_id", F.lit("none"))
    kept = raster.clip_to_perimeter(other, header.withColumn("fire_id", F.lit("none")), fires)
    assert kept.count() == 15000 and not kept.first()["cut"]


def test_simplified_rings(spark):
    ring = [(0.0, 0.0), (0.5, 0.0001), (1.0, 0.0), (1.0, 1.0), (0.5, 1.01), (0.0, 1.0), (0.0, 0.0)]
    fires = spark.createDataFrame([(0, "a", [[ring]]), (1, "b", [[square(0, 0, 0.0001)]])], FIRE)
    got = {r["id"]: r["geom"] for r in spatial.simplify_perimeters(fires).collect()}
    assert [tuple(p) for p in got["a"][0][0]] == [p for p in ring if p != (0.5, 0.0001)]
    assert len(got["b"][0][0]) >= 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIRE)
    points = spark.createDataFrame([(1, 54.0, -2.0)], "pid long, lat double, lon double")
    assert spatial.points_in_fires(points, none).collect() == []
    assert spatial.attach_fires(points, none).first()["near_fire"] is None
    assert spatial.sampling_lattice(none).collect() == []


def point(lat, lon):
    return [[[(float(lon), float(lat))]]]


def test_nearest_fires_anywhere_on_the_globe(spark):
    r = random.Random(11)
    places = [(r.gauss(54, 1), r.gauss(-2, 1)) for _ in range(400)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)] + [(89.9, 10), (89.9, -170), (-60, 179.9), (-60, -179.9), (54.5, -2.5), (54.5, -2.5)]
    fires = spark.createDataFrame([(i, f"f{i:03}", point(a, b)) for i, (a, b) in enumerate(places)] + [(999, "none", [])], FIRE)
    asked = [(1, 54.5, -2.5), (2, -54.0, 178.0), (3, 90.0, 0.0), (4, -60.0, 180.0), (5, 0.0, 0.0), (6, None, 1.0), (7, -89.0, -90.0)] + [(10 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(40)]
    queries = spark.createDataFrame(asked, "qid int, lat double, lon double")

    def far(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    want = {q: sorted((round(far(a, b, c, d), 3), f"f{i:03}") for i, (c, d) in enumerate(places))[:9] for q, a, b in asked if a is not None}
    for most in (1, 25, 1000):
        got = {}
        for row in spatial.fires_near(queries, fires, 9, most_in_cell=most).orderBy("qid", "rank").collect():
            got.setdefault(row["qid"], []).append((round(row["dist_m"], 3), row["fire_id"]))
        assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
        assert {f for _, f in got[1][:2]} == {"f464", "f465"} and got[1][0][1] == "f464"  # ties by id
    assert spatial.fires_near(queries, fires.limit(0), 3).count() == 0 == spatial.fires_near(queries.limit(0), fires, 3).count()


def test_a_scene_serves_all_fires_that_it_shows(spark):
    r = random.Random(5)
    start = datetime.datetime(2024, 3, 20, 13)
    days = lambda n: datetime.timedelta(days=n)
    fires = []
    for i in range(60):
        w, s, h = r.uniform(-6, 2), r.uniform(50, 59), r.uniform(0.01, 0.4)
        first = start + days(r.uniform(0, 60))
        fires.append((f"f{i}", first, first + days(r.choice([0, 0, 3.5, 20])), w, s, w + h, s + h))
    fires += [("null", None, None, -2.0, 54.0, -1.0, 55.0), ("none", start, start, None, None, None, None)]
    scenes = []
    for i in range(400):
        w, s, h = r.uniform(-7, 2), r.uniform(49, 59), r.choice([0.2, 1.1, 3.0])
        scenes.append((f"s{i}", start + days(r.uniform(-130, 200)), w, s, w + h, s + h))
    scenes += [("wide", start + days(10), -179.0, -85.0, 179.0, 85.0), ("edge", datetime.datetime(2024, 3, 1), -7.0, 49.0, 3.0, 60.0), ("untimed", None, -7.0, 49.0, 3.0, 60.0)]
    box = "w double, s double, e double, n double"
    got = raster.scenes_of_fires(spark.createDataFrame(scenes, f"scene_id string, scene_ts timestamp_ntz, {box}"), spark.createDataFrame(fires, f"id string, firedate timestamp_ntz, finaldate timestamp_ntz, {box}"), 40, 30, 2)
    midnight = lambda d: d.replace(hour=0, minute=0, second=0, microsecond=0)
    want = []
    for i, at, w, s, e, n in scenes:
        for f, a, b, w1, s1, e1, n1 in fires:
            if at and a and w1 is not None and w <= e1 and e >= w1 and s <= n1 and n >= s1:
                want += [(i, f, p) for p, x, y in (("pre", midnight(a) - days(40), midnight(a) - days(2)), ("post", midnight(b) + days(2), midnight(b) + days(30))) if x <= at < y]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want) and len(rows) == len(set(rows)) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mosaic_of_files_with_their_own_origins(spark):
    files = [(0, 100.0, 500.0, 10.0, -5.0, -1), (1, 120.0, 510.0, 10.0, -5.0, 999), (2, 90.0, 495.0, 10.0, -5.0, None)]
    cells = [(0, 0, 0, 1), (0, 0, 2, 2), (0, 3, 3, -1), (0, 1, 1, 7), (1, 2, 0, 5), (1, 0, 0, 6), (1, 5, 1, 999), (2, 0, 3, 8), (2, 0, 0, None), (2, 4, 2, 9)]
    mosaic, lattice = raster.mosaic_rasters(spark.createDataFrame(cells, "file_order int, row int, col int, code int"), spark.createDataFrame(files, "file_order int, x0 double, y0 double, px double, py double, nodata int"))
    assert tuple(lattice.first()) == (90.0, 510.0, 10.0, -5.0)
    want = {}
    for f, row, col, code in cells:
        _, x0, y0, px, py, nodata = files[f]
        if code is not None and code != nodata:
            want[(round((y0 - 510) / py) + row, round((x0 - 90) / px) + col)] = code
    assert {(r["row"], r["col"]): r["code"] for r in mosaic.collect()} == want and want[(2, 3)] == 5


def test_overlays_keep_what_is_near(spark):
    fires = spark.createDataFrame([(i, f"f{i}", [[square(i, 50.0, 0.1)]]) for i in range(12)], FIRE)
    views = [(1, 0, 10, 0.0, 49.5, 4.0, 50.5), (1, 1, 10, 5.0, 49.5, 9.0, 50.5), (1, 2, 10, 5.0, 49.5, 6.0, 50.5), (1, 3, 8, 5.0, 49.5, 6.0, 50.5), (1, 4, 10, 5.0, 49.5, 6.0, 50.5), (2, 0, 10, 11.0, 49.5, 12.0, 50.5), (2, 1, 10, 30.0, 49.5, 31.0, 50.5)]
    table = spark.createDataFrame(views, "session int, seq int, zoom int, w double, s double, e double, n double")

    def shown(**how):
        out = {}
        for r in spatial.viewport_overlays(table, fires, least_zoom=9, **how).orderBy("session", "seq", "place").collect():
            out.setdefault((r["session"], r["seq"]), []).append(int(r["fire_id"][1:]))
        return out

    assert shown(most=4) == {(1, 0): [0, 1, 2, 3], (1, 1): [1, 2, 3, 5], (1, 2): [5, 6], (1, 4): [5, 6], (2, 0): [11]}
    assert shown(most=2, pad=0.5, refill=False) == {(1, 0): [0, 1], (1, 1): [5, 6], (1, 2): [5, 6], (1, 4): [5, 6], (2, 0): [11]}


def test_views_of_one_box_meet_fires_once(spark):
    """Candidates grow with the boxes that are looked at, not with the views."""
    import re

    fires = spark.createDataFrame([(i, f"f{i}", [[square(i % 7, 50.0, 0.1)]]) for i in range(30)], FIRE)
    views = [(k % 3, k // 3, 8 + k % 9, float(k % 5), 49.5, k % 5 + 2.0, 50.5) for k in range(300)]
    got = spatial.viewport_overlays(spark.createDataFrame(views, "session int, seq int, zoom int, w double, s double, e double, n double"), fires, 4, pad=0.5, refill=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[w#\d+, s#\d+, e#\d+, n#\d+\]", plan)
    shown, want = {}, set()
    for session, seq, zoom, w, s, e, n in sorted(views):
        old = {} if zoom < 9 or not seq else shown[session]
        old = {i: x for i, x in old.items() if x <= e + (e - w) * 0.5 and x + 0.1 >= w - (e - w) * 0.5}
        met = [(f"f{i}", i % 7) for i in range(30) if w <= i % 7 + 0.1 and e >= i % 7 - 0.1][:4] if zoom >= 9 else []
        shown[session] = old | {i: x for i, x in met if i not in old}
        want |= {(session, seq, i, at) for at, i in enumerate(shown[session], 1)}
    assert set(map(tuple, got.collect())) == want

def test_projections_by_steps_agree_with_those_by_columns(spark):
    """The compiled projections of tables give the very values of to_grid() and from_grid()."""
    from emberfield.functions import geo

    points = spark.range(400).selectExpr("50 + id % 20 * 0.4 AS lat", "-6 + id div 20 * 0.37 AS lon")
    both = geo.with_grid(points, "lat", "lon", "e", "n").withColumn("g", geo.to_grid("lat", "lon"))
    both = geo.with_degrees(both, "e", "n", "lat1", "lon1").withColumn("d", geo.from_grid("e", "n"))
    assert both.where("e <> g.e OR n <> g.n OR lat1 <> d.lat OR lon1 <> d.lon").count() == 0 and both.where("abs(lat1 - lat) < 1e-7 AND abs(lon1 - lon) < 1e-7").count() == 400


def test_nodes_of_a_lattice_are_not_compared(spark):
    """Two polygons of a fire that meet on a node have it once, and no node is shuffled to find that out."""
    touching = [(0, "f", [[square(-2, 54, 0.02)], [square(-1.96, 54, 0.02)]])]
    nodes = spatial.sampling_lattice(spark.createDataFrame(touching, FIRE))
    found = [(r["e"], r["n"]) for r in nodes.collect()]
    assert len(found) == len(set(found)) > 1000
    assert "Aggregate [fire_id" not in nodes.where("NOT fallback")._jdf.queryExecution().optimizedPlan().toString()


def test_scenes_and_fires_meet_in_cells_of_days(spark):
    """Fires all over a country and a month share no few large cells: a pair that meets is among few that are compared."""
    import datetime

    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    fires = [(f"f{i}", day(i % 30), day(i % 30), i % 20 / 2 - 6.0, 50 + i // 20 / 2, i % 20 / 2 - 5.9, 50.1 + i // 20 / 2) for i in range(400)]
    scenes = [(f"s{i}", day(i % 30), i % 20 / 2 - 6.05, 49.95 + i // 20 / 2, i % 20 / 2 - 5.85, 50.15 + i // 20 / 2) for i in range(400)]
    box = "w double, s double, e double, n double"
    got = raster.scenes_of_fires(spark.createDataFrame(scenes, f"scene_id string, scene_ts timestamp_ntz, {box}"), spark.createDataFrame(fires, f"id string, firedate timestamp_ntz, finaldate timestamp_ntz, {box}"), 8, 8, 1)
    want = {(s[0], f[0], p) for s in scenes for f in fires for p, a, b in (("pre", f[1] - datetime.timedelta(8), f[1] - datetime.timedelta(1)), ("post", f[2] + datetime.timedelta(1), f[2] + datetime.timedelta(8))) if a <= s[1] < b and s[2] <= f[5] and s[4] >= f[3] and s[3] <= f[6] and s[5] >= f[4]}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [cx#") == 2


def test_scenes_of_one_footprint_and_fires_of_one_box_meet_as_lists(spark):
    """Ids that repeat a footprint and day, or a box and dates, are compared once a list; none is lost, nor one that is null or repeated."""
    import datetime

    def joined(plan):
        """Rows that come out of the joins of a plan that has run."""
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if plan.nodeName().endswith("QueryStage") else None
        below = [inner] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
        return (plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0) + sum(map(joined, below))

    at = lambda k, hour=0: datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=k)
    fires = [(f"f{i}" if i else None, at(10, i % 24), at(12, i % 24), -2.0, 54.0, -1.9, 54.1) for i in range(300)]
    scenes = [(f"s{i // 2}" if i > 1 else None, at(3 + 16 * (i % 2), i % 24), -2.5, 53.5, -1.5, 54.5) for i in range(600)] + [("late", at(9), -2.5, 53.5, -1.5, 54.5), ("off", at(3), -2.5, 53.5, -2.1, 54.5)]
    box = "w double, s double, e double, n double"
    got = raster.scenes_of_fires(spark.createDataFrame(scenes, f"scene_id string, scene_ts timestamp_ntz, {box}"), spark.createDataFrame(fires, f"id string, firedate timestamp_ntz, finaldate timestamp_ntz, {box}"), 8, 8, 1)
    want = [(s[0], f[0], ("pre", "post")[i % 2]) for i, s in enumerate(scenes[:600]) for f in fires]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 180_000
    assert 0 < joined(got._jdf.queryExecution().executedPlan()) <= 8


def test_points_under_many_fires_meet_few(spark, monkeypatch):
    """Fires that lie over one another do not multiply the pairs that are compared."""
    r = random.Random(4)
    fires = [(k, f"f{k}", [[square(-2 + r.uniform(-0.01, 0.01), 54 + r.uniform(-0.01, 0.01), 0.05)]]) for k in range(120)]
    points = [(i, r.uniform(53.97, 54.03), r.uniform(-2.03, -1.97)) for i in range(500)]
    compared, plain = [], spatial._measured

    def counting(pairs, sides, pad_m):
        compared.append(pairs.where("typeof(pid) = 'bigint'").count())
        return plain(pairs, sides, pad_m)

    monkeypatch.setattr(spatial, "_measured", counting)
    table, shapes = spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(fires, FIRE)
    got = {x["pid"]: x["fire_id"] for x in spatial.points_in_fires(table, shapes).collect()}
    assert got == {i: next(f for _, f, g in fires if inside(lon, lat, g)) for i, lat, lon in points}
    assert sum(compared) < 2 * len(points)
    near = {x["pid"]: (x["near_fire"], x["dist_m"]) for x in spatial.attach_fires(table, shapes).collect()}
    assert near == {i: (f, 0.0) for i, f in got.items()}
