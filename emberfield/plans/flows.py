"""Queries of the sinks' tables and of the streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..sources import io, keyed
from ..streaming import flows as W
from . import sqlparts as Q
from .fires import BURN, PLACED, _composite, _placed
from .survey import VALIDATED, submitted

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_RINGS = "SELECT fire_id, count(DISTINCT poly) AS polygons, count(*) * 9 AS vertices FROM rings GROUP BY fire_id"


@query(
    "load_perimeters",
    f"""SELECT id, row_number() OVER (ORDER BY index_pos) - 1 AS index_pos, commune, province, country, class, firedate, finaldate, CAST(area_ha AS DOUBLE) AS area_ha, polygons, vertices, round(x, 4) AS x, round(y, 4) AS y
FROM fire_base JOIN ({_RINGS}) r ON fire_id = id JOIN (SELECT fire_id, sum(round(ax, 5)) AS x, sum(round(ay, 5)) AS y FROM edges GROUP BY fire_id) e USING (fire_id)""",
)
def _(t):
    path = io.scratch(t.spark, "perimeters")
    lines = io.feature_lines(t["fires"]).repartitionByRange(4, "index_pos").sortWithinPartitions("index_pos")
    lines.select(F.concat("value", F.lit(",")).alias("value")).write.text(path)
    fires = io.load_perimeters(t.spark, path, lines=True)
    # edges are counted once, so the vertex that closes a ring is left out
    flat = F.flatten(F.transform("geom", lambda poly: F.flatten(F.transform(poly, lambda r: F.slice(r, 1, F.size(r) - 1)))))
    total = lambda k: F.round(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v[k]), 4)
    vertices = F.size(F.flatten(F.flatten("geom"))).cast("bigint")
    return fires.select("id", F.col("index_pos").cast("bigint").alias("index_pos"), "commune", "province", "country", "class", "firedate", "finaldate", "area_ha", F.size("geom").cast("bigint").alias("polygons"), vertices.alias("vertices"), total("lon").alias("x"), total("lat").alias("y"))


@query("split_by_fire", rf"SELECT regexp_replace(id || '/' || class, '[^A-Za-z0-9._-]', '_', 'g') AS safe_id, id || '/' || class AS id, index_pos, commune, polygons FROM fire_base JOIN ({_RINGS}) r ON fire_id = id WHERE id <> '3'")
def _(t):
    path = io.scratch(t.spark, "fires")
    fires = t["fires"].withColumn("id", F.when(F.col("id") != "3", F.concat("id", F.lit("/"), "class")))
    io.split_by_fire(fires, path)
    back = t.spark.read.schema(f"safe_id string, {', '.join(f'{c} {kind}' for c, kind in fires.dtypes)}").json(path)
    return back.select("safe_id", "id", "index_pos", "commune", F.size("geom").cast("bigint").alias("polygons"))


@query("publish_samples", "SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, uuid, TRUE AS empty_refused FROM measurements WHERE status = 'verified'")
def _(t):
    path = io.scratch(t.spark, "samples")
    verified = t["measurements"].where("status = 'verified'").select("lon", "lat", "uuid")
    io.publish_samples(verified, path)
    refused = False
    try:
        io.publish_samples(verified.where("uuid IS NULL"), path)
    except io.EmptyInput:
        refused = True  # and what was published is still there
    return t.spark.read.schema("lon double, lat double, uuid string").json(path).withColumn("empty_refused", F.lit(refused))


@query("write_grid", "SELECT fire_id, spacing, node_pos, e, n, lat, lon, sev FROM grid")
def _(t):
    path = io.scratch(t.spark, "grid")
    io.write_grid(t["grid"], path)
    return io.read_grid(t.spark, path)


@query("write_stats", f"SELECT fire_id, total_ha, landcover, {', '.join(Q.NAMES)} FROM ({Q.CROSSTAB})")
def _(t):
    path = io.scratch(t.spark, "stats")
    io.write_stats(R.severity_landcover_crosstab(t["pixels"], t["raster"]), R.SEVERITIES, path)
    docs = t.spark.read.schema("fire_id string, total_ha double, matrix map<string, array<double>>").json(path)
    return docs.select("fire_id", "total_ha", F.explode("matrix").alias("landcover", "ha")).select("fire_id", "total_ha", "landcover", *[F.col("ha")[k].alias(s) for k, s in enumerate(R.SEVERITIES)])


@query(
    "write_severity_index",
    f"""WITH s AS (SELECT fire_id, count(*) AS px, round(avg(dnbr), 1) AS mean, round(quantile_cont(dnbr, 0.9), 1) AS p90, round(avg(CASE WHEN dnbr >= 440 THEN 1 ELSE 0 END), 3) AS severe_frac FROM pixels WHERE {Q.VALID} AND CAST(fire_id AS INT) % 4 <> 1 GROUP BY fire_id),
r AS (SELECT fire_id, round(degrees(x0 / 6378137.0::DOUBLE), 6) AS w, round({Q.inverse_lat('y0 + height * py')}, 6) AS s, round(degrees((x0 + width * px) / 6378137.0::DOUBLE), 6) AS e, round({Q.inverse_lat('y0')}, 6) AS n FROM ({PLACED}) x WHERE CAST(fire_id AS INT) % 3 <> 1)
SELECT f.id AS fire_id, CASE WHEN r.fire_id IS NULL THEN 'no raster' WHEN s.fire_id IS NULL THEN 'no valid pixel' ELSE 'indexed' END AS reason, CASE WHEN r.fire_id IS NOT NULL THEN px END AS px, CASE WHEN r.fire_id IS NOT NULL THEN mean END AS mean, CASE WHEN r.fire_id IS NOT NULL THEN p90 END AS p90,
  CASE WHEN r.fire_id IS NOT NULL THEN severe_frac END AS severe_frac, CASE WHEN s.fire_id IS NOT NULL THEN r.w END AS w, CASE WHEN s.fire_id IS NOT NULL THEN r.s END AS s, CASE WHEN s.fire_id IS NOT NULL THEN r.e END AS e, CASE WHEN s.fire_id IS NOT NULL THEN r.n END AS n
FROM fire_base f LEFT JOIN s ON s.fire_id = f.id LEFT JOIN r ON r.fire_id = f.id""",
)
def _(t):
    stats = R.severity_stats(t["pixels"].where("CAST(fire_id AS INT) % 4 <> 1"))
    index, skipped = io.severity_index(stats, R.raster_bounds(_placed(t)).where("CAST(fire_id AS INT) % 3 <> 1"), t["fires"].select(F.col("id").alias("fire_id")))
    index = index.select("fire_id", F.lit("indexed").alias("reason"), "px", "mean", "p90", "severe_frac", *[F.round(c, 6).alias(c) for c in "wsen"])
    return index.unionByName(skipped, allowMissingColumns=True)


@query("write_severity_pixels", "SELECT fire_id, row, col, CAST(greatest(-32768, least(32767, dnbr)) AS SMALLINT) AS dnbr FROM pixels WHERE fire_id IN (SELECT id FROM fire_base WHERE area_ha >= 50)")
def _(t):
    path = io.scratch(t.spark, "severity")
    io.write_severity_pixels(t["pixels"], t["fires"], path, buckets=16)
    return t.spark.read.schema("row int, col int, dnbr smallint, fire_id string").parquet(path).select("fire_id", "row", "col", "dnbr")


@query("read_fire", "SELECT row, col, CAST(greatest(-32768, least(32767, dnbr)) AS SMALLINT) AS dnbr FROM pixels WHERE fire_id = (SELECT id FROM fire_base WHERE area_ha >= 50 AND id IN (SELECT fire_id FROM pixels) ORDER BY id LIMIT 1)")
def _(t):
    path = io.scratch(t.spark, "severity")
    io.write_severity_pixels(t["pixels"], t["fires"], path, buckets=16)
    stored = t.spark.read.parquet(path)
    return io.read_fire(stored, stored.agg(F.min("fire_id")).first()[0], buckets=16).select("row", "col", "dnbr")


@query("write_summary_csv", f"SELECT fire_id, count(*) AS n, round(avg(dnbr), 3) AS mean FROM ({BURN}) GROUP BY fire_id")
def _(t):
    path = io.scratch(t.spark, "summary")
    io.write_summary_csv(R.burn_severity(_composite(t)).groupBy("fire_id").agg(F.count("*").alias("n"), F.round(F.avg("dnbr"), 3).alias("mean")), path)
    return t.spark.read.schema("fire_id string, n bigint, mean double").option("header", True).csv(path)


@query(
    "ingest_measurements",
    f"""WITH v AS ({VALIDATED}) SELECT uuid, status, round(lat, 6) AS lat FROM v WHERE length(uuid) > 10 AND depths IS NOT NULL AND user_id IS NOT NULL AND ({Q.IN_UK}) AND len(depths) <= 5 AND coalesce(depth_mean BETWEEN 0 AND 500, TRUE)
AND user_id = submitter AND coalesce(length(comment) <= 500, TRUE) AND length(grid_id) < 40 AND coalesce(combustion IN ('unburned', 'light', 'moderate', 'near_complete'), TRUE) AND status = 'pending_review'""",
)
def _(t):
    from ..operators import survey as S

    rows = submitted(t)
    # every row arrives, and every second one again later: retries leave one row
    log = rows.withColumn("batch_id", F.lit(0)).unionByName(rows.where("pmod(xxhash64(uuid), 2) = 0").withColumn("batch_id", F.lit(1)))
    valid = S.validate_measurements(log).where("valid").drop("valid", "failed", "odd").withColumn("arrived", F.col("created_at"))
    return W.current_from_log(valid).select("uuid", "status", F.round("lat", 6).alias("lat"))


@query("keyed_measurements", """SELECT uuid, status, round(lat + CASE WHEN CAST(substr(uuid, 13) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END, 6) AS lat FROM measurements""")
def _(t):
    path = io.scratch(t.spark, "keyed")
    rows = t["measurements"].select("uuid", "status", "lat", F.lit(1).alias("arrived"))
    later = rows.where("CAST(substr(uuid, 13) AS BIGINT) % 2 = 0").select("uuid", "status", (F.col("lat") + 1).alias("lat"), F.lit(2).alias("arrived"))
    # the later rows come first, and some of the earlier ones twice
    for batch_id, batch in enumerate((later, rows, rows.where("CAST(substr(uuid, 13) AS BIGINT) % 5 = 0"))):
        keyed.merge_batch(batch, path, batch_id, ("uuid",), ("arrived",), buckets=_parts(t, "orders", 8))
    return keyed.read_keyed(t.spark, path, rows.schema).select("uuid", "status", F.round("lat", 6).alias("lat"))


@query(
    "track_heading",
    """WITH RECURSIVE o AS (SELECT device, seq, lat, lon, row_number() OVER (PARTITION BY device ORDER BY seq) AS rn FROM gps_fixes),
w AS (SELECT device, rn, seq, lat AS la, lon AS lo, FALSE AS hit, 0.0::DOUBLE AS deg FROM o WHERE rn = 1
 UNION ALL SELECT device, rn, seq, CASE WHEN far THEN lat ELSE la END, CASE WHEN far THEN lon ELSE lo END, far, deg FROM (
   SELECT w.device, o.rn, o.seq, o.lat, o.lon, w.la, w.lo, sqrt(((o.lon - w.lo) * 111320 * cos(radians(w.la))) ** 2 + ((o.lat - w.la) * 111320) ** 2) > 4 AS far,
     degrees(atan2((o.lon - w.lo) * 111320 * cos(radians(w.la)), (o.lat - w.la) * 111320)) + 360 AS deg FROM w JOIN o ON o.device = w.device AND o.rn = w.rn + 1) s)
SELECT device, seq, CAST(floor(deg - 360 * floor(deg / 360) + 0.5) AS INT) AS bearing_deg FROM w WHERE hit""",
)
def _(t):
    return W.track_heading(t["gps_fixes"])


@query(
    "arrivals",
    """SELECT device, seq, node_id, round(d, 3) AS dist_m FROM (SELECT f.device, f.seq, t.node_id, sqrt(((t.lon - f.lon) * 111320 * cos(radians(f.lat))) ** 2 + ((t.lat - f.lat) * 111320) ** 2) AS d FROM gps_fixes f JOIN nav_targets t USING (device)) x WHERE d <= 5""",
)
def _(t):
    return W.arrivals(t["gps_fixes"], t["nav_targets"]).withColumn("dist_m", F.round("dist_m", 3))


@query("latest_fix", "SELECT device, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM gps_fixes GROUP BY device")
def _(t):
    return W.latest_fix(t["gps_fixes"])


@query(
    "review_decisions",
    """WITH d AS (SELECT d.*, row_number() OVER (PARTITION BY d.uuid ORDER BY ts DESC, reviewer DESC, decision DESC) AS rn FROM decisions d JOIN measurements m USING (uuid) LEFT JOIN admins a ON a.uid = d.reviewer
  WHERE a.uid IS NOT NULL OR (m.user_id = d.reviewer AND m.status = 'pending_review'))
SELECT m.uuid, CASE WHEN m.status = 'pending_review' AND d.uuid IS NOT NULL THEN d.decision ELSE m.status END AS status, CASE WHEN m.status = 'pending_review' THEN d.reviewer END AS reviewed_by FROM measurements m LEFT JOIN (SELECT * FROM d WHERE rn = 1) d USING (uuid)""",
)
def _(t):
    return W.review_decisions(t["decisions"], t["measurements"], t["admins"]).select("uuid", "status", "reviewed_by")


# the streams themselves, over files that arrive a few at a time


#: Rows in a file that arrives, or in a bucket, so that no task has many more; below, four files and eight buckets.
ROWS = 250_000


def _parts(t, table, least):
    """How many files or buckets a given table's rows need, from the counts in its files' footers."""
    return max(least, -(-t[table].count() // ROWS))


def _arriving(t, table, name, files=4):
    """A stream of a table's rows, dealt to files without order, half of them a micro-batch."""
    path = io.scratch(t.spark, name)
    table.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path)


def _finish(writer):
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()  # raises what a batch has raised


@query("stream_latest_fix", QUERIES["latest_fix"][1])
def _(t):
    out, fixes = io.scratch(t.spark, "last"), t["gps_fixes"]
    _finish(W.stream_latest_fix(_arriving(t, fixes, "fixes", _parts(t, "events", 4)), out, f"{out}-checkpoint", _parts(t, "events", 8)))
    return keyed.read_keyed(t.spark, out, W.latest_fix(fixes).schema)


@query("stream_arrivals", QUERIES["arrivals"][1])
def _(t):
    out, fixes, targets = io.scratch(t.spark, "met"), t["gps_fixes"], t["nav_targets"]
    _finish(W.stream_arrivals(_arriving(t, fixes, "fixes", _parts(t, "events", 4)), lambda: targets, out, f"{out}-checkpoint", buckets=_parts(t, "events", 8)))
    return keyed.read_keyed(t.spark, out, W.arrivals(fixes, targets).schema).withColumn("dist_m", F.round("dist_m", 3))


@query("stream_decisions", QUERIES["review_decisions"][1])
def _(t):
    out, decisions, current, admins = io.scratch(t.spark, "reviews"), t["decisions"], t["measurements"], t["admins"]
    _finish(W.stream_decisions(_arriving(t, decisions, "decisions", _parts(t, "orders", 4)), lambda: current, lambda: admins, out, f"{out}-checkpoint"))
    log = t.spark.read.schema(decisions.schema).parquet(f"{out}/log")
    return W.review_decisions(log.select("uuid", "decision", "reviewer", "ts"), current, admins).select("uuid", "status", "reviewed_by")


@query("stream_measurements", QUERIES["ingest_measurements"][1])
def _(t):
    out, rows = io.scratch(t.spark, "ingested"), submitted(t).withColumn("arrived", F.col("created_at"))
    _finish(W.stream_measurements(_arriving(t, rows, "arriving", _parts(t, "orders", 4)), out, f"{out}-rejected", f"{out}-checkpoint", _parts(t, "orders", 8)))
    return keyed.read_keyed(t.spark, out, rows.schema).select("uuid", "status", F.round("lat", 6).alias("lat"))
