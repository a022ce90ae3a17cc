"""Queries over measurements, photos, reviews and their exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import survey as S
from ..sources import io
from . import sqlparts as Q
from .fires import NAME

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("uk_bounds_filter", f"SELECT uuid, lat, lon FROM measurements WHERE {Q.IN_UK}")
def _(t):
    from ..functions import geo

    return t["measurements"].where(geo.in_uk()).select("uuid", "lat", "lon")


VALIDATED = f"""SELECT uuid, lat, lon, depths, user_id, status, created_at, comment, combustion, {Q.MEAN} + CASE WHEN manual_placement THEN 1 ELSE 0 END AS depth_mean, {Q.MEAN} AS own_mean,
  CASE WHEN photo_pending THEN 'E' || repeat('9', 45) ELSE 'E1 N2' END AS grid_id, CASE WHEN accuracy_m > 40 THEN 'someone' ELSE user_id END AS submitter FROM measurements"""


def submitted(t):
    """Measurements as they come in, some breaking a rule."""
    rows = t["measurements"].withColumn("depth_mean", S.mean_depth() + F.when(F.col("manual_placement"), 1).otherwise(0))
    rows = rows.withColumn("grid_id", F.when(F.col("photo_pending"), F.concat(F.lit("E"), F.lit("9" * 45))).otherwise("E1 N2"))
    return rows.withColumn("submitter", F.when(F.col("accuracy_m") > 40, "someone").otherwise(F.col("user_id")))


@query(
    "validate_measurements",
    f"""WITH v AS ({VALIDATED}), r AS (SELECT uuid, list_filter([CASE WHEN abs(depth_mean - own_mean) > 1e-6 THEN 'mean_of_depths' END, CASE WHEN len(list_filter(depths, lambda d: d < 0 OR d > 500)) > 0 THEN 'depth_range' END], lambda x: x IS NOT NULL) AS odd, list_filter([
  CASE WHEN uuid IS NULL OR lat IS NULL OR lon IS NULL OR depths IS NULL OR user_id IS NULL OR status IS NULL OR created_at IS NULL THEN 'missing' END,
  CASE WHEN NOT (length(uuid) > 10 AND length(uuid) < 64) THEN 'uuid' END, CASE WHEN NOT ({Q.IN_UK}) THEN 'bounds' END, CASE WHEN len(depths) > 5 THEN 'depths' END,
  CASE WHEN NOT (depth_mean BETWEEN 0 AND 500) THEN 'depth_mean' END, CASE WHEN user_id <> submitter THEN 'user' END, CASE WHEN length(comment) > 500 THEN 'comment' END,
  CASE WHEN length(grid_id) >= 40 THEN 'grid_id' END, CASE WHEN combustion NOT IN ('unburned', 'light', 'moderate', 'near_complete') THEN 'combustion' END,
  CASE WHEN status <> 'pending_review' THEN 'status' END], lambda x: x IS NOT NULL) AS failed FROM v)
SELECT uuid, array_to_string(failed, ',') AS failed, array_to_string(odd, ',') AS odd, len(failed) = 0 AS valid FROM r""",
)
def _(t):
    return S.validate_measurements(submitted(t)).select("uuid", F.array_join("failed", ",").alias("failed"), F.array_join("odd", ",").alias("odd"), "valid")


@query(
    "entry_checks",
    f"""SELECT uuid, CASE WHEN coalesce({Q.COUNT}, 0) < 1 THEN 'no_depth' WHEN len(list_filter(depths, lambda d: d < 0 OR d > 500)) > 0 THEN 'depth_range' WHEN combustion IS NULL THEN 'no_combustion'
WHEN coalesce(photo_count, 0) < 1 THEN 'no_photo' WHEN lat IS NULL OR lon IS NULL THEN 'no_location' WHEN NOT ({Q.IN_UK}) THEN 'outside_uk' END AS error_code FROM measurements""",
)
def _(t):
    return t["measurements"].select("uuid", S.entry_error().alias("error_code"))


@query("accuracy_flag", "SELECT uuid, CASE WHEN manual_placement THEN 'manual' WHEN accuracy_m > 30 THEN 'poor' ELSE 'ok' END AS flag FROM measurements")
def _(t):
    return t["measurements"].select("uuid", S.accuracy_flag().alias("flag"))


@query(
    "validate_photos",
    r"""WITH ok AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY name, size_bytes, content_type, uploaded_by) AS rn FROM photos
  WHERE uploaded_by IS NOT NULL AND size_bytes < 3145728 AND starts_with(content_type, 'image/') AND regexp_matches(name, '^[a-zA-Z0-9-]+\.jpg$') AND path NOT IN (SELECT path FROM stored_photos))
SELECT path, name, size_bytes, content_type, uploaded_by FROM ok WHERE rn = 1""",
)
def _(t):
    return S.validate_photos(t["photos"], t["stored_photos"])


AUTHORIZED = """SELECT c.uuid, c.editor_uid, c.op, coalesce(m.status IS NOT NULL AND (a.uid IS NOT NULL OR coalesce(c.op = 'update' AND m.user_id = c.editor_uid AND m.status = 'pending_review' AND c.new_user_id = m.user_id, FALSE)), FALSE) AS accepted
FROM changes c LEFT JOIN measurements m USING (uuid) LEFT JOIN admins a ON a.uid = c.editor_uid"""


@query("authorize_updates", AUTHORIZED)
def _(t):
    return S.authorize_updates(t["changes"], t["measurements"], t["admins"]).select("uuid", "editor_uid", "op", "accepted")


@query("pending_uploads", "SELECT uuid, status FROM local_points WHERE status = 'pending' OR coalesce(photo_pending, FALSE)")
def _(t):
    return S.pending_uploads(t["local_points"]).select("uuid", "status")


@query(
    "entry_projection",
    f"""SELECT uuid, nullif(fire_id, '') AS fire_id, nullif(fire_name, '') AS fire_name, lat, lon, accuracy_m, array_to_string(list_transform(depths, lambda d: coalesce(printf('%.1f', d), '-')), ' ') AS depths, round({Q.MEAN}, 6) AS depth_mean,
CAST(coalesce({Q.COUNT}, 0) AS INT) AS depth_count, nullif(combustion, '') AS combustion, nullif(grid_id, '') AS grid_id, grid_dist_m, coalesce(comment, '') AS comment, coalesce(surveyor, '') AS surveyor, coalesce(photo_urls[1], photo_url) AS photo_url,
array_to_string(coalesce(photo_urls, []), ' ') AS photo_urls, coalesce(photo_count, 0) AS photo_count, user_id, nullif(user_email, '') AS user_email, 'pending_review' AS status, created_at, 1 AS client_version, created_at + INTERVAL 1 HOUR AS synced_at FROM measurements""",
)
def _(t):
    out = S.cloud_document(t["measurements"], F.expr("created_at + INTERVAL 1 HOUR")).withColumn("depth_mean", F.round("depth_mean", 6))
    return out.withColumn("depths", F.when(F.col("depths").isNotNull(), F.array_join(F.transform("depths", lambda d: F.when(d.isNull(), "-").otherwise(F.format_string("%.1f", d))), " "))).withColumn("photo_urls", F.array_join("photo_urls", " "))


@query(
    "depth_stats",
    f"SELECT uuid, round({Q.MEAN}, 6) AS depth_mean, CAST(coalesce({Q.COUNT}, 0) AS INT) AS depth_count, list_min(depths) AS depth_min, list_max(depths) AS depth_max FROM measurements",
)
def _(t):
    return S.depth_stats(t["measurements"]).withColumn("depth_mean", F.round("depth_mean", 6))


MERGE_COLUMNS = ("uuid", "fire_id", "lat", "lon", "status", "comment", "created_at")


@query(
    "merge_remote",
    """WITH j AS (SELECT l.uuid AS lu, r.uuid AS ru, l.fire_id AS lf, r.fire_id AS rf, l.lat AS la, r.lat AS ra, l.status AS ls, r.status AS rs, l.comment AS lc, r.comment AS rc,
  r.uuid IS NULL OR (l.uuid IS NOT NULL AND l.status = 'pending') AS k FROM local_points l FULL JOIN remote r ON l.uuid = r.uuid)
SELECT CASE WHEN k THEN lu ELSE ru END AS uuid, CASE WHEN k THEN lf ELSE rf END AS fire_id, CASE WHEN k THEN la ELSE ra END AS lat, CASE WHEN k THEN ls ELSE rs END AS status, CASE WHEN k THEN lc ELSE rc END AS comment, NOT k AS changed FROM j""",
)
def _(t):
    return S.merge_remote(t["local_points"].select(*MERGE_COLUMNS), t["remote"].select(*MERGE_COLUMNS)).select("uuid", "fire_id", "lat", "status", "comment", "changed")


@query(
    "push_upsert",
    """SELECT coalesce(c.uuid, i.uuid) AS uuid, CASE WHEN i.uuid IS NOT NULL THEN i.comment ELSE c.comment END AS comment, CASE WHEN i.uuid IS NOT NULL THEN i.fire_id ELSE c.fire_id END AS fire_id, c.lat AS lat, c.status AS status
FROM local_points c FULL JOIN remote i ON c.uuid = i.uuid""",
)
def _(t):
    return S.push_upsert(t["local_points"].select("uuid", "comment", "fire_id", "lat", "status"), t["remote"].select("uuid", "comment", "fire_id")).withColumn("uuid", F.col("uuid"))


@query(
    "push_documents",
    # odd orders lack the key fire_id, every third sends a null comment, and some are pushed twice
    """WITH i AS (SELECT r.uuid, o_orderkey, r.fire_id, r.comment FROM remote r JOIN orders ON r.uuid = 'measurement-' || CAST(o_orderkey AS VARCHAR))
SELECT coalesce(c.uuid, i.uuid) AS uuid, CASE WHEN i.uuid IS NULL THEN c.comment WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'second' ELSE i.comment END AS comment,
  CASE WHEN i.uuid IS NULL OR o_orderkey % 2 = 1 THEN c.fire_id ELSE i.fire_id END AS fire_id, c.status AS status, CASE WHEN i.uuid IS NULL THEN 3 WHEN c.uuid IS NULL THEN 1 + CAST(o_orderkey % 2 = 0 AS INT) ELSE 3 END AS n_keys
FROM local_points c FULL JOIN i ON c.uuid = i.uuid""",
)
def _(t):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    current = t["local_points"].select("uuid", F.map_from_entries(F.array(entry("comment", F.col("comment")), entry("fire_id", F.col("fire_id")), entry("status", F.col("status")))).alias("doc"))
    order = t["orders"].select(F.concat(F.lit("measurement-"), F.col("o_orderkey").cast("string")).alias("uuid"), "o_orderkey")
    rows = t["remote"].join(order, "uuid")
    comment = entry("comment", F.when(F.col("o_orderkey") % 9 != 0, F.col("comment")))
    one = F.map_from_entries(F.when(F.col("o_orderkey") % 2 == 1, F.array(comment)).otherwise(F.array(comment, entry("fire_id", F.col("fire_id")))))
    first = rows.select("uuid", F.lit(1).alias("seq"), one.alias("doc"))
    second = rows.where("o_orderkey % 6 = 0 AND o_orderkey % 9 <> 0").select("uuid", F.lit(2).alias("seq"), F.create_map(F.lit("comment"), F.lit("second")).alias("doc"))
    out = S.push_documents(current, first.unionByName(second))
    return out.select("uuid", *[F.col("doc")[c].alias(c) for c in ("comment", "fire_id", "status")], F.size("doc").alias("n_keys"))


@query(
    "layered_lookup",
    """WITH u AS (SELECT id AS fire_id, w, 1 AS layer FROM bounds WHERE CAST(id AS INT) % 3 = 0 UNION ALL SELECT fire_id, w - 1 AS w, 2 FROM packs), r AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY layer) AS rn FROM u)
SELECT fire_id, w, layer FROM r WHERE rn = 1""",
)
def _(t):
    first = t["bounds"].where("CAST(id AS INT) % 3 = 0").select(F.col("id").alias("fire_id"), "w")
    return S.layered_lookup(first, t["packs"].select("fire_id", (F.col("w") - 1).alias("w")), "fire_id")


@query("review_queue", "SELECT uuid, created_at FROM measurements WHERE status = 'pending_review' ORDER BY created_at, uuid LIMIT 50")
def _(t):
    return S.review_queue(t["measurements"]).select("uuid", "created_at")


@query("recent_measurements", "SELECT uuid, created_at FROM measurements WHERE created_at IS NOT NULL ORDER BY created_at DESC, uuid DESC LIMIT 300")
def _(t):
    return S.recent_measurements(t["measurements"]).select("uuid", "created_at")


@query("keyset_pages", "SELECT uuid, CAST(ceil(row_number() OVER (ORDER BY created_at, uuid) / 500) AS INT) AS page FROM measurements WHERE created_at IS NOT NULL")
def _(t):
    return S.keyset_pages(t["measurements"])


@query("my_points", "SELECT uuid, status, created_at FROM local_points ORDER BY created_at DESC, uuid")
def _(t):
    return t["local_points"].select("uuid", "status", "created_at").orderBy(F.desc("created_at"), "uuid")


@query("pull_for_fires", "SELECT uuid, fire_id FROM measurements WHERE fire_id IN (SELECT fire_id FROM packs)")
def _(t):
    return t["measurements"].join(t["packs"], "fire_id", "left_semi").select("uuid", "fire_id")


@query("admin_rows", "SELECT uuid, user_id FROM measurements WHERE user_id IN (SELECT uid FROM admins)")
def _(t):
    return t["measurements"].join(t["admins"].select(F.col("uid").alias("user_id")), "user_id", "left_semi").select("uuid", "user_id")


WAITING = "SELECT coalesce(fire_id, 'unassigned') AS fire_id FROM local_points WHERE status = 'pending' OR coalesce(photo_pending, FALSE)"


@query("sync_backlog", f"WITH w AS ({WAITING}) SELECT fire_id, count(*) AS n FROM w GROUP BY fire_id UNION ALL SELECT 'all', count(*) FROM w")
def _(t):
    return S.sync_backlog(t["local_points"])


@query("sync_report", "WITH o AS (SELECT uuid, status <> 'rejected' AS ok, 'refused ' || uuid AS error FROM measurements) SELECT count(*) FILTER (ok) AS pushed, count(*) FILTER (NOT ok) AS failed, min(error) FILTER (NOT ok) AS first_error FROM o")
def _(t):
    return S.sync_report(t["measurements"].select(F.col("uuid").alias("ord"), (F.col("status") != "rejected").alias("ok"), F.concat(F.lit("refused "), "uuid").alias("error")))


@query(
    "density_by_tile",
    f"""SELECT z, {Q.tile_x('lon', 'z')} AS x, {Q.tile_y('lat', 'z')} AS y, count(*) AS n, round(avg(lat) + 33e-9, 6) AS lat, round(avg(lon) + 33e-9, 6) AS lon
FROM measurements CROSS JOIN (SELECT unnest([6, 7, 8, 9, 10, 11, 12]) AS z) zooms GROUP BY ALL""",
)
def _(t):
    # a small shift keeps means off the halves, where the order of a sum decides the rounding
    return S.density_by_tile(t["measurements"]).withColumn("lat", F.round(F.col("lat") + 33e-9, 6)).withColumn("lon", F.round(F.col("lon") + 33e-9, 6))


@query(
    "campaigns",
    f"""WITH near AS ({Q.ATTACH.replace("{where}", "WHERE fire_id IS NULL")}), m AS (SELECT x.*, coalesce(x.fire_id, near.near_fire, 'unassigned') AS f FROM measurements x LEFT JOIN near USING (uuid))
SELECT f AS fire_id, count(*) AS n, min(created_at) AS earliest, max(created_at) AS latest, count(DISTINCT coalesce(nullif(surveyor, ''), nullif(user_id, ''), '?')) AS surveyors, round(arg_min(lat, (created_at, uuid)), 6) AS lat, round(arg_min(lon, (created_at, uuid)), 6) AS lon
FROM m GROUP BY f ORDER BY latest DESC, fire_id LIMIT 10""",
)
def _(t):
    return S.campaigns(t["measurements"], t["fires"]).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


# fixed values: the two patterns of coordinates
@query(
    "comment_coordinates",
    r"""WITH x AS (SELECT doc_id, lat AS la, lon AS lo, comment, regexp_extract(comment, '(?:^|[^0-9])(-?\d{1,2}\.\d{3,})\s*[,;\s]\s*(-?\d{1,2}\.\d{3,})', ['a', 'b']) AS d,
  regexp_extract(comment, '(\d{1,2})°\s*(\d{1,2})[''′]\s*([\d.]+)["″]?\s*([NS])[,;\s]+(\d{1,3})°\s*(\d{1,2})[''′]\s*([\d.]+)["″]?\s*([EW])', ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS m FROM comments),
y AS (SELECT doc_id, la, lo, m.a <> '' AS dms, CASE WHEN m.a <> '' THEN round((try_cast(m.a AS DOUBLE) + try_cast(m.b AS DOUBLE) / 60 + try_cast(m.c AS DOUBLE) / 3600) * CASE WHEN m.d = 'S' THEN -1 ELSE 1 END, 6) WHEN d.a <> '' THEN try_cast(d.a AS DOUBLE) END AS lat,
  CASE WHEN m.a <> '' THEN round((try_cast(m.e AS DOUBLE) + try_cast(m.f AS DOUBLE) / 60 + try_cast(m.g AS DOUBLE) / 3600) * CASE WHEN m.h = 'W' THEN -1 ELSE 1 END, 6) WHEN d.a <> '' THEN try_cast(d.b AS DOUBLE) END AS lon FROM x)
SELECT doc_id, lat, lon, CASE WHEN dms THEN 'dms' ELSE 'decimal' END AS kind, round(sqrt(((lon - lo) * 111320 * cos(radians(la))) ** 2 + ((lat - la) * 111320) ** 2), 3) AS moved_m FROM y
WHERE lat > 49 AND lat < 61 AND lon > -9 AND lon < 2.5""",
)
def _(t):
    return S.comment_coordinates(t["comments"]).withColumn("moved_m", F.round("moved_m", 3))


RELOCATED = """moved AS (SELECT uuid, lat AS la, lon AS lo, floor((lat + 0.0005) * 1e5 + 0.5) / 1e5 AS lat, floor((lon + 0.0003) * 1e5 + 0.5) / 1e5 AS lon FROM measurements WHERE CAST(substring(uuid, 13) AS INT) % 5 = 0)"""


@query(
    "relocate_and_reattach",
    f"""WITH {RELOCATED}, near AS ({Q.ATTACH.replace("{where}", "").replace("FROM measurements", "FROM moved")}),
n AS (SELECT m.uuid, m.la, m.lo, m.lat, m.lon, near.near_fire FROM moved m LEFT JOIN near USING (uuid)),
d AS (SELECT n.uuid, g.e, g.n, sqrt(((g.lon - n.lon) * 111320 * cos(radians(n.lat))) ** 2 + ((g.lat - n.lat) * 111320) ** 2) AS dist, g.node_pos FROM n JOIN grid g ON g.fire_id = n.near_fire),
r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY dist, node_pos) AS rn FROM d)
SELECT n.uuid, round(n.lat, 5) AS lat, round(n.lon, 5) AS lon, round(sqrt(((n.lon - n.lo) * 111320 * cos(radians(n.la))) ** 2 + ((n.lat - n.la) * 111320) ** 2), 3) AS moved_m, n.near_fire AS fire_id, CASE WHEN f.id IS NOT NULL THEN {NAME.replace("province", "f.province").replace("commune", "f.commune")} END AS fire_name,
  CASE WHEN r.dist <= 60 THEN 'E' || r.e || ' N' || r.n END AS grid_id, CASE WHEN r.dist <= 60 THEN CAST(floor(r.dist + 0.5) AS BIGINT) END AS grid_dist_m, 'comment-coordinates' AS location_source, TIMESTAMP '2025-06-01 12:00:00' AS location_corrected_at, 'user-1' AS location_corrected_by
FROM n LEFT JOIN fire_base f ON f.id = n.near_fire LEFT JOIN r ON r.uuid = n.uuid AND r.rn = 1""",
)
def _(t):
    spot = lambda c, d: F.format_string("%.5f", F.floor((F.col(c) + d) * 1e5 + 0.5) / 1e5)
    moved = t["measurements"].withColumn("comment", F.when(F.expr("CAST(substring(uuid, 13) AS INT) % 5 = 0"), F.concat(F.lit("really at "), spot("lat", 0.0005), F.lit(", "), spot("lon", 0.0003))))
    out = S.relocate_and_reattach(moved, t["fires"], t["grid"], "user-1", F.expr("TIMESTAMP_NTZ '2025-06-01 12:00:00'"))
    return out.withColumn("moved_m", F.round("moved_m", 3)).withColumn("lat", F.round("lat", 5)).withColumn("lon", F.round("lon", 5))


@query(
    "attach_grid_nodes",
    """WITH d AS (SELECT m.uuid, g.e, g.n, g.sev, sqrt(((g.lon - m.lon) * 111320 * cos(radians(m.lat))) ** 2 + ((g.lat - m.lat) * 111320) ** 2) AS dist, g.node_pos FROM measurements m JOIN grid g USING (fire_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY dist, node_pos) AS rn FROM d)
SELECT uuid, 'E' || e || ' N' || n AS grid_id, CAST(floor(dist + 0.5) AS BIGINT) AS grid_dist_m, sev FROM r WHERE rn = 1 AND dist <= 60""",
)
def _(t):
    from ..operators.spatial import attach_grid_nodes

    points = t["measurements"].select(F.col("uuid").alias("pid"), "fire_id", "lat", "lon")
    return attach_grid_nodes(points, t["grid"]).select(F.col("pid").alias("uuid"), "grid_id", "grid_dist_m", "sev")


@query(
    "depth_by_severity",
    f"""WITH d AS (SELECT m.uuid, {Q.MEAN.replace('depths', 'm.depths')} AS depth, g.sev, sqrt(((g.lon - m.lon) * 111320 * cos(radians(m.lat))) ** 2 + ((g.lat - m.lat) * 111320) ** 2) AS dist, g.node_pos FROM measurements m JOIN grid g USING (fire_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY dist, node_pos) AS rn FROM d)
SELECT sev, count(*) AS n, round(avg(depth), 6) AS mean_depth, round(stddev_samp(depth), 6) AS sd_depth FROM r WHERE rn = 1 AND dist <= 60 AND depth IS NOT NULL GROUP BY sev""",
)
def _(t):
    return S.depth_by_severity(t["measurements"], t["grid"]).withColumn("mean_depth", F.round("mean_depth", 6)).withColumn("sd_depth", F.round("sd_depth", 6))


def _number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _depth_sql(i: int) -> str:
    return f"coalesce({_number(f'depths[{i}]')}, '') AS depth_{i}"


@query(
    "export_measurements_csv",
    f"""SELECT uuid, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_iso, coalesce(surveyor, '') AS surveyor, coalesce(fire_id, '') AS fire_id, coalesce(fire_name, '') AS fire_name, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lon,
coalesce(CAST(CAST(floor(accuracy_m + 0.5) AS BIGINT) AS VARCHAR), '') AS gps_accuracy_m, CASE WHEN manual_placement THEN 'yes' ELSE 'no' END AS manual_placement, {', '.join(map(_depth_sql, range(1, 6)))},
coalesce(printf('%.2f', {Q.MEAN}), '') AS depth_mean_cm, CAST(coalesce({Q.COUNT}, 0) AS INT) AS depth_n, coalesce(combustion, '') AS combustion, coalesce(grid_id, '') AS grid_id, coalesce(CAST(grid_dist_m AS VARCHAR), '') AS grid_dist_m, coalesce(comment, '') AS comment, coalesce(photo_url, '') AS photo_url, coalesce(photo_count, 0) AS photo_count, status FROM measurements""",
)
def _(t):
    path = io.scratch(t.spark, "export")
    io.write_measurements_csv(t["measurements"], path)
    _starts_with(t.spark, path, ["uuid", "created_iso", "surveyor"])
    shape = S.export_columns(t["measurements"])
    back = io.read_export(t.spark, path, shape.columns)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).cast(kind).alias(c) if kind == "string" else F.col(c).cast(kind) for c, kind in shape.dtypes])


def _starts_with(spark, path, names):
    """Every file begins with the byte order mark and the plain names of the first columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    head = b"\xef\xbb\xbf" + ",".join(names).encode()
    if not files.where("length > 0").agg(F.min(F.substring("content", 1, len(head)) == F.lit(head))).first()[0]:
        raise ValueError("an exported file has no byte order mark before its header")


@query(
    "export_backup",
    f"""SELECT uuid, status, lat, lon, accuracy_m, round({Q.MEAN}, 6) AS depth_mean, nullif(array_to_string(list_transform(depths, lambda d: coalesce({_number('d')}, '')), '; '), '') AS depths, combustion, grid_id, grid_dist_m, fire_id, fire_name, comment, nullif(surveyor, '') AS surveyor,
user_email, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, strftime(synced_at, '%Y-%m-%dT%H:%M:%S.000Z') AS synced_at, location_source, array_to_string(photo_urls, '; ') AS photo_urls FROM measurements""",
)
def _(t):
    path = io.scratch(t.spark, "backup")
    io.write_backup(t["measurements"], path)
    _starts_with(t.spark, f"{path}/csv", ["uuid", "status", "lat"])
    shape = S.backup_columns(t["measurements"])
    back = io.read_export(t.spark, f"{path}/csv", shape.columns)
    # an empty field is read as null, whether the table has null or an empty text
    return back.select(*[(F.round(F.col(c).cast("double"), 6) if c == "depth_mean" else F.col(c).cast(kind)).alias(c) for c, kind in shape.dtypes])
