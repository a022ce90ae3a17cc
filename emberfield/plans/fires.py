"""Queries over fires, pixels, imagery, grids and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.sql import sql_functions
from ..operators import packs as P
from ..operators import raster as R
from ..operators import spatial as X
from ..sources import io
from . import sqlparts as Q

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


NAME = "coalesce(nullif(array_to_string(list_filter(CASE WHEN commune = province THEN [commune] ELSE [commune, province] END, lambda x: x IS NOT NULL AND trim(x) NOT IN ('', '0')), ', '), ''), 'Unnamed fire')"


@query(
    "fire_labels",
    f"""SELECT id, {NAME} AS name, concat_ws(' · ', strftime(firedate, '%Y-%m-%d'), CASE WHEN area_ha >= 100 THEN format('{{:,}}', CAST(floor(area_ha + 0.5) AS BIGINT)) || ' ha' WHEN area_ha > 0 THEN printf('%.1f', CAST(area_ha AS DOUBLE)) || ' ha' END, country) AS subtitle FROM fire_base""",
)
def _(t):
    return P.fire_labels(t["fires"])


@query("visible_fires", "SELECT id FROM fire_base WHERE coalesce(area_ha, 0) >= 100 OR id IN (SELECT fire_id FROM packs)")
def _(t):
    return P.visible_fires(t["fires"], t["packs"], 100.0).select("id")


@query("search_fires", f"SELECT id, {NAME} AS name FROM fire_base WHERE contains(lower(concat_ws(' ', {NAME}, id, country)), 'nation_1')")
def _(t):
    return P.search_fires(t["fires"], "Nation_1").select("id", "name")


@query("downloaded_fires", "SELECT id FROM fire_base WHERE id IN (SELECT fire_id FROM packs)")
def _(t):
    return P.downloaded_fires(t["fires"], t["packs"]).select("id")


@query("large_fires", "SELECT id, CAST(area_ha AS DOUBLE) AS area_ha FROM fire_base WHERE area_ha >= 50")
def _(t):
    return R.large_fires(t["fires"]).select("id", F.col("area_ha").cast("double").alias("area_ha"))


@query(
    "burn_windows",
    """WITH h AS (SELECT id, date_diff('second', firedate, finaldate) / 3600.0::DOUBLE AS hours FROM fire_base)
SELECT id, CASE WHEN hours > 0 THEN hours END AS burn_hours, CASE WHEN hours <= 0 THEN NULL WHEN hours < 1.5 THEN 'contained within the hour' WHEN hours < 24 THEN 'contained within ' || CAST(floor(hours + 0.5) AS BIGINT) || ' hours'
ELSE 'burned for ' || CAST(floor(hours / 24 + 0.5) AS BIGINT) || CASE WHEN floor(hours / 24 + 0.5) = 1 THEN ' day' ELSE ' days' END END AS label FROM h""",
)
def _(t):
    return P.burn_windows(t["fires"])


@query("geometry_bbox", "SELECT id, round(w, 9) AS w, round(s, 9) AS s, round(e, 9) AS e, round(n, 9) AS n FROM bounds")
def _(t):
    return X.bounding_boxes(t["fires"]).select("id", *[F.round(c, 9).alias(c) for c in "wsen"])


#: The first vertex closes the ring, so it counts twice.
_VERTEX = "{0} + {1} * half * CASE WHEN mid = 1 THEN waist ELSE 1e0 END"
POINT = f"SELECT fire_id AS id, avg({_VERTEX.format('cy', 'sy')}) AS lat, avg({_VERTEX.format('cx', 'sx')}) AS lon FROM rings CROSS JOIN (SELECT * FROM corners UNION ALL SELECT * FROM corners WHERE k = 0) v GROUP BY fire_id"


@query("representative_point", f"SELECT id, round(lat, 9) + 0.0 AS lat, round(lon, 9) + 0.0 AS lon FROM ({POINT})")
def _(t):
    return X.representative_points(t["fires"]).select("id", (F.round("lat", 9) + 0.0).alias("lat"), (F.round("lon", 9) + 0.0).alias("lon"))


@query(
    "points_in_fires",
    f"""SELECT uuid, fire_id AS found FROM (SELECT x.uuid, x.fire_id, row_number() OVER (PARTITION BY uuid ORDER BY f.index_pos) AS rn FROM ({Q.MEASURED.replace('{where}', '')}) x JOIN fire_base f ON f.id = x.fire_id WHERE inside = 1) y WHERE rn = 1""",
)
def _(t):
    points = t["measurements"].select(F.col("uuid").alias("pid"), "lat", "lon")
    return X.points_in_fires(points, t["fires"]).select(F.col("pid").alias("uuid"), F.col("fire_id").alias("found"))


@query("attach_fires", f"SELECT m.uuid, a.near_fire, round(a.dist_m, 3) AS dist_m FROM measurements m LEFT JOIN ({Q.ATTACH.replace('{where}', '')}) a USING (uuid)")
def _(t):
    points = t["measurements"].select(F.col("uuid").alias("pid"), "lat", "lon")
    return X.attach_fires(points, t["fires"]).select(F.col("pid").alias("uuid"), "near_fire", F.round("dist_m", 3).alias("dist_m"))


@query(
    "fires_near",
    f"""WITH p AS ({POINT}), d AS (SELECT custkey, id, 2 * 6371000 * asin(least(1, sqrt(sin(radians(p.lat - q.lat) / 2) ** 2 + cos(radians(q.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - q.lon) / 2) ** 2))) AS m
  FROM p CROSS JOIN (SELECT c_custkey AS custkey, 50 + (c_custkey % 90) / 10 AS lat, -6 + (c_custkey % 70) / 10 AS lon FROM customer) q), r AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY m, id) AS rank FROM d)
SELECT custkey AS qid, CAST(rank AS INT) AS rank, id AS fire_id, round(m, 3) AS dist_m FROM r WHERE rank <= 5""",
)
def _(t):
    places = t["customer"].select(F.col("c_custkey").alias("qid"), (50 + F.col("c_custkey") % 90 / 10).alias("lat"), (-6 + F.col("c_custkey") % 70 / 10).alias("lon"))
    return X.fires_near(places, t["fires"], 5).withColumn("dist_m", F.round("dist_m", 3))


@query(
    "viewport_fires",
    """SELECT view_id, fire_id, CAST(rank AS INT) AS rank FROM (SELECT v.view_id, b.id AS fire_id, row_number() OVER (PARTITION BY v.view_id ORDER BY f.index_pos) AS rank FROM viewports v JOIN bounds b ON b.w <= v.e AND b.e >= v.w AND b.s <= v.n AND b.n >= v.s JOIN fire_base f ON f.id = b.id) x WHERE rank <= 4""",
)
def _(t):
    return X.viewport_fires(t["viewports"], t["fires"], 4)


def _overlays(most: int, pad: float, refill: bool) -> str:
    """A recursion over the views of each session; the state is the list of its overlays."""
    unseen = "list_filter({}, lambda c: NOT list_contains(list_transform(keep, lambda k: k.id), c.id))"
    added = f"({unseen.format('cands')})[1:greatest(0, {most} - len(keep))]" if refill else unseen.format(f"cands[1:{most}]")
    return f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM sessions),
c AS (SELECT v.session, v.rn, list({{'id': b.id, 'w': b.w, 's': b.s, 'e': b.e, 'n': b.n}} ORDER BY f.index_pos) AS cands FROM v JOIN bounds b ON b.w <= v.e AND b.e >= v.w AND b.s <= v.n AND b.n >= v.s JOIN fire_base f ON f.id = b.id GROUP BY v.session, v.rn),
vc AS (SELECT v.*, coalesce(cands, []) AS cands FROM v LEFT JOIN c USING (session, rn)),
st AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, CAST([] AS STRUCT(id VARCHAR, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE)[]) AS shown FROM v
 UNION ALL SELECT session, rn, seq, CASE WHEN zoom < 9 THEN [] ELSE list_concat(keep, {added}) END FROM (
  SELECT vc.session, vc.rn, vc.seq, vc.zoom, vc.cands, list_filter(st.shown, lambda b: b.w <= vc.e + (vc.e - vc.w) * {pad} AND b.e >= vc.w - (vc.e - vc.w) * {pad} AND b.s <= vc.n + (vc.n - vc.s) * {pad} AND b.n >= vc.s - (vc.n - vc.s) * {pad}) AS keep
  FROM st JOIN vc ON vc.session = st.session AND vc.rn = st.rn + 1) k)
SELECT session, seq, shown[place].id AS fire_id, CAST(place AS INT) AS place FROM (SELECT session, seq, shown, unnest(range(1, len(shown) + 1)) AS place FROM st) u"""


@query("viewport_overlays", _overlays(6, 1.0, True))
def _(t):
    return X.viewport_overlays(t["sessions"], t["fires"], 6)


@query("viewport_grids", _overlays(4, 0.5, False))
def _(t):
    return X.viewport_overlays(t["sessions"], t["fires"], 4, pad=0.5, refill=False)


@query("pack_state", "SELECT f.id, CASE WHEN p.version IS NULL THEN 'none' WHEN p.version <> 4 OR p.basemap <> 'topo' OR p.failed > 0 THEN 'stale' ELSE 'ready' END AS state FROM fire_base f LEFT JOIN packs p ON p.fire_id = f.id")
def _(t):
    return P.pack_state(t["fires"], t["packs"])


@query("pack_storage", "SELECT count(*) AS packs, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM packs")
def _(t):
    return P.pack_storage(t["packs"])


_GROWN = "SELECT id, w, s, e, n, 2 / 111.32::DOUBLE AS dlat, 2 / (111.32::DOUBLE * greatest(0.2::DOUBLE, cos(radians((s + n) / 2)))) AS dlon FROM bounds"
_BUFFERED = f"SELECT id, greatest(-180, w - dlon) AS w, greatest(-85, s - dlat) AS s, least(180, e + dlon) AS e, least(85, n + dlat) AS n FROM ({_GROWN}) g"
RANGES = f"""SELECT id, w, s, e, n, z, {Q.tile_x('w', 'z')} AS x0, {Q.tile_x('e', 'z')} AS x1, {Q.tile_y('n', 'z')} AS y0, {Q.tile_y('s', 'z')} AS y1, z <= 11 AS covered FROM ({_BUFFERED}) b CROSS JOIN (SELECT unnest([10, 11, 12, 13, 14, 15]) AS z) zooms"""
ESTIMATE = f"""SELECT id, CAST(base + cover AS BIGINT) AS tile_count, CAST(base * 19456 + cover * 2560 AS BIGINT) AS bytes, km2, base + cover > 10000 AS too_big, base + cover > 1200 AS warn FROM (
  SELECT id, sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS base, sum(CASE WHEN covered THEN (x1 - x0 + 1) * (y1 - y0 + 1) ELSE 0 END) AS cover, min((e - w) * (n - s) * 111.32::DOUBLE * 111.32::DOUBLE * cos(radians((s + n) / 2))) AS km2 FROM ({RANGES}) r GROUP BY id) c"""


@query("pack_estimate", f"SELECT id, tile_count, bytes, round(km2, 4) AS area_km2, too_big, warn FROM ({ESTIMATE})")
def _(t):
    return P.pack_estimate(t["fires"]).withColumn("area_km2", F.round("area_km2", 4))


@query(
    "pack_size_distribution",
    f"""SELECT quantile_cont(tile_count, 0.5) AS tile_count_median, quantile_cont(tile_count, 0.9) AS tile_count_p90, CAST(max(tile_count) AS DOUBLE) AS tile_count_max, quantile_cont(bytes, 0.5) AS bytes_median, quantile_cont(bytes, 0.9) AS bytes_p90, CAST(max(bytes) AS DOUBLE) AS bytes_max, CAST(sum(tile_count) AS BIGINT) AS all_tiles FROM ({ESTIMATE})""",
)
def _(t):
    return P.pack_size_distribution(P.pack_estimate(t["fires"]))


COVER = f"""SELECT id AS fire_id, layer, z, x, y FROM (SELECT id, z, covered, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM ({RANGES}) r) a, (SELECT unnest(['base', 'landcover']) AS layer) l, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) b WHERE layer = 'base' OR covered"""


@query("pack_tile_cover", COVER)
def _(t):
    return P.pack_tile_cover(t["fires"])


@query("shared_tiles", f"SELECT layer, z, x, y, count(DISTINCT fire_id) AS packs FROM ({COVER}) GROUP BY ALL HAVING count(DISTINCT fire_id) > 1")
def _(t):
    return P.shared_tiles(P.pack_tile_cover(t["fires"]))


@query("orphan_tiles", f"WITH c AS ({COVER}) SELECT layer, z, x, y FROM c WHERE fire_id = '4' EXCEPT SELECT layer, z, x, y FROM c WHERE fire_id <> '4'")
def _(t):
    return P.orphan_tiles(P.pack_tile_cover(t["fires"]), "4")


@query("missing_tiles", f"WITH c AS ({COVER}) SELECT layer, z, x, y FROM c EXCEPT SELECT layer, z, x, y FROM stored_tiles")
def _(t):
    return P.missing_tiles(P.pack_tile_cover(t["fires"]), t["stored_tiles"])


@query(
    "prune_blank_tiles",
    "SELECT z, count(*) AS checked, count(*) FILTER (b <= 800 AND a = 0) AS removed, CAST(coalesce(sum(b) FILTER (b <= 800 AND a = 0), 0) AS BIGINT) AS freed FROM (SELECT z, x, y, max(alpha) AS a, max(bytes) AS b FROM tile_pixels GROUP BY ALL) t GROUP BY z",
)
def _(t):
    return P.prune_blank_tiles(t["tile_pixels"])


@query("shared_nodes", "SELECT e, n, count(DISTINCT fire_id) AS fires FROM grid GROUP BY e, n HAVING count(DISTINCT fire_id) > 1")
def _(t):
    return P.shared_nodes(t["grid"])


@query("grid_summary", "SELECT count(*) AS fires, CAST(sum(n) AS BIGINT) AS nodes, count(*) FILTER (n = 1) AS single, arg_max(fire_id, (n, fire_id)) AS largest, max(n) AS largest_n FROM (SELECT fire_id, count(*) AS n FROM grid GROUP BY fire_id) g")
def _(t):
    return P.grid_summary(t["grid"])


@query(
    "node_directions",
    """WITH l AS (SELECT device, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM gps_fixes GROUP BY device), d AS (SELECT l.*, t.node_id, (t.lon - l.lon) * 111320 * cos(radians(l.lat)) AS dx, (t.lat - l.lat) * 111320 AS dy FROM l JOIN nav_targets t USING (device)),
b AS (SELECT *, degrees(atan2(dx, dy)) + 360 - 360 * floor((degrees(atan2(dx, dy)) + 360) / 360) AS deg FROM d)
SELECT device, lat, lon, node_id, round(sqrt(dx * dx + dy * dy), 3) AS dist_m, CAST(floor(deg + 0.5) AS BIGINT) AS bearing_deg, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(deg / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass FROM b""",
)
def _(t):
    at = t["gps_fixes"].groupBy("device").agg(F.max_by("lat", "seq").alias("lat"), F.max_by("lon", "seq").alias("lon"))
    return X.node_directions(at, t["nav_targets"]).withColumn("dist_m", F.round("dist_m", 3))


#: Vertices of the rings on the national grid, step by step: to space, to the older datum, back to the ground, projected. Fixed values as in the functions.
_A, _B, _K = "6377563.396::DOUBLE", "6356256.909::DOUBLE", "0.9996012717::DOUBLE"
_ARC = f"({_A} - {_B}) / ({_A} + {_B})"
ON_GRID = f"""v AS (SELECT fire_id, poly, ring, k, radians(ay) AS la, radians(ax) AS lo, 6378137.0::DOUBLE / sqrt(1 - (1 - (6356752.314245::DOUBLE / 6378137.0::DOUBLE) ** 2) * sin(radians(ay)) ** 2) AS nu FROM edges),
space AS (SELECT * EXCLUDE (la, lo, nu), nu * cos(la) * cos(lo) AS x, nu * cos(la) * sin(lo) AS y, nu * (6356752.314245::DOUBLE / 6378137.0::DOUBLE) ** 2 * sin(la) AS z FROM v),
turn AS (SELECT radians(-0.1502::DOUBLE / 3600) AS rx, radians(-0.2470::DOUBLE / 3600) AS ry, radians(-0.8421::DOUBLE / 3600) AS rz, 1 + 20.4894e-6::DOUBLE AS s),
older AS (SELECT fire_id, poly, ring, k, -446.448::DOUBLE + s * x - rz * y + ry * z AS x, 125.157::DOUBLE + rz * x + s * y - rx * z AS y, -542.060::DOUBLE - ry * x + rx * y + s * z AS z FROM space, turn),
bowring AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {_A}, sqrt(x * x + y * y) * {_B}) AS t, 1 - ({_B} / {_A}) ** 2 AS e2 FROM older),
ground AS (SELECT *, atan2(z + (({_A} / {_B}) ** 2 - 1) * {_B} * sin(t) ** 3, p - e2 * {_A} * cos(t) ** 3) AS la, atan2(y, x) - radians(-2.0::DOUBLE) AS d FROM bowring),
radii AS (SELECT *, {_A} * {_K} / sqrt(1 - e2 * sin(la) ** 2) AS nu, {_A} * {_K} * (1 - e2) / (1 - e2 * sin(la) ** 2) ** 1.5::DOUBLE AS rho, tan(la) ** 2 AS t2, {_ARC} AS m, la - radians(49.0::DOUBLE) AS u, la + radians(49.0::DOUBLE) AS w FROM ground),
terms AS (SELECT *, nu / rho - 1 AS eta, sin(la) AS si, cos(la) AS co, {_B} * {_K} * ((1 + m + 1.25 * m ** 2 + 1.25 * m ** 3) * u - (3 * m + 3 * m ** 2 + 2.625 * m ** 3) * sin(u) * cos(w) + (1.875 * m ** 2 + 1.875 * m ** 3) * sin(2 * u) * cos(2 * w) - 35.0::DOUBLE / 24 * m ** 3 * sin(3 * u) * cos(3 * w)) AS arc FROM radii),
gridded AS (SELECT fire_id, poly, ring, k, 400000 + d * nu * co * (1 + d * d * co * co * ((nu / rho - t2) / 6 + d * d * co * co * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) / 120)) AS e,
  arc - 100000 + d * d * nu * si * co * (0.5 + d * d * co * co * ((5 - t2 + 9 * eta) / 24 + d * d * co * co * (61 - 58 * t2 + t2 * t2) / 720)) AS n FROM terms)"""


@query(
    "sampling_lattice",
    f"""WITH {ON_GRID},
sides AS (SELECT a.fire_id, a.e AS ae, a.n AS an, b.e AS be, b.n AS bn FROM gridded a JOIN gridded b ON b.fire_id = a.fire_id AND b.poly = a.poly AND b.ring = a.ring AND b.k = (a.k + 1) % 8),
scan AS (SELECT *, line * 100 + 50 AS y FROM (SELECT *, unnest(range(CAST(ceil((least(an, bn) - 50) / 100) AS BIGINT), CAST(floor((greatest(an, bn) - 50) / 100) AS BIGINT) + 1)) AS line FROM sides) s),
met AS (SELECT fire_id, y, ae + (y - an) / (bn - an) * (be - ae) AS x FROM scan WHERE (an > y) <> (bn > y)),
pairs AS (SELECT fire_id, y, x, lead(x) OVER (PARTITION BY fire_id, y ORDER BY x) AS x1, row_number() OVER (PARTITION BY fire_id, y ORDER BY x) AS rn FROM met)
SELECT DISTINCT fire_id, 100 * unnest(range(CAST(ceil((x - 50) / 100) AS BIGINT), CAST(floor((x1 - 50) / 100) AS BIGINT) + 1)) + 50 AS e, y AS n, FALSE AS fallback, TRUE AS comes_back FROM pairs WHERE rn % 2 = 1""",
)
def _(t):
    # a node's degrees, brought to the grid again, are its own metres: the inverse by a way of its own is compared with to_grid, which the SQL follows
    nodes = geo.with_grid(X.sampling_lattice(t["fires"]), "lat", "lon", "back_e", "back_n")
    return nodes.select("fire_id", "e", "n", "fallback", ((F.abs(F.col("back_e") - F.col("e")) < 0.2) & (F.abs(F.col("back_n") - F.col("n")) < 0.2)).alias("comes_back"))


@query(
    "sampling_fallback",
    # fires a fortieth as wide: many lie between the nodes
    f"""WITH shrunk AS (SELECT fire_id, poly, ring, k, lon0 + (ax - lon0) / 40 AS ax, lat0 + (ay - lat0) / 40 AS ay FROM edges JOIN fire_base ON id = fire_id), {ON_GRID.replace("FROM edges", "FROM shrunk")},
sides AS (SELECT a.fire_id, a.e AS ae, a.n AS an, b.e AS be, b.n AS bn FROM gridded a JOIN gridded b ON b.fire_id = a.fire_id AND b.poly = a.poly AND b.ring = a.ring AND b.k = (a.k + 1) % 8),
scan AS (SELECT *, line * 100 + 50 AS y FROM (SELECT *, unnest(range(CAST(ceil((least(an, bn) - 50) / 100) AS BIGINT), CAST(floor((greatest(an, bn) - 50) / 100) AS BIGINT) + 1)) AS line FROM sides) s),
met AS (SELECT fire_id, y, ae + (y - an) / (bn - an) * (be - ae) AS x FROM scan WHERE (an > y) <> (bn > y)),
pairs AS (SELECT fire_id, y, x, lead(x) OVER (PARTITION BY fire_id, y ORDER BY x) AS x1, row_number() OVER (PARTITION BY fire_id, y ORDER BY x) AS rn FROM met),
nodes AS (SELECT DISTINCT fire_id, 100 * unnest(range(CAST(ceil((x - 50) / 100) AS BIGINT), CAST(floor((x1 - 50) / 100) AS BIGINT) + 1)) + 50 AS e, y AS n FROM pairs WHERE rn % 2 = 1),
middle AS (SELECT fire_id, (min(n) + max(n)) / 2 AS y FROM gridded WHERE fire_id NOT IN (SELECT fire_id FROM nodes) GROUP BY fire_id),
across AS (SELECT s.fire_id, m.y, s.ae + (m.y - s.an) / (s.bn - s.an) * (s.be - s.ae) AS x FROM sides s JOIN middle m USING (fire_id) WHERE (s.an > m.y) <> (s.bn > m.y)),
spans AS (SELECT fire_id, y, x, lead(x) OVER (PARTITION BY fire_id ORDER BY x) AS x1, row_number() OVER (PARTITION BY fire_id ORDER BY x) AS rn FROM across),
widest AS (SELECT fire_id, max((x1 - x, x, x1, y)) AS s FROM spans WHERE rn % 2 = 1 GROUP BY fire_id)
SELECT fire_id, CAST(e AS BIGINT) AS e, CAST(n AS BIGINT) AS n, FALSE AS fallback FROM nodes UNION ALL SELECT fire_id, CAST(floor((s[2] + s[3]) / 2 + 0.5) AS BIGINT), CAST(floor(s[4] + 0.5) AS BIGINT), TRUE FROM widest""",
)
def _(t):
    centre = t["fire_base"].select("id", "lon0", "lat0")
    nearer = lambda v: F.struct((F.col("lon0") + (v["lon"] - F.col("lon0")) / 40).alias("lon"), (F.col("lat0") + (v["lat"] - F.col("lat0")) / 40).alias("lat"))
    small = t["fires"].join(centre, "id").withColumn("geom", F.transform("geom", lambda poly: F.transform(poly, lambda ring: F.transform(ring, nearer))))
    return X.sampling_lattice(small).select("fire_id", "e", "n", "fallback")


def _vertices(fires):
    """A row a vertex."""
    rings = fires.select(F.col("id").alias("fire_id"), F.posexplode("geom").alias("poly", "rings")).select("fire_id", "poly", F.posexplode("rings").alias("ring", "points"))
    return rings.select("fire_id", "poly", "ring", F.posexplode("points").alias("pos", "v")).select("fire_id", "poly", "ring", "pos", F.round("v.lon", 9).alias("lon"), F.round("v.lat", 9).alias("lat"))


@query(
    "simplify_perimeters",
    # a middle that no waist moved lies on its side and goes; every other vertex is farther than the tolerance from all lines between others
    """WITH v AS (SELECT fire_id, poly, ring, k, cx + sx * half * CASE WHEN mid = 1 THEN waist ELSE 1 END AS lon, cy + sy * half * CASE WHEN mid = 1 THEN waist ELSE 1 END AS lat FROM rings CROSS JOIN corners WHERE mid = 0 OR waist < 1),
closed AS (SELECT * FROM v UNION ALL SELECT fire_id, poly, ring, 8, lon, lat FROM v WHERE k = 0)
SELECT fire_id, poly, ring, CAST(row_number() OVER (PARTITION BY fire_id, poly, ring ORDER BY k) - 1 AS INT) AS pos, round(lon, 9) AS lon, round(lat, 9) AS lat FROM closed""",
)
def _(t):
    return _vertices(X.simplify_perimeters(t["fires"]))


# pixels


@query("valid_pixels", f"SELECT fire_id, row, col, dnbr FROM pixels WHERE {Q.VALID}")
def _(t):
    return R.valid_pixels(t["pixels"]).select("fire_id", "row", "col", "dnbr")


CENTRES = f"SELECT p.fire_id, p.row, p.col, p.dnbr, degrees((x0 + (col + 0.5::DOUBLE) * px) / 6378137.0::DOUBLE) AS lon, {Q.inverse_lat('y0 + (row + 0.5::DOUBLE) * py')} AS lat FROM pixels p JOIN raster r USING (fire_id)"


#: The rasters of the derived tables are flat in latitude; this puts each over its own fire.
def _placed(t):
    base = t["fire_base"].select(F.col("id").alias("fire_id"), "lat0", "h")
    top = geo.mercator_y(F.col("lat0") + F.col("h") * 1.3)
    bottom = geo.mercator_y(F.col("lat0") - F.col("h") * 1.3)
    return t["raster"].drop("y0", "py").join(base, "fire_id").select("fire_id", "x0", top.alias("y0"), "px", ((bottom - top) / 32).alias("py"), "width", "height", "nodata")


_MERC = "ln(tan(pi() / 4 + radians({0}) / 2)) * 6378137.0::DOUBLE"
_TOP, _BOTTOM = _MERC.format("lat0 + h * 1.3::DOUBLE"), _MERC.format("lat0 - h * 1.3::DOUBLE")
PLACED = f"SELECT r.fire_id, r.x0, {_TOP} AS y0, r.px, ({_BOTTOM} - {_TOP}) / 32 AS py, r.width, r.height FROM raster r JOIN fire_base b ON b.id = r.fire_id"
_AT = f"SELECT p.fire_id, p.row, p.col, p.dnbr, p.code, degrees((x0 + (col + 0.5::DOUBLE) * px) / 6378137.0::DOUBLE) AS lon, {Q.inverse_lat('y0 + (row + 0.5::DOUBLE) * py')} AS lat FROM pixels p JOIN ({PLACED}) r USING (fire_id)"
CLIPPED = f"""SELECT fire_id, row, col, dnbr FROM (SELECT p.fire_id, p.row, p.col, p.dnbr, count(e.fire_id) FILTER (((e.by > p.lat) <> (e.ay > p.lat)) AND p.lon < (e.ax - e.bx) * (p.lat - e.by) / (e.ay - e.by) + e.bx) % 2 AS odd FROM ({_AT}) p JOIN edges e USING (fire_id) GROUP BY ALL) x WHERE odd = 1"""


@query("clip_to_perimeter", CLIPPED)
def _(t):
    return R.clip_to_perimeter(t["pixels"], _placed(t), t["fires"]).select("fire_id", "row", "col", "dnbr")


@query(
    "resample_landcover",
    f"""WITH c AS (SELECT row, col, arg_max(code, CAST(fire_id AS INT)) AS code FROM pixels GROUP BY row, col), p AS (SELECT p.fire_id, p.row, p.col, CAST(floor((x0 + (p.col + 0.5::DOUBLE) * px + 700000) / 25000) AS BIGINT) AS lc, CAST(floor((y0 + (p.row + 0.5::DOUBLE) * py - 8500000) / -40000) AS BIGINT) AS lr FROM pixels p JOIN ({PLACED}) r USING (fire_id))
SELECT p.fire_id, p.row, p.col, greatest(0, least(599, coalesce(c.code, 0))) AS code FROM p LEFT JOIN c ON c.row = p.lr AND c.col = p.lc""",
)
def _(t):
    cover = R.mosaic_landcover(t["pixels"].select("row", "col", "code", F.col("fire_id").cast("int").alias("file_order")))
    return R.resample_landcover(t["pixels"].select("fire_id", "row", "col"), _placed(t), cover, -700000.0, 8500000.0, 25000.0, -40000.0)


@query("mosaic_landcover", "SELECT row, col, arg_max(code, CAST(fire_id AS INT)) AS code FROM pixels GROUP BY row, col")
def _(t):
    return R.mosaic_landcover(t["pixels"].select("row", "col", "code", F.col("fire_id").cast("int").alias("file_order")))


@query(
    "mosaic_rasters",
    """WITH o AS (SELECT min(x0) AS lx, max(y0) AS ly FROM cover_files), placed AS (SELECT CAST(round((f.y0 - ly) / f.py) AS INT) + c.row AS row, CAST(round((f.x0 - lx) / f.px) AS INT) + c.col AS col, c.code, f.file_order FROM cover_cells c JOIN cover_files f USING (file_order) CROSS JOIN o WHERE c.code <> f.nodata)
SELECT row, col, arg_max(code, file_order) AS code FROM placed GROUP BY row, col""",
)
def _(t):
    return R.mosaic_rasters(t["cover_cells"], t["cover_files"])[0]


@query("landcover_groups", f"SELECT fire_id, row, col, {Q.GROUP} AS landcover FROM pixels")
def _(t):
    return R.landcover_groups(t["pixels"]).select("fire_id", "row", "col", "landcover")


@query("peat_flag", "SELECT fire_id, row, col, CASE WHEN code IN (412, 411, 322, 321, 324) THEN 1 ELSE 0 END AS peat FROM pixels")
def _(t):
    return R.peat_flag(t["pixels"]).select("fire_id", "row", "col", "peat")


def _crosstab(t):
    return R.severity_landcover_crosstab(t["pixels"], t["raster"])


@query("severity_landcover_crosstab", Q.CROSSTAB)
def _(t):
    return _crosstab(t)


@query("severity_stats", f"SELECT fire_id, count(*) AS px, round(avg(dnbr), 1) AS mean, round(quantile_cont(dnbr, 0.9), 1) AS p90, round(avg(CASE WHEN dnbr >= 440 THEN 1 ELSE 0 END), 3) AS severe_frac FROM pixels WHERE {Q.VALID} GROUP BY fire_id")
def _(t):
    return R.severity_stats(t["pixels"])


@query("landcover_histogram", "SELECT fire_id, code, count(*) AS n FROM pixels GROUP BY fire_id, code")
def _(t):
    return R.landcover_histogram(t["pixels"])


@query(
    "chart_rollup",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY row_ha DESC, landcover) AS rn, count(*) OVER (PARTITION BY fire_id) AS n FROM ({Q.CROSSTAB})),
g AS (SELECT fire_id, CASE WHEN n > 7 AND rn >= 7 THEN 'Other (' || (n - 6) || ' classes)' ELSE landcover END AS landcover, CAST(min(rn) AS INT) AS pos, {', '.join(f'round(sum({s}), 2) AS {s}' for s in Q.NAMES)}, round(sum(row_ha), 2) AS row_ha FROM r GROUP BY 1, 2)
SELECT *, round(sum(row_ha) OVER w, 2) AS grand_ha, round(sum({' + '.join(Q.NAMES[2:])}) OVER w / sum(row_ha) OVER w, 4) AS burned_share FROM g WINDOW w AS (PARTITION BY fire_id)""",
)
def _(t):
    return R.chart_rollup(_crosstab(t))


@query("landcover_share", f"SELECT landcover, round(sum(row_ha), 2) AS ha, round(sum(row_ha) / sum(sum(row_ha)) OVER (), 4) AS share FROM ({Q.CROSSTAB}) GROUP BY landcover")
def _(t):
    return R.landcover_share(_crosstab(t))


@query("top_area_per_landcover", f"SELECT landcover, CAST(rank AS INT) AS rank, fire_id, row_ha FROM (SELECT *, row_number() OVER (PARTITION BY landcover ORDER BY row_ha DESC, fire_id) AS rank FROM ({Q.CROSSTAB})) x WHERE rank <= 3")
def _(t):
    return P.top_area_per_landcover(_crosstab(t))


@query(
    "severity_ranking",
    f"""(SELECT 'most_severe' AS list, fire_id, round(avg(CASE WHEN dnbr >= 440 THEN 1 ELSE 0 END), 3) AS value FROM pixels WHERE {Q.VALID} GROUP BY fire_id ORDER BY value DESC, fire_id LIMIT 3)
UNION ALL (SELECT 'largest', id, CAST(area_ha AS DOUBLE) FROM fire_base WHERE area_ha IS NOT NULL ORDER BY area_ha DESC, id LIMIT 3)""",
)
def _(t):
    return R.severity_ranking(R.severity_stats(t["pixels"]), t["fires"])


@query(
    "area_validation",
    f"""SELECT count(*) AS fires, round(quantile_cont(e, 0.5), 4) AS median_error, round(max(e), 4) AS worst_error FROM (SELECT abs(total_ha - area_ha) / area_ha AS e FROM (SELECT DISTINCT fire_id, total_ha FROM ({Q.CROSSTAB})) c JOIN fire_base ON id = fire_id WHERE area_ha > 0) x""",
)
def _(t):
    return R.area_validation(_crosstab(t), t["fires"])


@query(
    "sample_severity",
    f"""WITH a AS (SELECT g.fire_id, g.e, g.n, CAST(floor((radians(g.lon) * 6378137.0::DOUBLE - x0) / px) AS INT) AS col, CAST(floor(({_MERC.format('g.lat')} - y0) / py) AS INT) AS row FROM grid g LEFT JOIN ({PLACED}) r USING (fire_id))
SELECT a.fire_id, e, n, CASE WHEN a.col BETWEEN 0 AND 23 AND a.row BETWEEN 0 AND 31 AND dnbr IS NOT NULL AND dnbr <> -32768 THEN {Q.SEVERITY} ELSE -1 END AS sev FROM a LEFT JOIN pixels p ON p.fire_id = a.fire_id AND p.row = a.row AND p.col = a.col""",
)
def _(t):
    return R.sample_severity(t["grid"], _placed(t), t["pixels"])


# imagery

MASKED = "SELECT *, b8a / 10000 AS r8, b12 / 10000 AS r12 FROM observations WHERE cloud_pct < 70 AND scl NOT IN (1, 3, 7, 8, 9, 10, 11)"


@query("mask_scenes", f"SELECT scene_id, row, col, r8 AS b8a, r12 AS b12 FROM ({MASKED})")
def _(t):
    return R.mask_scenes(t["observations"]).select("scene_id", "row", "col", "b8a", "b12")


def _windowed(source: str) -> str:
    return f"""SELECT * FROM (SELECT o.*, CASE WHEN scene_ts >= date_trunc('day', firedate) - INTERVAL 8 DAY AND scene_ts < date_trunc('day', firedate) - INTERVAL 1 DAY THEN 'pre' WHEN scene_ts >= date_trunc('day', finaldate) + INTERVAL 1 DAY AND scene_ts < date_trunc('day', finaldate) + INTERVAL 8 DAY THEN 'post' END AS phase
FROM ({source}) o JOIN fire_base f ON f.id = o.fire_id) x WHERE phase IS NOT NULL"""


@query("fire_scene_windows", f"SELECT scene_id, fire_id, phase FROM ({_windowed('SELECT * FROM observations')})")
def _(t):
    return R.fire_scene_windows(t["observations"], t["fires"], 8, 8, 1).select("scene_id", "fire_id", "phase")


@query(
    "scenes_of_fires",
    """WITH f AS (SELECT b.*, date_trunc('day', firedate) AS f0, date_trunc('day', finaldate) AS f1 FROM bounds b JOIN fire_base USING (id)),
p AS (SELECT id, w, s, e, n, 'pre' AS phase, f0 - INTERVAL 8 DAY AS a, f0 - INTERVAL 1 DAY AS b FROM f UNION ALL SELECT id, w, s, e, n, 'post', f1 + INTERVAL 1 DAY, f1 + INTERVAL 8 DAY FROM f)
SELECT scene_id, id AS fire_id, phase FROM scenes c JOIN p ON scene_ts >= a AND scene_ts < b AND c.w <= p.e AND c.e >= p.w AND c.s <= p.n AND c.n >= p.s""",
)
def _(t):
    boxes = t["bounds"].join(t["fire_base"].select("id", "firedate", "finaldate"), "id")
    return R.scenes_of_fires(t["scenes"], boxes, 8, 8, 1)


COMPOSITE = f"SELECT fire_id, row, col, phase, quantile_cont((r8 - r12) / (r8 + r12), 0.5) AS nbr FROM ({_windowed(MASKED)}) w WHERE r8 + r12 <> 0 GROUP BY ALL"


def _composite(t):
    return R.median_composite(R.fire_scene_windows(R.mask_scenes(t["observations"]), t["fires"], 8, 8, 1))


@query("median_composite", f"SELECT fire_id, row, col, phase, round(nbr, 6) AS nbr FROM ({COMPOSITE})")
def _(t):
    return _composite(t).withColumn("nbr", F.round("nbr", 6))


BURN = f"SELECT a.fire_id, a.row, a.col, (a.nbr - b.nbr) * 1000 AS dnbr, (a.nbr - b.nbr) * 1000 / greatest(sqrt(abs(a.nbr)), 0.001) AS rdnbr FROM ({COMPOSITE}) a JOIN ({COMPOSITE}) b ON a.fire_id = b.fire_id AND a.row = b.row AND a.col = b.col AND a.phase = 'pre' AND b.phase = 'post'"


@query("burn_severity", f"SELECT fire_id, row, col, round(dnbr, 4) AS dnbr, round(rdnbr, 4) AS rdnbr FROM ({BURN})")
def _(t):
    return R.burn_severity(_composite(t)).withColumn("dnbr", F.round("dnbr", 4)).withColumn("rdnbr", F.round("rdnbr", 4))


@query(
    "dnbr_summary",
    f"""SELECT f.id AS fire_id, coalesce(n_pre, 0) AS n_pre, coalesce(n_post, 0) AS n_post, mean, median, p90, coalesce(n_pixels, 0) AS n_pixels FROM fire_base f
LEFT JOIN (SELECT fire_id, count(DISTINCT scene_id) FILTER (phase = 'pre') AS n_pre, count(DISTINCT scene_id) FILTER (phase = 'post') AS n_post FROM ({_windowed('SELECT * FROM observations WHERE cloud_pct < 70')}) s GROUP BY fire_id) s ON s.fire_id = f.id
LEFT JOIN (SELECT fire_id, round(avg(dnbr), 3) AS mean, round(quantile_cont(dnbr, 0.5), 3) AS median, round(quantile_cont(dnbr, 0.9), 3) AS p90, count(*) AS n_pixels FROM ({BURN}) b GROUP BY fire_id) b ON b.fire_id = f.id""",
)
def _(t):
    windowed = R.fire_scene_windows(t["observations"], t["fires"], 8, 8, 1)
    return R.dnbr_summary(t["fires"], windowed, R.burn_severity(_composite(t)))


@query(
    "build_pack_table",
    f"""SELECT f.id, {NAME} AS name, CAST(f.id AS INT) % 2 = 0 AS detailed, round(b.w, 9) AS w, round(b.s, 9) AS s, round(b.e, 9) AS e, round(b.n, 9) AS n, k.vertices, s.severe_frac, s.mean, s.p90, c.total_ha, c.peat_high, coalesce(g.k, 0) AS grid_count,
  z.tile_count, t.bytes, 0 AS failed, 4 AS version, 'topo' AS basemap, f.commune, f.firedate FROM fire_base f JOIN bounds b ON b.id = f.id
JOIN (SELECT fire_id, CAST(count(*) * 9 AS INT) AS vertices FROM rings GROUP BY fire_id) k ON k.fire_id = f.id JOIN ({ESTIMATE}) z ON z.id = f.id
LEFT JOIN (SELECT fire_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM stored_tiles GROUP BY fire_id) t ON t.fire_id = f.id
LEFT JOIN (SELECT fire_id, round(avg(CASE WHEN dnbr >= 440 THEN 1 ELSE 0 END), 3) AS severe_frac, round(avg(dnbr), 1) AS mean, round(quantile_cont(dnbr, 0.9), 1) AS p90 FROM pixels WHERE {Q.VALID} GROUP BY fire_id) s ON s.fire_id = f.id
LEFT JOIN (SELECT fire_id, max(total_ha) AS total_ha, max(high) FILTER (landcover = 'Peat bogs') AS peat_high FROM ({Q.CROSSTAB}) GROUP BY fire_id) c ON c.fire_id = f.id LEFT JOIN (SELECT fire_id, count(*) AS k FROM grid GROUP BY fire_id) g ON g.fire_id = f.id""",
)
def _(t):
    stats = io.stats_documents(_crosstab(t), R.SEVERITIES)
    out = P.build_pack_table(t["fires"], t["fires"].where("index_pos % 2 = 0"), R.severity_stats(t["pixels"]), stats, t["grid"], t["stored_tiles"])
    box = [F.round(f"bbox.{c}", 9).alias(c) for c in "wsen"]
    return out.select("id", "name", "detailed", *box, F.size(F.flatten(F.flatten("geom"))).alias("vertices"), "dnbr.severe_frac", "dnbr.mean", "dnbr.p90", "stats.total_ha", F.element_at(F.col("stats.matrix")["Peat bogs"], 6).alias("peat_high"), "grid_count", "tile_count", "bytes", "failed", "version", "basemap", "props.commune", "props.firedate")


@query("raster_bounds", f"SELECT fire_id, round(degrees(x0 / 6378137.0::DOUBLE), 6) AS w, round({Q.inverse_lat('y0 + height * py')}, 6) AS s, round(degrees((x0 + width * px) / 6378137.0::DOUBLE), 6) AS e, round({Q.inverse_lat('y0')}, 6) AS n FROM ({PLACED})")
def _(t):
    return R.raster_bounds(_placed(t)).select("fire_id", *[F.round(c, 6).alias(c) for c in "wsen"])


@query(
    "number_formats",
    """SELECT fire_id, CASE WHEN bytes IS NULL THEN '-' WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN CAST(floor(bytes / 1024 + 0.5) AS BIGINT) || ' kB' WHEN bytes < 1073741824 THEN printf('%.1f', floor(bytes / 1048576 * 10 + 0.5) / 10) || ' MB' ELSE printf('%.2f', floor(bytes / 1073741824 * 100 + 0.5) / 100) || ' GB' END AS size,
  CASE WHEN m < 1000 THEN CAST(floor(m + 0.5) AS BIGINT) || ' m' WHEN m < 10000 THEN printf('%.1f', floor(m / 1000 * 10 + 0.5) / 10) || ' km' ELSE CAST(floor(m / 1000 + 0.5) AS BIGINT) || ' km' END AS distance
FROM (SELECT fire_id, bytes * CAST(fire_id AS BIGINT) * CAST(fire_id AS BIGINT) AS bytes, tile_count * 173 AS m FROM packs) x""",
)
def _(t):
    from ..functions import text

    n = F.col("fire_id").cast("bigint")
    return t["packs"].select("fire_id", text.byte_size(F.col("bytes") * n * n).alias("size"), text.distance(F.col("tile_count") * 173).alias("distance"))


@query(
    "tile_corners",
    "SELECT DISTINCT layer, z, x, y, round(x / pow(2.0::DOUBLE, z) * 360 - 180, 9) AS lon, round(degrees(atan((exp(pi() * (1 - 2 * y / pow(2.0::DOUBLE, z))) - exp(-pi() * (1 - 2 * y / pow(2.0::DOUBLE, z)))) / 2)), 9) AS lat FROM stored_tiles",
)
def _(t):
    corner = (F.round(geo.tile_lon("x", "z"), 9).alias("lon"), F.round(geo.tile_lat("y", "z"), 9).alias("lat"))
    return t["stored_tiles"].select("layer", "z", "x", "y").distinct().select("*", *corner)


@query(
    "sql_tile_cover",
    f"""WITH t AS (SELECT id, {Q.tile_x('w', '8')} AS x0, {Q.tile_x('e', '8')} AS x1, {Q.tile_y('n', '8')} AS y0, {Q.tile_y('s', '8')} AS y1 FROM bounds), x AS (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t), y AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM x)
SELECT id AS fire_id, x, y, round(x / pow(2.0::DOUBLE, 8) * 360 - 180, 9) AS lon FROM y""",
)
def _(t):
    sql_functions(t.spark)
    return t.spark.sql("SELECT id AS fire_id, c.x, c.y, round(tile_lon(c.x, 8), 9) AS lon FROM {bounds} b, LATERAL tiles_of_box(b.w, b.s, b.e, b.n, 8) c", bounds=t["bounds"])


@query(
    "sql_severity_area",
    f"SELECT fire_id, {Q.SEVERITY} AS sev, count(*) AS n FROM pixels WHERE {Q.VALID} GROUP BY ALL",
)
def _(t):
    sql_functions(t.spark)
    return t.spark.sql("SELECT fire_id, severity_class(CAST(dnbr AS DOUBLE)) AS sev, count(*) AS n FROM {pixels} WHERE dnbr IS NOT NULL AND dnbr <> -32768 GROUP BY 1, 2", pixels=t["pixels"])


@query(
    "sql_box_nodes",
    """SELECT fire_id, 1000 * i + 500 AS easting, 1000 * unnest(range(CAST(ceil(s / 1000.0::DOUBLE - 0.5::DOUBLE) AS BIGINT), CAST(floor(n / 1000.0::DOUBLE - 0.5::DOUBLE) AS BIGINT) + 1)) + 500 AS northing
FROM (SELECT *, unnest(range(CAST(ceil(w / 1000.0::DOUBLE - 0.5::DOUBLE) AS BIGINT), CAST(floor(e / 1000.0::DOUBLE - 0.5::DOUBLE) AS BIGINT) + 1)) AS i FROM (SELECT id AS fire_id, 100000 + index_pos * 437 AS w, 200000 + index_pos * 911 AS s, 107300 + index_pos * 437 AS e, 204800 + index_pos * 911 AS n FROM fire_base) b) x""",
)
def _(t):
    sql_functions(t.spark)
    return t.spark.sql("SELECT id AS fire_id, c.easting, c.northing FROM {fires} f, LATERAL nodes_of_box(100000D + index_pos * 437, 200000D + index_pos * 911, 107300D + index_pos * 437, 204800D + index_pos * 911, 1000) c", fires=t["fire_base"])
