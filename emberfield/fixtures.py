"""Survey tables derived from the given star schema.

Each table is one SELECT that Spark and DuckDB both run, so an operator and the SQL
that checks it see the same rows. Only integer arithmetic and exact divisions are used, but for the
distance to a grid node. A few words differ between the two dialects and stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIALECT = {
    "spark": {"TS": "TIMESTAMP_NTZ", "LIST": "transform(sort_array(collect_list(struct(k, depth))), x -> x.depth)", "DIV": "div"},
    "duckdb": {"TS": "TIMESTAMP", "LIST": "list(depth ORDER BY k)", "DIV": "//"},
}

TABLES = {
    # one row a fire, with the centre and half-size of its first square
    "fire_base": """
SELECT CAST(s_suppkey AS INT) AS index_pos, CAST(s_suppkey AS STRING) AS id, -6e0 + (s_suppkey * 37 % 700) / 1e2 AS lon0, 505e-1 + (s_suppkey * 53 % 800) / 1e2 AS lat0,
       2e-2 + (s_suppkey % 7) / 1e2 AS h,
       CASE WHEN s_suppkey % 11 = 3 THEN NULL WHEN s_suppkey % 11 = 4 THEN ' ' WHEN s_suppkey % 11 = 5 THEN '0' ELSE n_name END AS commune,
       CASE WHEN s_suppkey % 4 = 0 THEN n_name WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'Province ' || CAST(s_suppkey % 13 AS STRING) END AS province,
       CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'UK' END AS country, CASE WHEN s_suppkey % 2 = 0 THEN '30DAYS' ELSE 'FIRESEASON' END AS class,
       {TS} '2024-01-12 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey % 96 AS INT) AS firedate,
       {TS} '2024-01-12 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey % 96 + (s_suppkey % 6) * (s_suppkey % 6) * 4 AS INT) AS finaldate,
       CASE WHEN s_suppkey % 17 = 7 THEN NULL ELSE (s_suppkey % 7 + 1) * (s_suppkey % 7 + 1) * 51 / 1e1 + s_suppkey % 3 END AS area_ha
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    # a ring's eight vertices: corners of a square, and the middles of its sides, which the waist draws towards the centre
    "corners": "SELECT * FROM (VALUES (0, -1, -1, 0), (1, 0, -1, 1), (2, 1, -1, 0), (3, 1, 0, 1), (4, 1, 1, 0), (5, 0, 1, 1), (6, -1, 1, 0), (7, -1, 0, 1)) AS corner(k, sx, sy, mid)",
    "rings": """
SELECT id AS fire_id, 0 AS poly, 0 AS ring, lon0 AS cx, lat0 AS cy, h AS half, CASE WHEN index_pos % 2 = 0 THEN 55e-2 ELSE 1e0 END AS waist FROM fire_base
UNION ALL SELECT id, 0, 1, lon0, lat0, h / 2, CASE WHEN index_pos % 4 < 2 THEN 4e-1 ELSE 1e0 END FROM fire_base WHERE index_pos % 3 = 0
UNION ALL SELECT id, 1, 0, lon0 + h * 2, lat0, h / 2, 7e-1 FROM fire_base WHERE index_pos % 5 = 0""",
    "edges": """
SELECT fire_id, poly, ring, a.k AS k, cx + a.sx * half * CASE WHEN a.mid = 1 THEN waist ELSE 1e0 END AS ax, cy + a.sy * half * CASE WHEN a.mid = 1 THEN waist ELSE 1e0 END AS ay,
       cx + b.sx * half * CASE WHEN b.mid = 1 THEN waist ELSE 1e0 END AS bx, cy + b.sy * half * CASE WHEN b.mid = 1 THEN waist ELSE 1e0 END AS by
FROM rings CROSS JOIN corners AS a JOIN corners AS b ON b.k = (a.k + 1) % 8""",
    "bounds": """
SELECT fire_id AS id, min(cx - half) AS w, min(cy - half) AS s, max(cx + half) AS e, max(cy + half) AS n FROM rings GROUP BY fire_id""",
    "depth_rows": """
SELECT uuid, k, depth FROM (
  SELECT 'measurement-' || CAST(l_orderkey AS STRING) AS uuid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS k,
         CASE WHEN l_quantity < 6 THEN NULL ELSE l_quantity * 2 END AS depth FROM lineitem) x WHERE k <= 5""",
    "measurements": """
SELECT m.uuid, m.fire_id, CASE WHEN m.fire_id IS NOT NULL THEN m.true_name END AS fire_name, m.lat, m.lon, m.accuracy_m, m.manual_placement, d.depths, m.combustion,
       CASE WHEN m.grid_m <= 60 THEN m.node END AS grid_id, CASE WHEN m.grid_m <= 60 THEN CAST(floor(m.grid_m + 5e-1) AS BIGINT) END AS grid_dist_m, m.comment, m.surveyor, m.user_id, m.user_id || '@example.org' AS user_email, m.status, m.created_at,
       CASE WHEN NOT m.photo_pending THEN m.created_at + INTERVAL '1' MINUTE * CAST(m.o_orderkey % 600 AS INT) END AS synced_at, CASE WHEN m.o_orderkey % 13 = 0 THEN 'comment-coordinates' END AS location_source,
       CASE WHEN NOT m.photo_pending AND m.photo_count > 0 THEN m.photo_path || '-0.jpg' END AS photo_url,
       CASE WHEN NOT m.photo_pending AND m.photo_count > 0 THEN split(m.photo_path || '-0.jpg' || CASE WHEN m.photo_count > 1 THEN ' ' || m.photo_path || '-1.jpg' ELSE '' END || CASE WHEN m.photo_count > 2 THEN ' ' || m.photo_path || '-2.jpg' ELSE '' END, ' ') END AS photo_urls,
       m.photo_count, m.photo_pending, m.true_fire
FROM (SELECT x.*, 'E' || CAST(100 * i + 1000 * index_pos + 50 AS STRING) || ' N' || CAST(100 * j + 50 AS STRING) AS node, 'https://example.org/photos/' || coalesce(fire_id, 'unassigned') || '/' || uuid AS photo_path,
       CASE WHEN fire_id IS NOT NULL THEN sqrt(pow(h * (i * 18 - 99 - dx) / 1e2 * 11132e1 * cos(radians(lat)), 2) + pow(h * (j * 18 - 99 - dy) / 1e2 * 11132e1, 2)) END AS grid_m
FROM (SELECT y.*, least(11, (dx + 107) {DIV} 18) AS i, least(11, (dy + 107) {DIV} 18) AS j FROM (
  SELECT 'measurement-' || CAST(o_orderkey AS STRING) AS uuid, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE f.id END AS fire_id, f.id AS true_fire, f.index_pos, f.h, (o_orderkey % 21 - 10) * 11 + 3 AS dx, ((o_orderkey {DIV} 21) % 21 - 10) * 11 + 3 AS dy,
         CASE WHEN coalesce(trim(f.commune), '') IN ('', '0') THEN coalesce(f.province, 'Unnamed fire') WHEN f.province IS NULL OR f.province = f.commune THEN f.commune ELSE f.commune || ', ' || f.province END AS true_name,
         f.lat0 + f.h * (((o_orderkey {DIV} 21) % 21 - 10) * 11 + 3) / 1e2 AS lat, f.lon0 + f.h * ((o_orderkey % 21 - 10) * 11 + 3) / 1e2 AS lon,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 7 % 450) / 1e1 END AS accuracy_m, o_orderkey % 5 = 0 AS manual_placement,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'near_complete' WHEN '2' THEN 'moderate' WHEN '3' THEN 'light' WHEN '4' THEN 'unburned' END AS combustion,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 37 = 1 THEN 'edge of bog, "wet"' ELSE 'note ' || CAST(o_orderkey % 50 AS STRING) END AS comment,
         CASE WHEN o_orderkey % 8 = 1 THEN '' WHEN o_orderkey % 8 = 2 THEN NULL ELSE 'surveyor ' || CAST(o_custkey % 40 AS STRING) END AS surveyor,
         CASE WHEN o_orderkey % 16 = 1 THEN NULL ELSE 'user-' || CAST(o_custkey AS STRING) END AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'pending_review' ELSE 'rejected' END AS status,
         o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS INT) AS created_at,
         CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS photo_count, o_orderkey % 7 = 0 AS photo_pending
  FROM (SELECT *, o_orderkey % nf AS home FROM orders CROSS JOIN (SELECT count(*) AS nf FROM supplier) s) o JOIN fire_base f ON f.index_pos = home) y) x) m
LEFT JOIN (SELECT uuid, {LIST} AS depths FROM depth_rows GROUP BY uuid) d ON m.uuid = d.uuid""",
    "grid": """
SELECT b.id AS fire_id, 100 AS spacing, CAST(i * 12 + j AS INT) AS node_pos, CAST(100 * i + 1000 * b.index_pos + 50 AS BIGINT) AS e, CAST(100 * j + 50 AS BIGINT) AS n,
       b.lat0 + b.h * (j * 18 - 99) / 1e2 AS lat, b.lon0 + b.h * (i * 18 - 99) / 1e2 AS lon, CAST((i * 5 + j * 3 + b.index_pos) % 7 - 1 AS INT) AS sev
FROM fire_base b CROSS JOIN (SELECT n_nationkey % 12 AS i FROM nation WHERE n_nationkey < 12) x CROSS JOIN (SELECT n_nationkey AS j FROM nation WHERE n_nationkey < 12) y""",
    "raster": """
SELECT id AS fire_id, (lon0 - h * 13e-1) * 111319490793e-6 AS x0, (lat0 + h * 13e-1) * 2e5 AS y0, h * 26e-1 / 24 * 111319490793e-6 AS px, -h * 26e-1 / 32 * 2e5 AS py, 24 AS width, 32 AS height, -32768 AS nodata
FROM fire_base""",
    "pixels": """
SELECT CAST(l_suppkey AS STRING) AS fire_id, CAST(rn {DIV} 24 AS INT) AS row, CAST(rn % 24 AS INT) AS col,
       CASE WHEN l_partkey % 17 = 0 THEN -32768 ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1300 - 350 AS INT) END AS dnbr,
       CAST(CASE l_partkey % 13 WHEN 0 THEN 412 WHEN 1 THEN 411 WHEN 2 THEN 322 WHEN 3 THEN 321 WHEN 4 THEN 324 WHEN 5 THEN 312 WHEN 6 THEN 311 WHEN 7 THEN 333 WHEN 8 THEN 231 WHEN 9 THEN 112 WHEN 10 THEN 512 WHEN 11 THEN 999 ELSE 412 END AS INT) AS code
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS rn FROM lineitem) x""",
    "observations": """
SELECT CAST(user_id % (SELECT count(*) FROM supplier) AS STRING) AS fire_id, 'scene-' || CAST(event_id AS STRING) AS scene_id, ts AS scene_ts, CAST(event_id % 100 AS DOUBLE) AS cloud_pct,
       CAST(event_id % 3 AS INT) AS row, CAST(event_id {DIV} 3 % 4 AS INT) AS col, CAST(event_id % 12 AS INT) AS scl,
       CAST(CASE WHEN event_id % 50 = 4 THEN 0 ELSE 1000 + CAST(floor(value * 13) AS BIGINT) % 4000 END AS INT) AS b8a, CAST(CASE WHEN event_id % 50 = 4 THEN 0 ELSE 800 + CAST(floor(value * 29) AS BIGINT) % 3000 END AS INT) AS b12
FROM events""",
    "packs": """
SELECT b.id AS fire_id, b.w, b.s, b.e, b.n, CAST(f.index_pos % 90 + 5 AS INT) AS tile_count, CAST(CASE WHEN f.index_pos % 10 = 4 THEN 2 ELSE 0 END AS INT) AS failed,
       CASE WHEN f.index_pos % 8 = 6 THEN NULL ELSE CAST(f.index_pos AS BIGINT) * 19456 END AS bytes, CAST(CASE WHEN f.index_pos % 6 = 2 THEN 3 ELSE 4 END AS INT) AS version,
       CASE WHEN f.index_pos % 14 = 0 THEN 'osm' ELSE 'topo' END AS basemap
FROM bounds b JOIN fire_base f ON f.id = b.id WHERE f.index_pos % 2 = 0""",
    "admins": "SELECT 'user-' || CAST(c_custkey AS STRING) AS uid FROM customer WHERE c_custkey % 20 = 1",
    "changes": """
SELECT uuid, 'user-' || CAST(o_custkey + o_orderkey % 3 - 1 AS STRING) AS editor_uid, CASE WHEN o_orderkey % 5 = 0 THEN 'user-0' ELSE user_id END AS new_user_id,
       CASE WHEN o_orderkey % 10 = 9 THEN 'delete' ELSE 'update' END AS op, created_at AS ts
FROM measurements JOIN orders ON uuid = 'measurement-' || CAST(o_orderkey AS STRING) WHERE o_orderkey % 2 = 0""",
    "decisions": """
SELECT uuid, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'verified' END AS decision, CASE WHEN o_orderkey % 4 = 0 THEN 'user-2' ELSE 'user-' || CAST(20 * (o_orderkey % 5) + 1 AS STRING) END AS reviewer,
       created_at + INTERVAL '1' HOUR * CAST(o_orderkey % 7 AS INT) AS ts
FROM measurements JOIN orders ON uuid = 'measurement-' || CAST(o_orderkey AS STRING) WHERE o_orderkey % 3 <> 1""",
    "remote": """
SELECT uuid, fire_id, lat + 1e-3 AS lat, lon, CASE WHEN o_orderkey % 2 = 0 THEN 'verified' ELSE 'rejected' END AS status, 'remote ' || uuid AS comment, created_at
FROM measurements JOIN orders ON uuid = 'measurement-' || CAST(o_orderkey AS STRING) WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'remote-' || CAST(o_orderkey AS STRING), NULL, 54e0, -2e0, 'verified', 'new', o_orderdate FROM orders WHERE o_orderkey % 50 = 1""",
    "local_points": """
SELECT uuid, fire_id, lat, lon, CASE WHEN photo_pending THEN 'pending' ELSE 'synced' END AS status, comment, created_at, photo_pending FROM measurements""",
    "photos": """
SELECT 'photos/' || coalesce(fire_id, 'unassigned') || '/' || name AS path, name, size_bytes, content_type, uploaded_by FROM (
  SELECT f.id AS fire_id, CASE WHEN o_orderkey % 12 = 5 THEN 'a_' ELSE 'a-' END || CAST(o_orderkey % 4000 AS STRING) || CASE WHEN o_orderkey % 15 = 2 THEN '.png' ELSE '.jpg' END AS name,
         CASE WHEN o_orderkey % 9 = 1 THEN CAST(3145728 AS BIGINT) ELSE CAST(o_orderkey * 811 % 3145728 AS BIGINT) END AS size_bytes,
         CASE WHEN o_orderkey % 20 = 3 THEN 'application/pdf' ELSE 'image/jpeg' END AS content_type, CASE WHEN o_orderkey % 18 = 7 THEN NULL ELSE 'user-' || CAST(o_custkey AS STRING) END AS uploaded_by
  FROM (SELECT *, o_orderkey % nf AS home FROM orders CROSS JOIN (SELECT count(*) AS nf FROM supplier) s) o JOIN fire_base f ON f.index_pos = home) x""",
    "stored_photos": "SELECT DISTINCT path FROM photos WHERE size_bytes % 10 = 0",
    "gps_fixes": """
SELECT CAST(user_id AS STRING) AS device, event_id AS seq, ts, 54e0 + sum(CASE WHEN event_id % 3 = 0 THEN 7 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e5 AS lat,
       -2e0 + sum(CASE WHEN event_id % 4 = 0 THEN 9 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e5 AS lon, value / 10 AS accuracy_m
FROM events""",
    "nav_targets": """
SELECT CAST(c_custkey AS STRING) AS device, 'node-' || CAST(c_custkey AS STRING) AS node_id, 54e0 + (c_custkey % 40) / 1e4 AS lat, -2e0 + (c_custkey % 30) / 1e4 AS lon FROM customer
UNION ALL SELECT device, 'last-' || device, lat + 2e-5, lon - 1e-5 FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq DESC) AS back FROM gps_fixes) g WHERE back % 7 = 1""",
    "comments": """
SELECT doc_id, 54e0 + (doc_id % 100) / 1e3 AS lat, -2e0 - (doc_id % 90) / 1e3 AS lon, coalesce(text, '') || CASE doc_id % 6
         WHEN 0 THEN ' moved to 54.' || CAST(100 + doc_id % 800 AS STRING) || ', -2.' || CAST(100 + doc_id % 700 AS STRING) || ' by eye'
         WHEN 1 THEN ' at 53°' || CAST(doc_id % 50 + 10 AS STRING) || chr(39) || '43.3"N 1°' || CAST(doc_id % 40 + 10 AS STRING) || chr(39) || '19.1"W ok'
         WHEN 2 THEN ' 54.12, -2.34 too short' WHEN 3 THEN ' 12.12345, 77.54321 is far away'
         WHEN 4 THEN ' 157.12345 and 54.' || CAST(1000 + doc_id % 900 AS STRING) || ' -2.' || CAST(1000 + doc_id % 90 AS STRING) ELSE '' END AS comment
FROM documents""",
    "stored_tiles": """
SELECT layer, z, x, y, fire_id, bytes FROM (
  SELECT 'base' AS layer, 12 AS z, CAST(2000 + index_pos % 20 + i AS BIGINT) AS x, CAST(1300 + index_pos % 15 + j AS BIGINT) AS y, id AS fire_id, CAST(1000 + index_pos * i AS BIGINT) AS bytes
  FROM fire_base CROSS JOIN (VALUES (0), (1), (2)) AS a(i) CROSS JOIN (VALUES (0), (1)) AS b(j)) t""",
    "tile_pixels": """
SELECT CAST(8 AS INT) AS z, CAST(l_orderkey % 200 AS BIGINT) AS x, CAST(l_suppkey % 3 AS BIGINT) AS y, CAST(l_linenumber AS INT) AS px, CAST(l_partkey % 64 AS INT) AS py,
       CASE WHEN l_orderkey % 200 % 3 = 0 THEN 0 ELSE CAST(l_partkey % 256 AS INT) END AS alpha, CAST(300 + l_orderkey % 200 * 4 AS BIGINT) AS bytes
FROM lineitem""",
    # footprints that know no fire
    "scenes": """
SELECT 'scene-' || CAST(event_id AS STRING) AS scene_id, ts AS scene_ts, -62e-1 + (event_id * 31 % 72) / 1e1 AS w, 504e-1 + (event_id * 17 % 82) / 1e1 AS s, -53e-1 + (event_id * 31 % 72) / 1e1 AS e, 511e-1 + (event_id * 17 % 82) / 1e1 AS n FROM events""",
    # views one after another, as a map is moved
    "sessions": """
SELECT c_custkey % 20 AS session, c_custkey AS seq, CAST(8 + c_custkey % 9 AS INT) AS zoom, -6e0 + (c_custkey {DIV} 20 * 7 % 70) / 1e1 AS w, 505e-1 + (c_custkey {DIV} 20 * 3 % 70) / 1e1 AS s, -48e-1 + (c_custkey {DIV} 20 * 7 % 70) / 1e1 AS e, 515e-1 + (c_custkey {DIV} 20 * 3 % 70) / 1e1 AS n
FROM customer""",
    # three land-cover files with origins of their own that lie over one another in part
    "cover_files": """
SELECT CAST(k AS INT) AS file_order, 100e0 * (k * 5 - 3) AS x0, 9000e0 - 50e0 * (k * 7 % 11) AS y0, 100e0 AS px, -50e0 AS py, CASE WHEN k = 2 THEN 999 ELSE -1 END AS nodata FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3) x""",
    "cover_cells": """
SELECT CAST(CAST(fire_id AS INT) % 3 AS INT) AS file_order, row + 32 * (CAST(fire_id AS INT) {DIV} 3 % 6) AS row, col + 24 * (CAST(fire_id AS INT) {DIV} 18 % 6) AS col, max(code) AS code FROM pixels GROUP BY 1, 2, 3""",
    "viewports": "SELECT n_nationkey AS view_id, -6e0 + (n_nationkey * 29 % 60) / 1e1 AS w, 51e0 + (n_nationkey * 31 % 70) / 1e1 AS s, -5e0 + (n_nationkey * 29 % 60) / 1e1 AS e, 52e0 + (n_nationkey * 31 % 70) / 1e1 AS n FROM nation",
}


def needed(sql: str) -> list[str]:
    """Derived tables that a query reads, in an order in which they can be made."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in out and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(TABLES[name])
                out.append(name)

    visit(sql)
    return out


def _dialect(sql: str, kind: str) -> str:
    for k, v in DIALECT[kind].items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def oracle(sql: str) -> str:
    """A DuckDB query over given and derived tables, with the derived ones in front."""
    names = needed(sql)
    made = ",\n".join(f"{n} AS ({_dialect(TABLES[n], 'duckdb')})" for n in names)
    sql = sql.strip()
    if not names:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {made},\n{sql[len('WITH RECURSIVE'):]}"
    return f"WITH {made},\n{sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {made}\n{sql}"


class Tables:
    """Derived tables of one directory as DataFrames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if made := self.spark.conf.get(f"emberfield.written.{name}", None):
            return self.spark.read.parquet(made)
        if name == "fires":
            return self.fires()
        sql = _dialect(TABLES[name], "spark")
        # inner tables become subqueries, given ones named parameters: no view is left behind
        inner = {n: self[n] for n in [*TABLES, *GIVEN] if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}
        if name == "grid":
            # a row gives very many, so few small files are no few tasks
            inner["fire_base"] = inner["fire_base"].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "index_pos")
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}} AS {m[2]}" if m[2] in inner and not re.match(r"\s+(?:AS\s+)?(?!ON|WHERE|GROUP|JOIN|CROSS|UNION|LEFT|ORDER|INNER)[a-z]\w*", sql[m.end():m.end() + 8]) else f"{m[1]} {{{m[2]}}}" if m[2] in inner else m[0], sql), **inner)

    def write(self, name: str, path: str) -> None:
        """Writes a derived table; this session reads it from there."""
        self[name].write.mode("overwrite").parquet(path)
        self.spark.conf.set(f"emberfield.written.{name}", path)

    def fires(self) -> DataFrame:
        """Fires with nested geometry: polygons, their rings, closed lists of vertices."""
        at = lambda c, k: F.col(c) + k[0] * F.col("half") * (F.col("waist") if k[1] else F.lit(1.0))
        vertices = ((-1, -1, 0), (0, -1, 1), (1, -1, 0), (1, 0, 1), (1, 1, 0), (0, 1, 1), (-1, 1, 0), (-1, 0, 1), (-1, -1, 0))
        ring = F.array(*[F.struct(at("cx", (x, m)).alias("lon"), at("cy", (y, m)).alias("lat")) for x, y, m in vertices])
        rings = self["rings"].select("fire_id", "poly", "ring", ring.alias("points"))
        polys = rings.groupBy("fire_id", "poly").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "points"))), lambda x: x["points"]).alias("rings"))
        geom = polys.groupBy("fire_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("poly", "rings"))), lambda x: x["rings"]).alias("geom"))
        base = self["fire_base"].select("index_pos", "id", "commune", "province", "country", "class", "firedate", "finaldate", "area_ha")
        return base.join(geom, base["id"] == geom["fire_id"]).drop("fire_id")
