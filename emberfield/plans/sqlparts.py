"""Pieces of DuckDB SQL that several checks use."""

IN_UK = "(lat > 49 AND lat < 61 AND lon > -9 AND lon < 2.5)"
GIVEN = "list_filter(depths, lambda d: d IS NOT NULL)"
COUNT = f"len({GIVEN})"
MEAN = f"(list_sum({GIVEN}) / nullif(len({GIVEN}), 0))"


def tile_x(lon: str, z: str) -> str:
    return f"CAST(floor(({lon} + 180.0::DOUBLE) / 360.0::DOUBLE * pow(2.0::DOUBLE, {z})) AS BIGINT)"


def tile_y(lat: str, z: str) -> str:
    return f"CAST(floor((1.0::DOUBLE - ln(tan(radians({lat})) + 1.0::DOUBLE / cos(radians({lat}))) / pi()) / 2.0::DOUBLE * pow(2.0::DOUBLE, {z})) AS BIGINT)"


#: Points inside a fire by parity, and their distance to its nearest edge: every pair of a point and an edge.
_CROSS = "((e.by > m.lat) <> (e.ay > m.lat) AND m.lon < (e.ax - e.bx) * (m.lat - e.by) / (e.ay - e.by) + e.bx)"
_DX, _DY = "((e.bx - e.ax) * mo)", "((e.by - e.ay) * 111320)"
_T = f"CASE WHEN {_DX} ** 2 + {_DY} ** 2 > 0 THEN greatest(0, least(1, ((m.lon - e.ax) * mo * {_DX} + (m.lat - e.ay) * 111320 * {_DY}) / ({_DX} ** 2 + {_DY} ** 2))) ELSE 0 END"
_DIST = f"sqrt((m.lon * mo - (e.ax * mo + ({_T}) * {_DX})) ** 2 + (m.lat * 111320 - (e.ay * 111320 + ({_T}) * {_DY})) ** 2)"
MEASURED = f"""SELECT uuid, fire_id, max(CASE WHEN odd - hole = 1 THEN 1 ELSE 0 END) AS inside, min(d) AS d FROM (
  SELECT uuid, fire_id, poly, max(CASE WHEN ring = 0 THEN odd END) AS odd, coalesce(max(CASE WHEN ring > 0 THEN odd END), 0) AS hole, min(d) AS d FROM (
    SELECT m.uuid, e.fire_id, e.poly, e.ring, count(*) FILTER ({_CROSS}) % 2 AS odd, min({_DIST}) AS d
    FROM (SELECT uuid, lat, lon, 111320 * cos(radians(lat)) AS mo FROM measurements {{where}}) m JOIN bounds b ON m.lat BETWEEN b.s - 0.01 AND b.n + 0.01 AND m.lon BETWEEN b.w - 0.01 AND b.e + 0.01 JOIN edges e ON e.fire_id = b.id GROUP BY ALL) r GROUP BY ALL) p GROUP BY ALL"""
ATTACH = f"""SELECT uuid, near_fire, dist_m FROM (
  SELECT x.uuid, x.fire_id AS near_fire, CASE WHEN inside = 1 THEN 0 ELSE d END AS dist_m, row_number() OVER (PARTITION BY x.uuid ORDER BY 1 - inside, CASE WHEN inside = 1 THEN 0 ELSE d END, f.index_pos) AS rn
  FROM ({MEASURED}) x JOIN fire_base f ON f.id = x.fire_id WHERE inside = 1 OR d <= 100) y WHERE rn = 1"""

# fixed values: bounds of severity classes, and the land-cover codes of each group
SEVERITY = "CASE WHEN dnbr < -100 THEN 0 WHEN dnbr < 100 THEN 1 WHEN dnbr < 270 THEN 2 WHEN dnbr < 440 THEN 3 WHEN dnbr < 660 THEN 4 ELSE 5 END"
GROUP = """CASE WHEN code = 412 THEN 'Peat bogs' WHEN code = 411 THEN 'Inland marshes' WHEN code = 322 THEN 'Moors & heathland' WHEN code = 321 THEN 'Natural grassland' WHEN code = 324 THEN 'Transitional scrub'
WHEN code = 312 THEN 'Coniferous forest' WHEN code IN (311, 313) THEN 'Broadleaved forest' WHEN code IN (331, 332, 333, 334, 335) THEN 'Sparsely vegetated' WHEN code IN (211, 212, 213, 221, 222, 223, 231, 241, 242, 243, 244) THEN 'Pasture & arable'
WHEN code IN (111, 112, 121, 122, 123, 124, 131, 132, 133, 141, 142) THEN 'Built-up' WHEN code IN (421, 422, 423, 511, 512, 521, 522, 523) THEN 'Water & coastal' ELSE 'Other' END"""
VALID = "dnbr IS NOT NULL AND dnbr <> -32768"


def inverse_lat(y: str) -> str:
    return f"degrees(2 * atan(exp(({y}) / 6378137.0::DOUBLE)) - pi() / 2)"


# fixed values: names of the severity classes
NAMES = ("regrowth", "unburned", "low", "moderate_low", "moderate_high", "high")
_HA = f"(SELECT fire_id, abs(px * cos(radians(c)) * py * cos(radians(c))) / 10000 AS ha FROM (SELECT *, {inverse_lat('y0 + height / 2 * py')} AS c FROM raster) z)"
CROSSTAB = f"""SELECT *, round(sum(row_ha) OVER (PARTITION BY fire_id), 2) AS total_ha FROM (
  SELECT *, round({' + '.join(NAMES)}, 2) AS row_ha FROM (
    SELECT fire_id, landcover, {', '.join(f'round(n{k} * ha, 2) AS {s}' for k, s in enumerate(NAMES))} FROM (
      SELECT fire_id, {GROUP} AS landcover, {', '.join(f'count(*) FILTER (({SEVERITY}) = {k}) AS n{k}' for k in range(6))} FROM pixels WHERE {VALID} GROUP BY 1, 2) g JOIN {_HA} h USING (fire_id)) c) t
WHERE {' + '.join(NAMES)} > 0.005"""
