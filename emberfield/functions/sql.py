"""The library's functions under SQL names, for sessions that write plain SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Metres of a degree of latitude on the plane, and the sphere's radius, as in geo.
_PLANE, _SPHERE = "111320D", "6371000D"

SCALARS = {
    "tile_x(lon DOUBLE, z INT) RETURNS BIGINT": "floor((lon + 180D) / 360D * pow(2D, z))",
    "tile_y(lat DOUBLE, z INT) RETURNS BIGINT": "floor((1D - ln(tan(radians(lat)) + 1D / cos(radians(lat))) / pi()) / 2D * pow(2D, z))",
    "tile_lon(x BIGINT, z INT) RETURNS DOUBLE": "x / pow(2D, z) * 360D - 180D",
    "tile_lat(y BIGINT, z INT) RETURNS DOUBLE": "degrees(atan(sinh(pi() * (1D - 2D * y / pow(2D, z)))))",
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"2D * {_SPHERE} * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2D), 2D) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2D), 2D))))",
    "local_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"sqrt(pow((lon2 - lon1) * {_PLANE} * cos(radians(lat1)), 2D) + pow((lat2 - lat1) * {_PLANE}, 2D))",
    "severity_class(dnbr DOUBLE) RETURNS INT": "CASE WHEN dnbr < -100 THEN 0 WHEN dnbr < 100 THEN 1 WHEN dnbr < 270 THEN 2 WHEN dnbr < 440 THEN 3 WHEN dnbr < 660 THEN 4 ELSE 5 END",
    "grid_node_id(e DOUBLE, n DOUBLE) RETURNS STRING": "concat('E', CAST(floor(e + 0.5D) AS BIGINT), ' N', CAST(floor(n + 0.5D) AS BIGINT))",
    "in_uk(lat DOUBLE, lon DOUBLE) RETURNS BOOLEAN": "lat > 49D AND lat < 61D AND lon > -9D AND lon < 2.5D",
    "nbr(nir DOUBLE, swir DOUBLE) RETURNS DOUBLE": "(nir - swir) / nullif(nir + swir, 0D)",
}

TABLES = {
    # the tiles of one zoom that a box in degrees touches
    "tiles_of_box(w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, z INT) RETURNS TABLE (x BIGINT, y BIGINT)": "SELECT x, explode(ys) AS y FROM (SELECT explode(xs) AS x, ys FROM (SELECT sequence(tile_x(w, z), tile_x(e, z)) AS xs, sequence(tile_y(n, z), tile_y(s, z)) AS ys))",
    # the middles of the lattice cells in a box in metres of the national grid
    "nodes_of_box(w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, spacing INT) RETURNS TABLE (easting BIGINT, northing BIGINT)": """
SELECT CAST((i + 0.5D) * gap AS BIGINT) AS easting, CAST((j + 0.5D) * gap AS BIGINT) AS northing FROM (SELECT i, explode(js) AS j, gap FROM (SELECT explode(across) AS i, js, gap FROM (
  SELECT sequence(CAST(ceil(w / spacing - 0.5D) AS BIGINT), CAST(floor(e / spacing - 0.5D) AS BIGINT)) AS across, sequence(CAST(ceil(s / spacing - 0.5D) AS BIGINT), CAST(floor(n / spacing - 0.5D) AS BIGINT)) AS js, spacing AS gap)))""",
}


def sql_functions(spark: SparkSession) -> None:
    """Registers SCALARS and TABLES as temporary functions of the session."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
