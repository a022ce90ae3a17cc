"""Geometry and grid arithmetic as Columns. Every argument is a Column or a column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
METRES_PER_DEGREE = 111320.0
KM_PER_DEGREE = 111.32
EARTH_M = 6371000.0
MERCATOR_M = 6378137.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
UK = {"lat": (49.0, 61.0), "lon": (-9.0, 2.5)}
SEVERITY_BOUNDS = (-100, 100, 270, 440, 660)
PI = 3.141592653589793


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x) -> Column:
    """Round to a whole number, halves upward also below zero."""
    return F.floor(c(x) + 0.5)


def tile_x(lon, z) -> Column:
    return F.floor((c(lon) + 180.0) / 360.0 * F.pow(F.lit(2.0), c(z)))


def tile_y(lat, z) -> Column:
    phi = F.radians(c(lat))
    return F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / PI) / 2.0 * F.pow(F.lit(2.0), c(z)))


def clamp_tile(t, z) -> Column:
    last = F.lit((1 << z) - 1).cast("bigint") if isinstance(z, int) else F.pow(F.lit(2.0), c(z)).cast("bigint") - 1
    return F.greatest(F.lit(0), F.least(c(t), last))


def tile_lon(x, z) -> Column:
    return c(x) / F.pow(F.lit(2.0), c(z)) * 360.0 - 180.0


def tile_lat(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(PI * (1.0 - 2.0 * c(y) / F.pow(F.lit(2.0), c(z))))))


def mercator_x(lon) -> Column:
    return F.radians(c(lon)) * MERCATOR_M


def mercator_y(lat) -> Column:
    return F.log(F.tan(PI / 4.0 + F.radians(c(lat)) / 2.0)) * MERCATOR_M


def inverse_mercator_lon(x) -> Column:
    return F.degrees(c(x) / MERCATOR_M)


def inverse_mercator_lat(y) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(c(y) / MERCATOR_M)) - PI / 2.0)


def east_m(lat, lon0, lon1) -> Column:
    return (c(lon1) - c(lon0)) * (METRES_PER_DEGREE * F.cos(F.radians(c(lat))))


def north_m(lat0, lat1) -> Column:
    return (c(lat1) - c(lat0)) * METRES_PER_DEGREE


def local_m(lat0, lon0, lat1, lon1) -> Column:
    """Equirectangular distance, with the first point's latitude."""
    return F.sqrt(F.pow(east_m(lat0, lon0, lon1), F.lit(2.0)) + F.pow(north_m(lat0, lat1), F.lit(2.0)))


def bearing(lat0, lon0, lat1, lon1) -> Column:
    """Degrees from north, 0 to 360, not rounded."""
    turned = F.degrees(F.atan2(east_m(lat0, lon0, lon1), north_m(lat0, lat1))) + 360.0
    return turned - 360.0 * F.floor(turned / 360.0)


def compass(degrees) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (half_up(c(degrees) / 45.0) % 8 + 1).cast("int"))


def haversine_m(lat0, lon0, lat1, lon1) -> Column:
    a = F.pow(F.sin(F.radians(c(lat1) - c(lat0)) / 2), F.lit(2.0)) + F.cos(F.radians(c(lat0))) * F.cos(F.radians(c(lat1))) * F.pow(F.sin(F.radians(c(lon1) - c(lon0)) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_uk(lat="lat", lon="lon") -> Column:
    return (c(lat) > UK["lat"][0]) & (c(lat) < UK["lat"][1]) & (c(lon) > UK["lon"][0]) & (c(lon) < UK["lon"][1])


def buffered(w, s, e, n, km) -> Column:
    """struct(w, s, e, n) of a box grown by km, within the world."""
    mid = F.greatest(F.lit(0.2), F.cos(F.radians((c(s) + c(n)) / 2.0)))
    dlat, dlon = km / KM_PER_DEGREE, km / (KM_PER_DEGREE * mid)
    return F.struct(F.greatest(F.lit(-180.0), c(w) - dlon).alias("w"), F.greatest(F.lit(-85.0), c(s) - dlat).alias("s"), F.least(F.lit(180.0), c(e) + dlon).alias("e"), F.least(F.lit(85.0), c(n) + dlat).alias("n"))


def area_km2(w, s, e, n) -> Column:
    return (c(e) - c(w)) * (c(n) - c(s)) * (KM_PER_DEGREE * KM_PER_DEGREE) * F.cos(F.radians((c(s) + c(n)) / 2.0))


def severity(dnbr, split_regrowth: bool = False) -> Column:
    """Class number by half-open bounds on scaled dNBR: 6 classes, or 7 with strong regrowth first."""
    bounds = ((-250,) if split_regrowth else ()) + SEVERITY_BOUNDS
    out = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        out = F.when(c(dnbr) < bounds[k], k).otherwise(out)
    return out


def crosses(lon, lat) -> Column:
    """Whether an edge (ax, ay, bx, by) crosses the ray from a point to the east: even-odd rule."""
    ax, ay, bx, by = map(F.col, ("ax", "ay", "bx", "by"))
    return ((by > c(lat)) != (ay > c(lat))) & (c(lon) < (ax - bx) * (c(lat) - by) / (ay - by) + bx)


def edge_m(lat, lon) -> Column:
    """Local metres from a point to the edge (ax, ay, bx, by); an edge without length is a point."""
    ml, mo = F.lit(METRES_PER_DEGREE), METRES_PER_DEGREE * F.cos(F.radians(c(lat)))
    px, py, ax, ay, bx, by = c(lon) * mo, c(lat) * ml, F.col("ax") * mo, F.col("ay") * ml, F.col("bx") * mo, F.col("by") * ml
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * dx), F.lit(2.0)) + F.pow(py - (ay + t * dy), F.lit(2.0)))


# British National Grid: Airy 1830, transverse Mercator, and the seven-parameter shift from WGS84 (fixed values).
AIRY_A, AIRY_B, SCALE, LAT0, LON0, N0, E0 = 6377563.396, 6356256.909, 0.9996012717, 49.0, -2.0, -100000.0, 400000.0
WGS_A, WGS_B = 6378137.0, 6356752.314245
SHIFT = (-446.448, 125.157, -542.060, 20.4894e-6, -0.1502, -0.2470, -0.8421)


def let(f, *values) -> Column:
    """f of values that are computed once, however often f uses them: an expression would else grow with every use."""
    bound = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.transform(F.array(bound), lambda s: f(*[s[f"v{k}"] for k in range(len(values))]))[0]


def _shift(lat: Column, lon: Column, a0: float, b0: float, a1: float, b1: float, sign: int) -> Column:
    """struct(lat, lon), in radians, on another ellipsoid."""
    tx, ty, tz, s, rx, ry, rz = (sign * x for x in SHIFT)
    rx, ry, rz = (x / 3600 * PI / 180 for x in (rx, ry, rz))
    e0, e1 = 1 - (b0 / a0) ** 2, 1 - (b1 / a1) ** 2
    ep = (a1 / b1) ** 2 - 1

    def space(lat, lon):
        nu = a0 / F.sqrt(1 - e0 * F.sin(lat) * F.sin(lat))
        return let(moved, nu * F.cos(lat) * F.cos(lon), nu * F.cos(lat) * F.sin(lon), nu * (1 - e0) * F.sin(lat))

    def moved(x, y, z):
        return let(ground, tx + (1 + s) * x - rz * y + ry * z, ty + rz * x + (1 + s) * y - rx * z, tz - ry * x + rx * y + (1 + s) * z)

    def ground(x, y, z):
        p = F.sqrt(x * x + y * y)
        # Bowring's closed form, exact to a micrometre on the ground
        return let(lambda p, t: F.struct(F.atan2(z + ep * b1 * F.pow(F.sin(t), F.lit(3.0)), p - e1 * a1 * F.pow(F.cos(t), F.lit(3.0))).alias("lat"), F.atan2(y, x).alias("lon")), p, F.atan2(z * a1, p * b1))

    return let(space, lat, lon)


def _arc(lat: Column) -> Column:
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    d, s = lat - LAT0 * PI / 180, lat + LAT0 * PI / 180
    return AIRY_B * SCALE * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s) + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s))


def _radii(lat: Column) -> tuple[Column, Column]:
    e2 = 1 - (AIRY_B / AIRY_A) ** 2
    w = 1 - e2 * F.sin(lat) * F.sin(lat)
    return AIRY_A * SCALE / F.sqrt(w), AIRY_A * SCALE * (1 - e2) / (w * F.sqrt(w))


def to_grid(lat, lon) -> Column:
    """struct(e, n) in metres on the British National Grid of a WGS84 position."""

    def project(phi, d, nu, rho, t2):
        eta, s, co, d2 = nu / rho - 1, F.sin(phi), F.cos(phi), d * d
        north = _arc(phi) + N0 + d2 * nu * s * co * (0.5 + d2 * co * co * ((5 - t2 + 9 * eta) / 24 + d2 * co * co * (61 - 58 * t2 + t2 * t2) / 720))
        east = E0 + d * nu * co * (1 + d2 * co * co * ((nu / rho - t2) / 6 + d2 * co * co * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) / 120))
        return F.struct(east.alias("e"), north.alias("n"))

    shifted = _shift(F.radians(c(lat)), F.radians(c(lon)), WGS_A, WGS_B, AIRY_A, AIRY_B, 1)
    return let(lambda g: let(project, g["lat"], g["lon"] - LON0 * PI / 180, *_radii(g["lat"]), F.pow(F.tan(g["lat"]), F.lit(2.0))), shifted)


def from_grid(e, n) -> Column:
    """struct(lat, lon) in WGS84 of a British National Grid position."""
    e, n = c(e).cast("double"), c(n).cast("double")
    phi = LAT0 * PI / 180 + (n - N0) / (AIRY_A * SCALE)
    for _ in range(4):  # Newton on the meridian arc; the residue is below a tenth of a millimetre
        phi = let(lambda phi, n: phi + (n - N0 - _arc(phi)) / (AIRY_A * SCALE), phi, n)

    def unproject(phi, d, nu, rho, t):
        eta, t2, co, d2 = nu / rho - 1, t * t, F.cos(phi), d * d / (nu * nu)
        lat = phi - d2 * t * nu / rho * (0.5 - d2 * ((5 + 3 * t2 + eta - 9 * t2 * eta) / 24 - d2 * (61 + 90 * t2 + 45 * t2 * t2) / 720))
        lon = LON0 * PI / 180 + d / nu / co * (1 - d2 * ((nu / rho + 2 * t2) / 6 - d2 * (5 + 28 * t2 + 24 * t2 * t2) / 120))
        back = _shift(lat, lon, AIRY_A, AIRY_B, WGS_A, WGS_B, -1)
        return let(lambda g: F.struct(F.degrees(g["lat"]).alias("lat"), F.degrees(g["lon"]).alias("lon")), back)

    return let(lambda phi, d: let(unproject, phi, d, *_radii(phi), F.tan(phi)), phi, e - E0)


# The same projections step by step over a table. Spark compiles these; `let` above is interpreted, which matters for many rows.


def _steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    for step in steps:
        df = df.select(*[c for c in df.columns if c not in step], *[v.alias(k) for k, v in step.items()])
    return df


def _closed(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; filters on these columns stay behind their steps, as one that is pushed before them repeats each step for every use."""
    out = F.inline(F.array(F.struct(*columns)))
    return df.select(*[c for c in df.columns if c not in columns], out.alias(*columns))


def _shift_steps(lat: str, lon: str, a0: float, b0: float, a1: float, b1: float, sign: int) -> list[dict[str, Column]]:
    """Steps that replace the radians in two columns by those on another ellipsoid."""
    tx, ty, tz, s, rx, ry, rz = (sign * x for x in SHIFT)
    rx, ry, rz = (x / 3600 * PI / 180 for x in (rx, ry, rz))
    e0, e1 = 1 - (b0 / a0) ** 2, 1 - (b1 / a1) ** 2
    ep = (a1 / b1) ** 2 - 1
    x, y, z, p, t, nu = map(F.col, ("_x", "_y", "_z", "_p", "_t", "_nu"))
    return [
        {"_nu": a0 / F.sqrt(1 - e0 * F.sin(lat) * F.sin(lat))},
        {"_x": nu * F.cos(lat) * F.cos(lon), "_y": nu * F.cos(lat) * F.sin(lon), "_z": nu * (1 - e0) * F.sin(lat)},
        {"_x": tx + (1 + s) * x - rz * y + ry * z, "_y": ty + rz * x + (1 + s) * y - rx * z, "_z": tz - ry * x + rx * y + (1 + s) * z},
        {"_p": F.sqrt(x * x + y * y)},
        {"_t": F.atan2(z * a1, p * b1)},
        {lat: F.atan2(z + ep * b1 * F.pow(F.sin(t), F.lit(3.0)), p - e1 * a1 * F.pow(F.cos(t), F.lit(3.0))), lon: F.atan2(y, x)},
    ]


def with_grid(df: DataFrame, lat: str, lon: str, e: str, n: str) -> DataFrame:
    """Adds the columns e and n, as to_grid() has them."""
    phi, d, nu, rho, t2, eta, s, co, d2 = map(F.col, ("_lat", "_d", "_nu", "_rho", "_t2", "_eta", "_s", "_co", "_d2"))
    r = _radii(phi)
    north = F.col("_arc") + N0 + d2 * nu * s * co * (0.5 + d2 * co * co * ((5 - t2 + 9 * eta) / 24 + d2 * co * co * (61 - 58 * t2 + t2 * t2) / 720))
    east = E0 + d * nu * co * (1 + d2 * co * co * ((nu / rho - t2) / 6 + d2 * co * co * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) / 120))
    out = _steps(
        df.select("*", F.radians(lat).alias("_lat"), F.radians(lon).alias("_lon")),
        *_shift_steps("_lat", "_lon", WGS_A, WGS_B, AIRY_A, AIRY_B, 1),
        {"_d": F.col("_lon") - LON0 * PI / 180, "_nu": r[0], "_rho": r[1], "_t2": F.pow(F.tan(phi), F.lit(2.0)), "_arc": _arc(phi), "_s": F.sin(phi), "_co": F.cos(phi)},
        {"_eta": nu / rho - 1, "_d2": d * d},
        {e: east, n: north},
    )
    return _closed(out.select(*[c for c in df.columns if c not in (e, n)], e, n), e, n)


def with_degrees(df: DataFrame, e: str, n: str, lat: str, lon: str) -> DataFrame:
    """Adds the columns lat and lon, as from_grid() has them."""
    phi, d, nu, rho, t, eta, t2, co, d2 = map(F.col, ("_lat", "_d", "_nu", "_rho", "_t", "_eta", "_t2", "_co", "_d2"))
    north = F.col(n).cast("double")
    r = _radii(phi)
    out = _steps(
        df.select("*", (F.col(e).cast("double") - E0).alias("_d"), (LAT0 * PI / 180 + (north - N0) / (AIRY_A * SCALE)).alias("_lat")),
        *[{"_lat": phi + (north - N0 - _arc(phi)) / (AIRY_A * SCALE)} for _ in range(4)],
        {"_nu": r[0], "_rho": r[1], "_t": F.tan(phi), "_co": F.cos(phi), "_lat": phi},
        {"_eta": nu / rho - 1, "_t2": t * t, "_d2": d * d / (nu * nu)},
        {
            "_lat": phi - d2 * t * nu / rho * (0.5 - d2 * ((5 + 3 * t2 + eta - 9 * t2 * eta) / 24 - d2 * (61 + 90 * t2 + 45 * t2 * t2) / 720)),
            "_lon": LON0 * PI / 180 + d / nu / co * (1 - d2 * ((nu / rho + 2 * t2) / 6 - d2 * (5 + 28 * t2 + 24 * t2 * t2) / 120)),
        },
        *_shift_steps("_lat", "_lon", AIRY_A, AIRY_B, WGS_A, WGS_B, -1),
        {lat: F.degrees("_lat"), lon: F.degrees("_lon")},
    )
    return _closed(out.select(*[c for c in df.columns if c not in (lat, lon)], lat, lon), lat, lon)
