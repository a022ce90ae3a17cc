"""Labels, numbers and coordinates as text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c, half_up, in_uk

# fixed patterns: a pair of decimal degrees with three decimals at least, and degrees, minutes, seconds
DECIMAL = r"(-?\d{1,2}\.\d{3,})\s*[,;\s]\s*(-?\d{1,2}\.\d{3,})"
DMS = r"(\d{1,2})°\s*(\d{1,2})['′]\s*([\d.]+)[\"″]?\s*([NS])[,;\s]+(\d{1,3})°\s*(\d{1,2})['′]\s*([\d.]+)[\"″]?\s*([EW])"


def place_name(*parts) -> Column:
    """Distinct parts that say something, else a stand-in. Parts are kept as written."""
    told = F.filter(F.array(*map(c, parts)), lambda x: x.isNotNull() & (F.trim(x) != "") & (F.trim(x) != "0"))
    named = F.array_join(F.array_distinct(told), ", ")
    return F.when(named == "", "Unnamed fire").otherwise(named)


def hectares(ha) -> Column:
    return F.when(c(ha) >= 100, F.concat(F.format_number(half_up(ha), 0), F.lit(" ha"))).when(c(ha) > 0, F.concat(F.format_string("%.1f", c(ha)), F.lit(" ha")))


def fixed(x, digits: int) -> Column:
    """A number with so many decimals, halves upward."""
    return F.format_string(f"%.{digits}f", F.floor(c(x) * 10**digits + 0.5) / 10**digits)


def number(x) -> Column:
    """A number as short as it can be: 12, 12.5; null stays null."""
    return F.when(c(x) == F.floor(c(x)), F.floor(c(x)).cast("string")).otherwise(c(x).cast("string"))


def byte_size(n) -> Column:
    """A number of bytes for people: 512 B, 19 kB, 1.6 MB, 2.05 GB; a dash for null."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    whole = F.concat(fixed(c(n) / kb, 0), F.lit(" kB"))
    return F.when(c(n).isNull(), "-").when(c(n) < kb, F.concat(c(n).cast("string"), F.lit(" B"))).when(c(n) < mb, whole).when(c(n) < gb, F.concat(fixed(c(n) / mb, 1), F.lit(" MB"))).otherwise(F.concat(fixed(c(n) / gb, 2), F.lit(" GB")))


def distance(m) -> Column:
    """A number of metres for people: 870 m, 1.3 km, 24 km."""
    km = c(m) / 1000
    return F.when(c(m) < 1000, F.concat(fixed(m, 0), F.lit(" m"))).when(c(m) < 10000, F.concat(fixed(km, 1), F.lit(" km"))).otherwise(F.concat(fixed(km, 0), F.lit(" km")))


def subtitle(firedate, ha, country) -> Column:
    return F.concat_ws(" · ", F.date_format(c(firedate), "yyyy-MM-dd"), hectares(ha), c(country))


def node_id(e, n) -> Column:
    return F.concat(F.lit("E"), c(e).cast("string"), F.lit(" N"), c(n).cast("string"))


def coordinates(text, bounded: bool = True) -> Column:
    """struct(lat, lon, kind) of coordinates written in a text and inside the UK, else null; degrees with minutes win.

    bounded: a decimal pair must not follow on a digit, so 157.12345 holds no 57.12345.
    """
    pattern = (r"(?<!\d)" if bounded else "") + DECIMAL

    def spot(t: Column) -> Column:
        g = lambda k: F.regexp_extract(t, DMS, k)
        deg = lambda a, b, s: g(a).try_cast("double") + g(b).try_cast("double") / 60 + g(s).try_cast("double") / 3600
        part = lambda a, b, s, side, minus: F.round(deg(a, b, s) * F.when(g(side) == minus, -1).otherwise(1), 6)
        dec = lambda k: F.regexp_extract(t, pattern, k).try_cast("double")
        dms = F.struct(part(1, 2, 3, 4, "S").alias("lat"), part(5, 6, 7, 8, "W").alias("lon"), F.lit("dms").alias("kind"))
        decimal = F.struct(dec(1).alias("lat"), dec(2).alias("lon"), F.lit("decimal").alias("kind"))
        return F.when(g(0) != "", dms).when(F.regexp_extract(t, pattern, 0) != "", decimal)

    # a text, and what is found in it, are elements of arrays, so that neither is worked out again wherever it is named
    found = F.transform(F.array(c(text)), spot)
    return F.get(F.filter(found, lambda p: in_uk(p["lat"], p["lon"])), F.lit(0))
