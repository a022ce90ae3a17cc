"""Pixel tables: burn severity, land cover, their cross-tabulation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import edges

SEVERITIES = ("regrowth", "unburned", "low", "moderate_low", "moderate_high", "high")

# fixed values: land-cover codes of each group
GROUPS = {
    "Peat bogs": (412,),
    "Inland marshes": (411,),
    "Moors & heathland": (322,),
    "Natural grassland": (321,),
    "Transitional scrub": (324,),
    "Coniferous forest": (312,),
    "Broadleaved forest": (311, 313),
    "Sparsely vegetated": (331, 332, 333, 334, 335),
    "Pasture & arable": (211, 212, 213, 221, 222, 223, 231, 241, 242, 243, 244),
    "Built-up": (111, 112, 121, 122, 123, 124, 131, 132, 133, 141, 142),
    "Water & coastal": (421, 422, 423, 511, 512, 521, 522, 523),
}
PEAT = (412, 411, 322, 321, 324)

# ids that a list of scenes or fires holds at most; parts that the scenes of a cell are dealt to
LIST_IDS = 256
CELL_SHARDS = 4


def valid_pixels(pixels: DataFrame, nodata: int = -32768) -> DataFrame:
    """Pixels with a finite value other than nodata."""
    return pixels.where(F.col("dnbr").isNotNull() & ~F.isnan(F.col("dnbr").cast("double")) & (F.col("dnbr") != nodata))


def pixel_centres(pixels: DataFrame, raster: DataFrame) -> DataFrame:
    """Adds lon, lat of each pixel's centre, from the Mercator geotransform of its fire's raster."""
    x = F.col("x0") + (F.col("col") + 0.5) * F.col("px")
    y = F.col("y0") + (F.col("row") + 0.5) * F.col("py")
    return pixels.join(raster.select("fire_id", "x0", "y0", "px", "py"), "fire_id").select(*pixels.columns, x.alias("x"), y.alias("y"), geo.inverse_mercator_lon(x).alias("lon"), geo.inverse_mercator_lat(y).alias("lat"))


def clip_to_perimeter(pixels: DataFrame, raster: DataFrame, fires: DataFrame) -> DataFrame:
    """Pixels whose centre lies in their own fire. A fire without perimeter passes whole, with cut = false.

    Adds inside (true, or null if not cut) and cut. Joined by fire and lattice row: an edge meets only the rows it spans, whose latitudes
    follow from the raster alone, so pixels are read once.
    """
    centred = pixel_centres(pixels, raster)
    rings = edges(fires)
    # the rows that an edge spans by its ends' latitudes, and one more on either side; the latitudes then decide
    row = lambda lat: (geo.mercator_y(lat) - F.col("y0")) / F.col("py") - 0.5
    spans = rings.join(raster.select("fire_id", "y0", "py"), "fire_id").withColumn("from", F.floor(F.least(row("ay"), row("by"))) - 1).withColumn("to", F.ceil(F.greatest(row("ay"), row("by"))) + 1)
    spans = spans.withColumn("row", F.explode(F.sequence(F.col("from").cast("int"), F.col("to").cast("int"))))
    spans = spans.withColumn("lat", geo.inverse_mercator_lat(F.col("y0") + (F.col("row") + 0.5) * F.col("py")))
    hit = spans.where((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat")))
    at = (F.col("ax") - F.col("bx")) * (F.col("lat") - F.col("by")) / (F.col("ay") - F.col("by")) + F.col("bx")
    hit = hit.groupBy("fire_id", "row").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    known = rings.select("fire_id", F.lit(True).alias("known")).distinct()
    out = centred.join(known, "fire_id", "left").join(hit, ["fire_id", "row"], "left")
    # inside if an odd number of crossings lies to the east; polygons of one fire don't share area
    odd = F.coalesce(F.size(F.filter("xs", lambda v: v > F.col("lon"))) % 2 == 1, F.lit(False))
    out = out.withColumn("cut", F.col("known").isNotNull()).withColumn("inside", F.when(F.col("cut"), odd))
    return out.where("inside OR NOT cut").drop("xs", "known")


def resample_landcover(pixels: DataFrame, raster: DataFrame, cover: DataFrame, x0: float, y0: float, px: float, py: float) -> DataFrame:
    """Each pixel's centre takes the land-cover cell that holds it; none is 0; codes are clipped to 0..599."""
    at = pixel_centres(pixels, raster)
    at = at.withColumn("lc_col", F.floor((F.col("x") - x0) / px)).withColumn("lc_row", F.floor((F.col("y") - y0) / py))
    cells = cover.select(F.col("row").cast("bigint").alias("lc_row"), F.col("col").cast("bigint").alias("lc_col"), F.col("code").alias("lc"))
    code = F.greatest(F.lit(0), F.least(F.lit(599), F.coalesce("lc", F.lit(0))))
    return at.join(cells, ["lc_row", "lc_col"], "left").select(*pixels.columns, code.alias("code"))


def mosaic_landcover(rasters: DataFrame) -> DataFrame:
    """One code a cell; a later file is drawn over an earlier one."""
    return rasters.groupBy("row", "col").agg(F.max_by("code", "file_order").alias("code"))


def mosaic_rasters(cells: DataFrame, rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S5 over files with origins of their own: (row, col, code on a common lattice; that lattice as one row x0, y0, px, py).

    cells: file_order, row, col, code; rasters: file_order, x0, y0, px, py, nodata. The lattice has the first file's pixels and starts
    at the outermost corner of all files; a cell goes where its centre lies. A later file is drawn over an earlier one, and
    cells without data are transparent.
    """
    size = rasters.agg(F.min_by(F.struct("px", "py"), "file_order").alias("p"), F.min("x0").alias("left"), F.max("x0").alias("right"), F.min("y0").alias("low"), F.max("y0").alias("high"))
    lattice = size.select(F.when(F.col("p.px") > 0, F.col("left")).otherwise(F.col("right")).alias("x0"), F.when(F.col("p.py") > 0, F.col("low")).otherwise(F.col("high")).alias("y0"), "p.px", "p.py")
    placed = rasters.crossJoin(F.broadcast(lattice.select(*[F.col(c).alias("l" + c) for c in ("x0", "y0", "px", "py")])))  # one row
    at = cells.join(placed, "file_order").where("code IS NOT NULL AND NOT code <=> nodata")
    place = lambda i, o, p: F.floor((F.col(o) + (F.col(i) + 0.5) * F.col(p) - F.col("l" + o)) / F.col("l" + p)).cast("int")
    at = at.select(place("row", "y0", "py").alias("row"), place("col", "x0", "px").alias("col"), "code", "file_order")
    return mosaic_landcover(at), lattice


def landcover_group(code="code") -> Column:
    """J16 as an expression over a dozen groups."""
    out = F.lit("Other")
    for name, codes in GROUPS.items():
        out = F.when(geo.c(code).isin(*codes), name).otherwise(out)
    return out


def landcover_groups(pixels: DataFrame) -> DataFrame:
    """Code to group, by a lookup table of fixed size."""
    spark = pixels.sparkSession
    lookup = spark.createDataFrame([(k, g) for g, codes in GROUPS.items() for k in codes], "code int, landcover string")
    return pixels.join(F.broadcast(lookup), "code", "left").withColumn("landcover", F.coalesce("landcover", F.lit("Other")))


def pixel_hectares(raster: DataFrame) -> DataFrame:
    """true hectares of a Mercator pixel, at the latitude of the raster's centre."""
    lat = geo.inverse_mercator_lat(F.col("y0") + F.col("height") / 2 * F.col("py"))
    ha = F.abs(F.col("px") * F.cos(F.radians(lat)) * F.col("py") * F.cos(F.radians(lat))) / 10000
    return raster.select("fire_id", ha.alias("pixel_ha"))


def severity_landcover_crosstab(pixels: DataFrame, raster: DataFrame) -> DataFrame:
    """A1: fire_id, landcover, hectares in six severity classes (2 decimals), their total, and the fire's total.

    Counting is one aggregation by fire and group; slivers up to 0.005 ha are dropped.
    """
    counted = valid_pixels(pixels).withColumn("landcover", landcover_group()).withColumn("sev", geo.severity("dnbr"))
    by = counted.groupBy("fire_id", "landcover").agg(*[F.count_if(F.col("sev") == k).alias(s) for k, s in enumerate(SEVERITIES)])
    by = by.join(pixel_hectares(raster), "fire_id")
    by = by.select("fire_id", "landcover", *[F.round(F.col(s) * F.col("pixel_ha"), 2).alias(s) for s in SEVERITIES])
    row = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    by = by.withColumn("row_ha", F.round(row, 2)).where(row > 0.005)
    total = by.groupBy("fire_id").agg(F.round(F.sum("row_ha"), 2).alias("total_ha"))
    return by.join(total, "fire_id")


def severity_stats(pixels: DataFrame) -> DataFrame:
    """A2: px, mean and p90 (1 decimal), severe_frac (3 decimals) of each fire's valid pixels."""
    v = F.col("dnbr")
    return valid_pixels(pixels).groupBy("fire_id").agg(F.count("*").alias("px"), F.round(F.avg(v), 1).alias("mean"), F.round(F.percentile(v, 0.9), 1).alias("p90"), F.round(F.avg((v >= 440).cast("int")), 3).alias("severe_frac"))


def landcover_histogram(pixels: DataFrame) -> DataFrame:
    """A4: pixels of each code by fire."""
    return pixels.groupBy("fire_id", "code").agg(F.count("*").alias("n"))


def chart_rollup(crosstab: DataFrame, most: int = 7) -> DataFrame:
    """Per fire, land cover by falling total; beyond `most` rows the smallest are one row. With totals and burned share."""
    order = Window.partitionBy("fire_id").orderBy(F.desc("row_ha"), "landcover")
    ranked = crosstab.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("fire_id")))
    many = (F.col("n") > most) & (F.col("rn") >= most)
    name = F.when(many, F.concat(F.lit("Other ("), F.col("n") - (most - 1), F.lit(" classes)"))).otherwise(F.col("landcover"))
    rows = ranked.groupBy("fire_id", name.alias("landcover")).agg(F.min("rn").alias("pos"), *[F.round(F.sum(s), 2).alias(s) for s in SEVERITIES], F.round(F.sum("row_ha"), 2).alias("row_ha"))
    grand = rows.groupBy("fire_id").agg(F.round(F.sum("row_ha"), 2).alias("grand_ha"), F.round(F.sum(F.expr(" + ".join(SEVERITIES[2:]))) / F.sum("row_ha"), 4).alias("burned_share"))
    return rows.join(grand, "fire_id")


def landcover_share(crosstab: DataFrame) -> DataFrame:
    """Hectares and share of the mapped area of each land-cover group."""
    by = crosstab.groupBy("landcover").agg(F.sum("row_ha").alias("ha"))
    return by.select("landcover", F.round("ha", 2).alias("ha"), F.round(F.col("ha") / F.sum("ha").over(Window.partitionBy()), 4).alias("share"))


def severity_ranking(stats: DataFrame, fires: DataFrame, k: int = 3) -> DataFrame:
    """The k fires with the largest severe share, and the k largest fires."""
    severe = stats.orderBy(F.desc("severe_frac"), "fire_id").limit(k).select(F.lit("most_severe").alias("list"), "fire_id", F.col("severe_frac").alias("value"))
    large = fires.where("area_ha IS NOT NULL").orderBy(F.desc("area_ha"), "id").limit(k).select(F.lit("largest").alias("list"), F.col("id").alias("fire_id"), F.col("area_ha").alias("value"))
    return severe.union(large)


def area_validation(crosstab: DataFrame, fires: DataFrame) -> DataFrame:
    """Median and worst relative difference of mapped and published area."""
    total = crosstab.select("fire_id", "total_ha").distinct()
    joined = total.join(fires.where("area_ha > 0").select(F.col("id").alias("fire_id"), "area_ha"), "fire_id")
    off = F.abs(F.col("total_ha") - F.col("area_ha")) / F.col("area_ha")
    return joined.agg(F.count("*").alias("fires"), F.round(F.percentile(off, 0.5), 4).alias("median_error"), F.round(F.max(off), 4).alias("worst_error"))


def sample_severity(nodes: DataFrame, raster: DataFrame, pixels: DataFrame) -> DataFrame:
    """The severity class at each node (fire_id, e, n, lat, lon); -1 outside the raster, without one, or without data."""
    at = nodes.select("fire_id", "e", "n", "lat", "lon").join(raster, "fire_id", "left")
    at = at.withColumn("col", F.floor((geo.mercator_x("lon") - F.col("x0")) / F.col("px")).cast("int")).withColumn("row", F.floor((geo.mercator_y("lat") - F.col("y0")) / F.col("py")).cast("int"))
    at = at.withColumn("within", (F.col("col") >= 0) & (F.col("col") < F.col("width")) & (F.col("row") >= 0) & (F.col("row") < F.col("height")))
    seen = at.join(valid_pixels(pixels).select("fire_id", "row", "col", "dnbr"), ["fire_id", "row", "col"], "left")
    return seen.select("fire_id", "e", "n", F.when(F.col("within") & F.col("dnbr").isNotNull(), geo.severity("dnbr")).otherwise(-1).alias("sev"))


def raster_bounds(raster: DataFrame) -> DataFrame:
    """a raster's corners in degrees."""
    x1, y1 = F.col("x0") + F.col("width") * F.col("px"), F.col("y0") + F.col("height") * F.col("py")
    lons = [geo.inverse_mercator_lon(F.col("x0")), geo.inverse_mercator_lon(x1)]
    lats = [geo.inverse_mercator_lat(F.col("y0")), geo.inverse_mercator_lat(y1)]
    return raster.select("fire_id", F.least(*lons).alias("w"), F.least(*lats).alias("s"), F.greatest(*lons).alias("e"), F.greatest(*lats).alias("n"))


def peat_flag(pixels: DataFrame) -> DataFrame:
    """1 for codes of peat-forming cover."""
    return pixels.withColumn("peat", F.col("code").isin(*PEAT).cast("int"))


# imagery


def mask_scenes(observations: DataFrame, max_cloud: float = 70.0) -> DataFrame:
    """Pixels of scenes that are not too cloudy and that are no shadow, cloud, snow or defect; reflectance in 0..1."""
    kept = observations.where((F.col("cloud_pct") < max_cloud) & ~F.col("scl").isin(1, 3, 7, 8, 9, 10, 11))
    return kept.withColumn("b8a", F.col("b8a") / 10000).withColumn("b12", F.col("b12") / 10000)


def fire_scene_windows(observations: DataFrame, fires: DataFrame, before: int = 120, after: int = 120, gap: int = 3) -> DataFrame:
    """Observations with phase pre, [fire - before, fire - gap) days, or post, [final + gap, final + after)."""
    day = lambda c: F.date_trunc("day", F.col(c)).cast("timestamp_ntz")
    start, end = day("firedate"), day("finaldate")
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    spans = fires.where("firedate IS NOT NULL").select(F.col("id").alias("fire_id"), (start - days(before)).alias("pre_from"), (start - days(gap)).alias("pre_to"), (end + days(gap)).alias("post_from"), (end + days(after)).alias("post_to"))
    joined = observations.join(spans, "fire_id")
    phase = F.when((F.col("scene_ts") >= F.col("pre_from")) & (F.col("scene_ts") < F.col("pre_to")), "pre").when((F.col("scene_ts") >= F.col("post_from")) & (F.col("scene_ts") < F.col("post_to")), "post")
    return joined.withColumn("phase", phase).where("phase IS NOT NULL").select(*observations.columns, "phase")


def scenes_of_fires(scenes: DataFrame, boxes: DataFrame, before: int = 120, after: int = 120, gap: int = 3, zoom: int = 8) -> DataFrame:
    """J7 for scenes that know no fire: scene_id, fire_id and phase of each scene whose footprint meets a fire's box in time.

    scenes: scene_id, scene_ts and footprint w, s, e, n; boxes: id, firedate, finaldate, w, s, e, n. The phases are those of
    fire_scene_windows(). They begin and end at midnight, so scenes of one footprint and day meet the same fires, and fires of one box and
    phase the same scenes: both are compared as lists of ids, which are written out for lists that meet. Lists are dealt to cells of a tile
    and some days, an eighth of the longer phase, and meet in the first cell that both touch, so no pair is found twice; dates and boxes are
    compared exactly.
    """
    day = lambda c: F.date_trunc("day", F.col(c)).cast("timestamp_ntz")
    start, end = day("firedate"), day("finaldate")
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    date = lambda at: F.unix_date(at.cast("date"))
    span = lambda name, a, b: F.struct(F.lit(name).alias("phase"), date(a).alias("from"), date(b).alias("to"))
    spans = F.array(span("pre", start - days(before), start - days(gap)), span("post", end + days(gap), end + days(after)))
    box = ["w", "s", "e", "n"]
    windows = boxes.withColumn("span", F.explode(spans)).where("span.from < span.to").select("id", *box, "span.*")
    shots = scenes.where("scene_ts IS NOT NULL").select("scene_id", *box, date(F.col("scene_ts")).alias("on"))
    width = max(1, (max(before, after) - gap) // 8)
    part = lambda c: F.floor(c / width)
    first = lambda lon, lat: (geo.clamp_tile(geo.tile_x(lon, zoom), zoom), geo.clamp_tile(geo.tile_y(lat, zoom), zoom))

    def listed(df: DataFrame, name: str, same: list[str]) -> DataFrame:
        """Lists of at most LIST_IDS ids, nulls among them, of rows that agree in same. They are numbered by a hash of same, in one shuffle."""
        df = df.where("w <= e AND s <= n").withColumn("of", F.xxhash64(*same))
        df = df.withColumn("list", F.floor((F.row_number().over(Window.partitionBy("of").orderBy(name)) - 1) / LIST_IDS))
        return df.groupBy("of", *same, "list").agg(F.transform(F.collect_list(F.struct(name)), lambda x: x[name]).alias("ids"))

    def dealt(df: DataFrame, parts: tuple[Column, Column], shards: Column, p: str) -> DataFrame:
        (x0, y0), (x1, y1) = first("w", "n"), first("e", "s")
        df = df.select("*", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), parts[0].alias("t0"), parts[1].alias("t1"), F.explode(shards).alias("shard"))
        for c in "xyt":
            df = df.withColumn(f"c{c}", F.explode(F.sequence(f"{c}0", f"{c}1")))
        return df.select(*[F.col(c).alias(p + c) for c in df.columns if c not in ("cx", "cy", "ct", "shard")], "cx", "cy", "ct", "shard")

    asked = dealt(listed(windows, "id", [*box, "phase", "from", "to"]), (part(F.col("from")), part(F.col("to") - 1)), F.array(*map(F.lit, range(CELL_SHARDS))), "f_")
    own = F.pmod(F.xxhash64("of", "list"), F.lit(CELL_SHARDS)).cast("int")
    seen = dealt(listed(shots, "scene_id", [*box, "on"]), (part(F.col("on")), part(F.col("on"))), F.array(own), "s_")
    # a small input gives very many pairs, so the number of tasks is not left to its size
    tasks = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["cx", "cy", "ct", "shard"]
    met = seen.repartition(tasks, *key).join(asked.repartition(tasks, *key), key)
    for c in "xyt":
        met = met.where(F.col(f"c{c}") == F.greatest(f"s_{c}0", f"f_{c}0"))
    met = met.where("s_w <= f_e AND s_e >= f_w AND s_s <= f_n AND s_n >= f_s AND s_on >= f_from AND s_on < f_to")
    # ends the step of the join, which would else hold all rows of a scene list at once; behind it a step holds those of two lists
    met = met.select("s_ids", "f_ids", F.col("f_phase").alias("phase")).coalesce(tasks)
    return met.withColumn("fire_id", F.explode("f_ids")).withColumn("scene_id", F.explode("s_ids")).select("scene_id", "fire_id", "phase")


def median_composite(windowed: DataFrame) -> DataFrame:
    """The median NBR of each fire, pixel and phase; a pixel with no reflectance has none."""
    nbr = (F.col("b8a") - F.col("b12")) / F.nullif(F.col("b8a") + F.col("b12"), F.lit(0.0))
    return windowed.withColumn("nbr", nbr).where("nbr IS NOT NULL").groupBy("fire_id", "row", "col", "phase").agg(F.percentile("nbr", 0.5).alias("nbr"))


def burn_severity(composite: DataFrame) -> DataFrame:
    """dNBR (x 1000) and RdNBR of pixels with both phases. One aggregation, no self-join."""
    pick = lambda p: F.max(F.when(F.col("phase") == p, F.col("nbr")))
    both = composite.groupBy("fire_id", "row", "col").agg(pick("pre").alias("pre"), pick("post").alias("post")).where("pre IS NOT NULL AND post IS NOT NULL")
    d = (F.col("pre") - F.col("post")) * 1000
    return both.select("fire_id", "row", "col", d.alias("dnbr"), (d / F.greatest(F.sqrt(F.abs("pre")), F.lit(0.001))).alias("rdnbr"))


def dnbr_summary(fires: DataFrame, windowed: DataFrame, severity: DataFrame, max_cloud: float = 70.0) -> DataFrame:
    """A3: scenes before and after (before pixel masking), and mean, median, p90 and count of dNBR; every fire has a row."""
    scenes = windowed.where(F.col("cloud_pct") < max_cloud).groupBy("fire_id").agg(F.count_distinct(F.when(F.col("phase") == "pre", F.col("scene_id"))).alias("n_pre"), F.count_distinct(F.when(F.col("phase") == "post", F.col("scene_id"))).alias("n_post"))
    stats = severity.groupBy("fire_id").agg(F.avg("dnbr").alias("mean"), F.percentile("dnbr", F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.count("*").alias("n"))
    ids = fires.select(F.col("id").alias("fire_id"))
    out = ids.join(scenes, "fire_id", "left").join(stats, "fire_id", "left")
    return out.select("fire_id", F.coalesce("n_pre", F.lit(0)).alias("n_pre"), F.coalesce("n_post", F.lit(0)).alias("n_post"), F.round("mean", 3).alias("mean"), F.round(F.col("q")[0], 3).alias("median"), F.round(F.col("q")[1], 3).alias("p90"), F.coalesce("n", F.lit(0)).alias("n_pixels"))


def large_fires(fires: DataFrame, least_ha: float = 50.0) -> DataFrame:
    """P13."""
    return fires.where(F.col("area_ha") >= least_ha)
