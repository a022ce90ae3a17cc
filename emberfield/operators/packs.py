"""Field packs: labels of fires, tile covers, their cost and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from .spatial import bounding_boxes

BASE_ZOOMS, COVER_ZOOMS = (10, 15), (10, 11)
BASE_BYTES, COVER_BYTES = 19456, 2560
TOO_MANY, MANY = 10000, 1200
VERSION, BASEMAP = 4, "topo"


def fire_labels(fires: DataFrame) -> DataFrame:
    """Name and subtitle of each fire."""
    return fires.select("id", text.place_name("commune", "province").alias("name"), text.subtitle("firedate", "area_ha", "country").alias("subtitle"))


def visible_fires(fires: DataFrame, packs: DataFrame, least_ha: float = 0.0) -> DataFrame:
    """Fires large enough, or downloaded; a null area is 0."""
    have = packs.select(F.col("fire_id").alias("id"), F.lit(True).alias("have")).distinct()
    return fires.join(have, "id", "left").where(F.col("have").isNotNull() | (F.coalesce("area_ha", F.lit(0.0)) >= least_ha)).drop("have")


def downloaded_fires(fires: DataFrame, packs: DataFrame) -> DataFrame:
    """J8."""
    return fires.join(packs.select(F.col("fire_id").alias("id")), "id", "left_semi")


def search_fires(fires: DataFrame, words: str, downloaded: DataFrame | None = None, most: int = 60) -> DataFrame:
    """Fires whose name, id or country contains the words, in any case; without words the first `most` of the index."""
    named = fires.withColumn("name", text.place_name("commune", "province"))
    named = named.join(downloaded.select(F.col("fire_id").alias("id")), "id", "left_semi") if downloaded is not None else named
    if not words.strip():
        return named.orderBy("index_pos").limit(most)
    return named.where(F.contains(F.lower(F.concat_ws(" ", "name", "id", "country")), F.lit(words.strip().lower())))


def burn_windows(fires: DataFrame) -> DataFrame:
    """hours from start to end and a label; null if the end is not after the start."""
    hours = F.timestamp_diff("SECOND", F.col("firedate"), F.col("finaldate")) / 3600.0
    day = geo.half_up(hours / 24)
    label = F.when(hours < 1.5, "contained within the hour").when(hours < 24, F.concat(F.lit("contained within "), geo.half_up(hours), F.lit(" hours"))).otherwise(F.concat(F.lit("burned for "), day, F.when(day == 1, " day").otherwise(" days")))
    return fires.select("id", F.when(hours > 0, hours).alias("burn_hours"), F.when(hours > 0, label).alias("label"))


def pack_state(fires: DataFrame, packs: DataFrame, version: int = VERSION, basemap: str = BASEMAP) -> DataFrame:
    """None, stale or ready for every fire."""
    state = F.when(F.col("version").isNull(), "none").when((F.col("version") != version) | (F.col("basemap") != basemap) | (F.col("failed") > 0), "stale").otherwise("ready")
    return fires.select("id").join(packs.select(F.col("fire_id").alias("id"), "version", "basemap", "failed"), "id", "left").select("id", state.alias("state"))


def _ranges(boxes: DataFrame, km: float) -> DataFrame:
    """One row for each box and zoom: ranges of tiles that cover the buffered box, and which layers take them."""
    grown = boxes.where("w IS NOT NULL").withColumn("b", geo.buffered("w", "s", "e", "n", km)).select("id", "w", "s", "e", "n", "b")
    each = grown.withColumn("z", F.explode(F.sequence(F.lit(BASE_ZOOMS[0]), F.lit(BASE_ZOOMS[1]))))
    clamp = lambda t: geo.clamp_tile(t, F.col("z")).cast("bigint")
    return each.select("id", "b", "z", clamp(geo.tile_x("b.w", "z")).alias("x0"), clamp(geo.tile_x("b.e", "z")).alias("x1"), clamp(geo.tile_y("b.n", "z")).alias("y0"), clamp(geo.tile_y("b.s", "z")).alias("y1"), F.col("z").between(*COVER_ZOOMS).alias("covered"))


def pack_estimate(fires: DataFrame, km: float = 2.0) -> DataFrame:
    """Tiles, bytes and area of each fire's pack, counted in closed form, and whether that is much or too much."""
    n = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    by = _ranges(bounding_boxes(fires), km).groupBy("id").agg(F.sum(n).alias("base"), F.sum(F.when(F.col("covered"), n).otherwise(0)).alias("cover"), F.first("b").alias("b"))
    tiles = F.col("base") + F.col("cover")
    return by.select("id", tiles.alias("tile_count"), (F.col("base") * BASE_BYTES + F.col("cover") * COVER_BYTES).alias("bytes"), geo.area_km2("b.w", "b.s", "b.e", "b.n").alias("area_km2"), (tiles > TOO_MANY).alias("too_big"), (tiles > MANY).alias("warn"))


def pack_tile_cover(fires: DataFrame, km: float = 2.0, zooms: tuple[int, int] = BASE_ZOOMS) -> DataFrame:
    """Every tile of every pack, base map and land cover under their own layer."""
    r = _ranges(bounding_boxes(fires), km).where(F.col("z").between(*zooms))
    tiles = r.select("id", "covered", "z", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("id", "covered", "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    layers = F.when(F.col("covered"), F.array(F.lit("base"), F.lit("landcover"))).otherwise(F.array(F.lit("base")))
    return tiles.select(F.col("id").alias("fire_id"), F.explode(layers).alias("layer"), "z", "x", "y")


def pack_size_distribution(estimates: DataFrame) -> DataFrame:
    """Median, 90th percentile and largest pack, in tiles and bytes, and all tiles."""
    q = lambda c, p: F.percentile(c, p)
    return estimates.agg(*[q(c, p).alias(f"{c}_{name}") for c in ("tile_count", "bytes") for name, p in (("median", 0.5), ("p90", 0.9), ("max", 1.0))], F.sum("tile_count").alias("all_tiles"))


def missing_tiles(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned tiles that are not stored."""
    return planned.select("layer", "z", "x", "y").distinct().join(stored.select("layer", "z", "x", "y"), ["layer", "z", "x", "y"], "left_anti")


def orphan_tiles(cover: DataFrame, removed: str) -> DataFrame:
    """Tiles of a removed pack that no other pack needs."""
    key = ["layer", "z", "x", "y"]
    return cover.where(F.col("fire_id") == removed).select(*key).distinct().join(cover.where(F.col("fire_id") != removed).select(*key), key, "left_anti")


def shared_tiles(cover: DataFrame) -> DataFrame:
    """Tiles that several packs use, and how many."""
    return cover.groupBy("layer", "z", "x", "y").agg(F.count_distinct("fire_id").alias("packs")).where("packs > 1")


def shared_nodes(grid: DataFrame) -> DataFrame:
    """Lattice nodes that belong to several fires."""
    # nodes are dealt out before they are counted: a task that makes very many would else hold all of them in its own table
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.select("e", "n", "fire_id").repartition(tasks, "e", "n").groupBy("e", "n").agg(F.count_distinct("fire_id").alias("fires")).where("fires > 1")


def grid_summary(grid: DataFrame) -> DataFrame:
    """Fires, nodes, fires with a single node, and the fire with the most."""
    by = grid.groupBy("fire_id").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "fire_id"))
    return by.agg(F.count("*").alias("fires"), F.sum("n").alias("nodes"), F.count_if(F.col("n") == 1).alias("single"), top.alias("top")).select("fires", "nodes", "single", F.col("top.fire_id").alias("largest"), F.col("top.n").alias("largest_n"))


def pack_storage(packs: DataFrame) -> DataFrame:
    """A18."""
    return packs.agg(F.count("*").alias("packs"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def prune_blank_tiles(pixels: DataFrame, most_bytes: int = 800) -> DataFrame:
    """Per zoom, tiles checked, tiles removed (all transparent and small) and bytes freed. Larger tiles need no pixel test."""
    tiles = pixels.groupBy("z", "x", "y").agg(F.max("alpha").alias("alpha"), F.max("bytes").alias("bytes"))
    blank = (F.col("bytes") <= most_bytes) & (F.col("alpha") == 0)
    return tiles.groupBy("z").agg(F.count("*").alias("checked"), F.count_if(blank).alias("removed"), F.coalesce(F.sum(F.when(blank, F.col("bytes"))), F.lit(0)).alias("freed"))


def build_pack_table(fires: DataFrame, detail: DataFrame, severity: DataFrame, stats: DataFrame, grid: DataFrame, stored: DataFrame) -> DataFrame:
    """A pack row for each fire: its properties, the detailed geometry if there is one, box, tiles of the plan and bytes stored,
    severity, the statistics document, node count, version and base map.

    stats: documents as stats_documents() makes them. stored: tiles with fire_id and bytes. Severity, statistics and bytes are
    null where there are none.
    """
    nodes = grid.groupBy(F.col("fire_id").alias("id")).agg(F.count("*").alias("grid_count"))
    total = stats.select(F.col("fire_id").alias("id"), F.struct("total_ha", "matrix").alias("stats"))
    sev = severity.select(F.col("fire_id").alias("id"), F.struct("severe_frac", "mean", "p90").alias("dnbr"))
    size = stored.groupBy(F.col("fire_id").alias("id")).agg(F.sum("bytes").alias("bytes"))
    out = fires.join(detail.select("id", F.col("geom").alias("detail")), "id", "left").withColumn("geom", F.coalesce("detail", "geom"))
    boxes = bounding_boxes(out).select("id", F.struct("w", "s", "e", "n").alias("bbox"))
    tiles = pack_estimate(fires).select("id", "tile_count")
    props = F.struct(*[c for c in fires.columns if c not in ("geom", "index_pos")]).alias("props")
    out = out.select("id", text.place_name("commune", "province").alias("name"), props, "geom", F.col("detail").isNotNull().alias("detailed"))
    for part in (sev, total, nodes, size, tiles):
        out = out.join(part, "id", "left")
    return out.join(boxes, "id").withColumn("grid_count", F.coalesce("grid_count", F.lit(0))).withColumn("failed", F.lit(0)).withColumn("version", F.lit(VERSION)).withColumn("basemap", F.lit(BASEMAP))


def top_area_per_landcover(crosstab: DataFrame, k: int = 3) -> DataFrame:
    """The k fires with most of each land cover."""
    rank = F.row_number().over(Window.partitionBy("landcover").orderBy(F.desc("row_ha"), "fire_id"))
    return crosstab.withColumn("rank", rank).where(F.col("rank") <= k).select("landcover", "rank", "fire_id", "row_ha")
