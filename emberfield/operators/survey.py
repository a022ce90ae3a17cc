"""Measurements: validation, merging, review, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.storage import written
from .spatial import attach_fires, attach_grid_nodes

COMBUSTION = ("unburned", "light", "moderate", "near_complete")
MAX_PHOTO = 3 * 1024 * 1024


def given_depths(depths="depths") -> Column:
    return F.filter(geo.c(depths), lambda d: d.isNotNull())


def mean_depth(depths="depths") -> Column:
    own = given_depths(depths)
    return F.aggregate(own, F.lit(0.0), lambda s, d: s + d) / F.nullif(F.size(own), F.lit(0))


def depth_stats(measurements: DataFrame) -> DataFrame:
    """A5: mean, count, least and largest of the depths given; null without any."""
    own = given_depths()
    return measurements.select("uuid", mean_depth().alias("depth_mean"), F.coalesce(F.size(own), F.lit(0)).alias("depth_count"), F.array_min(own).alias("depth_min"), F.array_max(own).alias("depth_max"))


def failed_rules(submitter="submitter") -> Column:
    """P5: the names of the broken rules, in order; empty for a valid row. A null comment or grid id is valid."""
    rules = {
        "missing": F.col("uuid").isNull() | F.col("lat").isNull() | F.col("lon").isNull() | F.col("depths").isNull() | F.col("user_id").isNull() | F.col("status").isNull() | F.col("created_at").isNull(),
        "uuid": ~((F.length("uuid") > 10) & (F.length("uuid") < 64)),
        "bounds": ~geo.in_uk(),
        "depths": F.size("depths") > 5,
        "depth_mean": ~((F.col("depth_mean") >= 0) & (F.col("depth_mean") <= 500)),
        "user": F.col("user_id") != geo.c(submitter),
        "comment": F.length("comment") > 500,
        "grid_id": F.length("grid_id") >= 40,
        "combustion": ~F.col("combustion").isin(*COMBUSTION),
        "status": F.col("status") != "pending_review",
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))


def odd_depths() -> Column:
    """What is odd about a row's depths and blocks nothing: a mean that is not theirs, and a depth outside 0 to 500."""
    mean = F.coalesce(F.abs(F.col("depth_mean") - mean_depth()) > 1e-6, F.col("depth_mean").isNotNull() != mean_depth().isNotNull())
    odd = {"mean_of_depths": mean, "depth_range": F.exists(given_depths(), lambda d: (d < 0) | (d > 500))}
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in odd.items()]))


def validate_measurements(rows: DataFrame) -> DataFrame:
    """P5: adds failed (names of broken rules), valid, and odd (names that block nothing). rows also has depth_mean, grid_id and submitter."""
    out = rows.withColumn("failed", failed_rules()).withColumn("odd", odd_depths())
    return out.withColumn("valid", F.size("failed") == 0)


def entry_error() -> Column:
    """The first thing that a form would refuse, or null."""
    own = given_depths()
    return (
        F.when(F.coalesce(F.size(own), F.lit(0)) < 1, "no_depth")
        .when(F.exists(own, lambda d: (d < 0) | (d > 500)), "depth_range")
        .when(F.col("combustion").isNull(), "no_combustion")
        .when(F.coalesce("photo_count", F.lit(0)) < 1, "no_photo")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "no_location")
        .when(~geo.in_uk(), "outside_uk")
    )


def accuracy_flag(poor_m: float = 30.0) -> Column:
    """P7."""
    return F.when(F.col("manual_placement"), "manual").when(F.col("accuracy_m") > poor_m, "poor").otherwise("ok")


def validate_photos(photos: DataFrame, stored: DataFrame) -> DataFrame:
    """Photos that are small enough, images, well named, and whose path is new; of repeated paths the first by name and size."""
    ok = photos.where("uploaded_by IS NOT NULL").where((F.col("size_bytes") < MAX_PHOTO) & F.col("content_type").startswith("image/") & F.col("name").rlike(r"\A[a-zA-Z0-9-]+\.jpg\z"))
    fresh = ok.join(stored.select("path"), "path", "left_anti")
    return fresh.groupBy("path").agg(F.min(F.struct("name", "size_bytes", "content_type", "uploaded_by")).alias("p")).select("path", "p.*")


def authorize_updates(changes: DataFrame, current: DataFrame, admins: DataFrame) -> DataFrame:
    """Adds accepted. Admins may do all; owners may update their pending rows without giving them away."""
    admin = admins.select(F.col("uid").alias("editor_uid"), F.lit(True).alias("is_admin")).distinct()
    now = current.select("uuid", F.col("user_id").alias("owner"), F.col("status").alias("now_status"))
    joined = changes.join(now, "uuid", "left").join(admin, "editor_uid", "left")
    own = (F.col("op") == "update") & (F.col("owner") == F.col("editor_uid")) & (F.col("now_status") == "pending_review") & (F.col("new_user_id") == F.col("owner"))
    exists = F.col("now_status").isNotNull()
    return joined.withColumn("accepted", exists & (F.coalesce("is_admin", F.lit(False)) | F.coalesce(own, F.lit(False)))).select(*changes.columns, "accepted")


def pending_uploads(points: DataFrame) -> DataFrame:
    """P10."""
    return points.where((F.col("status") == "pending") | F.coalesce("photo_pending", F.lit(False)))


def cloud_document(points: DataFrame, now: Column | None = None) -> DataFrame:
    """Local rows in the shape of the shared table, with defaults for what is absent. now: the time of the upload."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    urls = F.coalesce("photo_urls", F.array().cast("array<string>"))
    return points.select(
        "uuid", blank("fire_id"), blank("fire_name"), "lat", "lon", "accuracy_m", "depths", mean_depth().alias("depth_mean"), F.coalesce(F.size(given_depths()), F.lit(0)).alias("depth_count"),
        blank("combustion"), blank("grid_id"), "grid_dist_m", F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("surveyor", F.lit("")).alias("surveyor"),
        F.coalesce(F.get(urls, F.lit(0)), F.when(F.col("photo_url") != "", F.col("photo_url"))).alias("photo_url"), urls.alias("photo_urls"), F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
        "user_id", blank("user_email"), F.lit("pending_review").alias("status"), "created_at", F.lit(1).alias("client_version"), (F.current_timestamp() if now is None else now).alias("synced_at"),
    )


def merge_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows replace local ones, but for those with status pending. Both have the same columns, uuid first. Adds changed."""
    both = local.withColumn("_l", F.lit(True)).alias("l").join(remote.withColumn("_r", F.lit(True)).alias("r"), F.col("l.uuid") == F.col("r.uuid"), "full_outer")
    keep = F.col("_r").isNull() | (F.col("_l").isNotNull() & (F.coalesce(F.col("l.status"), F.lit("")) == "pending"))
    cols = [F.when(keep, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in local.columns]
    return both.select(*cols, (~keep).alias("changed"))


def push_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Field-level merge by uuid: fields that incoming has replace, a null too; others stay."""
    both = current.withColumn("_c", F.lit(True)).alias("c").join(incoming.withColumn("_i", F.lit(True)).alias("i"), F.col("c.uuid") == F.col("i.uuid"), "full_outer")
    cols = [F.when(F.col("_i").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) if c in incoming.columns else F.col(f"c.{c}").alias(c) for c in current.columns]
    return both.select(*cols)


def push_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """J14 by document: uuid and doc, a map. A key that an incoming document has replaces, with null too; a key that it lacks stays.

    incoming also has seq: several documents of one uuid are applied in its order. Keys, not whole documents, are aggregated.
    """
    entries = lambda df, seq: df.select("uuid", seq.alias("seq"), F.explode_outer("doc").alias("key", "value"))
    rows = entries(current, F.lit(-1).cast("bigint")).unionByName(entries(incoming, F.col("seq").cast("bigint")))
    last = rows.groupBy("uuid", "key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", F.col("v.value").alias("value")))))
    return last.groupBy("uuid").agg(F.map_from_entries(pairs).alias("doc"))


def layered_lookup(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first table's row of a key, else the second's. Both have the same columns. Adds layer (1 or 2)."""
    rows = first.withColumn("layer", F.lit(1)).unionByName(second.withColumn("layer", F.lit(2)))
    rest = [c for c in first.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest, "layer"), "layer").alias("v")).select(key, *[f"v.{c}" for c in rest], "v.layer")


def campaigns(measurements: DataFrame, fires: DataFrame, most: int | None = 10, max_m: float = 100.0) -> DataFrame:
    """Per fire (rows without one are attached to a fire nearby, else `unassigned`): points, first and last time, surveyors, position of the
    earliest point; newest first. most: how many, or None for all."""
    rows = measurements.select(F.col("uuid").alias("pid"), "fire_id", "lat", "lon", "created_at", "surveyor", "user_id")
    loose = attach_fires(rows.where("fire_id IS NULL"), fires, max_m)
    loose = written(loose.withColumn("fire_id", F.col("near_fire")).drop("near_fire", "dist_m"), "loose")
    rows = rows.where("fire_id IS NOT NULL").unionByName(loose).withColumn("fire_id", F.coalesce("fire_id", F.lit("unassigned")))
    who = F.coalesce(F.nullif(F.col("surveyor"), F.lit("")), F.nullif(F.col("user_id"), F.lit("")), F.lit("?"))
    out = rows.groupBy("fire_id").agg(F.count("*").alias("n"), F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"), F.count_distinct(who).alias("surveyors"))
    if most is not None:
        out = written(out.orderBy(F.desc("latest"), "fire_id").limit(most), "campaigns")
    # positions are sought when the times are known: all rows with their ids in one aggregation would be sorted, not hashed
    early = rows.select("pid", "fire_id", "lat", "lon", "created_at").join(out.select("fire_id", "earliest"), "fire_id").where("created_at IS NULL OR created_at = earliest")
    at = early.groupBy("fire_id").agg(F.min_by(F.struct("lat", "lon"), F.struct("created_at", "pid")).alias("at"))
    out = out.join(at, "fire_id").select("fire_id", "n", "earliest", "latest", "surveyors", "at.lat", "at.lon")
    return out if most is None else out.orderBy(F.desc("latest"), "fire_id")


def relocate_and_reattach(measurements: DataFrame, fires: DataFrame, grid: DataFrame, admin: str, now: Column | None = None, moved_m: float = 15.0) -> DataFrame:
    """Rows whose comment holds coordinates more than moved_m away: new position, fire, its name and node, and who moved it when."""
    # texts are searched once, and fires are met once: both tables are used more than once below
    found = written(measurements.select(F.col("uuid").alias("pid"), "lat", "lon", text.coordinates("comment").alias("at")).where("at IS NOT NULL"), "found")
    found = found.withColumn("moved_m", geo.local_m("lat", "lon", "at.lat", "at.lon")).where(F.col("moved_m") > moved_m)
    moved = found.select("pid", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), "moved_m")
    placed = written(attach_fires(moved, fires).withColumnRenamed("near_fire", "fire_id").drop("dist_m"), "placed")
    nodes = attach_grid_nodes(placed.where("fire_id IS NOT NULL"), grid).select("pid", "grid_id", "grid_dist_m")
    names = fires.select(F.col("id").alias("fire_id"), text.place_name("commune", "province").alias("fire_name"))
    out = placed.join(nodes, "pid", "left").join(names, "fire_id", "left")
    audit = [F.lit("comment-coordinates").alias("location_source"), (F.current_timestamp() if now is None else now).alias("location_corrected_at"), F.lit(admin).alias("location_corrected_by")]
    return out.select(F.col("pid").alias("uuid"), "lat", "lon", "moved_m", "fire_id", "fire_name", "grid_id", "grid_dist_m", *audit)


def comment_coordinates(comments: DataFrame, bounded: bool = True) -> DataFrame:
    """F8 over a table: coordinates in comments and how far they are from the stored position."""
    at = comments.withColumn("at", text.coordinates("comment", bounded)).where("at IS NOT NULL")
    return at.select("doc_id", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), F.col("at.kind").alias("kind"), geo.local_m(F.col("lat"), F.col("lon"), F.col("at.lat"), F.col("at.lon")).alias("moved_m"))


def review_queue(measurements: DataFrame, most: int = 50) -> DataFrame:
    """K2: the oldest rows that wait for review."""
    return measurements.where("status = 'pending_review'").orderBy("created_at", "uuid").limit(most)


def recent_measurements(measurements: DataFrame, most: int = 300) -> DataFrame:
    """K3."""
    return measurements.where("created_at IS NOT NULL").orderBy(F.desc("created_at"), F.desc("uuid")).limit(most)


def next_page(measurements: DataFrame, after: tuple | None = None, size: int = 500) -> DataFrame:
    """K4: the page of rows that follows a cursor (created_at, uuid). Rows without a time never appear."""
    rows = measurements.where("created_at IS NOT NULL")
    if after:
        rows = rows.where((F.col("created_at") > F.lit(after[0])) | ((F.col("created_at") == F.lit(after[0])) & (F.col("uuid") > F.lit(after[1]))))
    return rows.orderBy("created_at", "uuid").limit(size)


def keyset_pages(measurements: DataFrame, size: int = 500) -> DataFrame:
    """K4 for all pages: uuid and page number, from counts by month and ranks within one, so that no task ranks the whole table."""
    rows = measurements.where("created_at IS NOT NULL").select("uuid", "created_at", F.date_trunc("month", "created_at").alias("month"))
    months = rows.groupBy("month").agg(F.count("*").alias("n"))
    before = months.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("month", "before")
    rank = F.row_number().over(Window.partitionBy("month").orderBy("created_at", "uuid"))
    ranked = rows.withColumn("rn", rank).join(before, "month")
    return ranked.select("uuid", F.ceil((F.col("before") + F.col("rn")) / size).cast("int").alias("page"))


def sync_backlog(points: DataFrame) -> DataFrame:
    """Rows to upload, by fire and overall (fire_id `all`)."""
    waiting = pending_uploads(points).select(F.coalesce("fire_id", F.lit("unassigned")).alias("fire_id"))
    return waiting.groupBy("fire_id").agg(F.count("*").alias("n")).union(waiting.agg(F.lit("all"), F.count("*")))


def sync_report(outcomes: DataFrame) -> DataFrame:
    """Rows pushed, rows failed, and the first error, from ord, ok, error."""
    failed = F.when(~F.col("ok"), F.col("ord"))
    return outcomes.agg(F.count_if("ok").alias("pushed"), F.count_if(~F.col("ok")).alias("failed"), F.min_by("error", failed).alias("first_error"))


def density_by_tile(points: DataFrame, zooms: tuple[int, int] = (6, 12)) -> DataFrame:
    """Points and mean position by tile, for each zoom. The finest zoom is counted from rows, the others from its sums."""
    low, high = zooms
    fine = points.groupBy(geo.tile_x("lon", high).alias("x"), geo.tile_y("lat", high).alias("y")).agg(F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"))
    each = fine.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    up = F.pow(F.lit(2.0), high - F.col("z"))
    out = each.groupBy("z", F.floor(F.col("x") / up).alias("x"), F.floor(F.col("y") / up).alias("y")).agg(F.sum("n").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"))
    return out.select("z", "x", "y", "n", (F.col("lat") / F.col("n")).alias("lat"), (F.col("lon") / F.col("n")).alias("lon"))


def depth_by_severity(measurements: DataFrame, grid: DataFrame) -> DataFrame:
    """Burn depth by the severity class of the node that each measurement is attached to."""
    points = measurements.where("fire_id IS NOT NULL").select(F.col("uuid").alias("pid"), "fire_id", "lat", "lon", mean_depth().alias("depth"))
    at = attach_grid_nodes(points, grid).select("pid", "sev")
    return points.where("depth IS NOT NULL").join(at, "pid").groupBy("sev").agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth"), F.stddev("depth").alias("sd_depth"))


def export_columns(measurements: DataFrame) -> DataFrame:
    """The text columns of the field export, in order: fixed decimals, yes or no, one column a depth as written, empty for null."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    depth = [F.coalesce(text.number(F.get("depths", F.lit(i))), F.lit("")).alias(f"depth_{i + 1}") for i in range(5)]
    mean = mean_depth()
    # fixed values: the names of the columns and their order
    return measurements.select(
        "uuid", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_iso"), blank(F.col("surveyor")).alias("surveyor"), blank(F.col("fire_id")).alias("fire_id"), blank(F.col("fire_name")).alias("fire_name"),
        F.format_string("%.6f", "lat").alias("lat"), F.format_string("%.6f", "lon").alias("lon"), F.when(F.col("accuracy_m").isNull(), "").otherwise(geo.half_up("accuracy_m").cast("string")).alias("gps_accuracy_m"),
        F.when(F.col("manual_placement"), "yes").otherwise("no").alias("manual_placement"), *depth, F.when(mean.isNull(), "").otherwise(F.format_string("%.2f", mean)).alias("depth_mean_cm"),
        F.coalesce(F.size(given_depths()), F.lit(0)).alias("depth_n"), blank(F.col("combustion")).alias("combustion"), blank(F.col("grid_id")).alias("grid_id"), blank(F.col("grid_dist_m")).alias("grid_dist_m"),
        blank(F.col("comment")).alias("comment"), blank(F.col("photo_url")).alias("photo_url"), F.coalesce("photo_count", F.lit(0)).alias("photo_count"), "status",
    )


def backup_columns(measurements: DataFrame) -> DataFrame:
    """The backup's text columns, in order: depths and photo addresses joined, times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    depths = F.array_join(F.transform("depths", lambda d: F.coalesce(text.number(d), F.lit(""))), "; ").alias("depths")
    # fixed values: the names of the columns and their order
    return measurements.select(
        "uuid", "status", "lat", "lon", "accuracy_m", mean_depth().alias("depth_mean"), depths, "combustion", "grid_id", "grid_dist_m", "fire_id", "fire_name", "comment", "surveyor",
        "user_email", iso("created_at"), iso("synced_at"), "location_source", F.array_join("photo_urls", "; ").alias("photo_urls"),
    )
