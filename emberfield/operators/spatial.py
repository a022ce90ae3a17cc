"""Spatial joins on cells, nearest neighbours, sampling lattices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.storage import written

ZOOM = 12
#: Degrees of latitude in a band of edges, some 200 m.
BAND = 0.002
#: Degrees of the squares in which points meet fires, and the number of fires that are tried as holders of a square.
SQUARE, TRIED = 0.01, 8
#: Tiles in which views meet fires.
VIEW_ZOOM = 8


def edges(fires: DataFrame) -> DataFrame:
    """One row an edge: fire_id, index_pos, poly, ring, ax, ay, bx, by. A fire without geometry has none."""
    polys = fires.select(F.col("id").alias("fire_id"), "index_pos", F.posexplode("geom").alias("poly", "rings"))
    rings = polys.select("fire_id", "index_pos", "poly", F.posexplode("rings").alias("ring", "points"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.get("points", i - 1).alias("a"), F.get("points", i).alias("b")))
    out = rings.where(F.size("points") > 1).select("fire_id", "index_pos", "poly", "ring", F.explode(pairs).alias("edge"))
    return out.select("fire_id", "index_pos", "poly", "ring", F.col("edge.a.lon").alias("ax"), F.col("edge.a.lat").alias("ay"), F.col("edge.b.lon").alias("bx"), F.col("edge.b.lat").alias("by"))


def bounding_boxes(fires: DataFrame, *others: str) -> DataFrame:
    """A10: id, w, s, e, n over all vertices, and other columns as they are; null without vertices."""
    points = F.flatten(F.flatten("geom"))
    part = lambda f, k: f(F.transform(points, lambda v: v[k]))
    return fires.select("id", *others, part(F.array_min, "lon").alias("w"), part(F.array_min, "lat").alias("s"), part(F.array_max, "lon").alias("e"), part(F.array_max, "lat").alias("n"))


def first_perimeters(fires: DataFrame) -> DataFrame:
    """id, index_pos, geom of the first fire, in index order, of those that have all vertices in common.

    A point lies in, or at a distance from, such fires alike, so the later ones never win. Rows without id or geometry are left out.
    """
    first = fires.where("id IS NOT NULL AND geom IS NOT NULL").groupBy("geom").agg(F.min(F.struct("index_pos", "id")).alias("f"))
    return first.select("f.id", "f.index_pos", "geom")


def representative_points(fires: DataFrame) -> DataFrame:
    """The plain mean of all vertices, closing ones and holes included."""
    points = F.flatten(F.flatten("geom"))
    mean = lambda k: F.aggregate(F.transform(points, lambda v: v[k]), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(points), F.lit(0))
    return fires.select("id", mean("lat").alias("lat"), mean("lon").alias("lon"))


def _cells(df: DataFrame, w, s, e, n, zoom: int = ZOOM) -> DataFrame:
    """Adds cx, cy: every tile of the zoom that the box touches."""
    xs = F.sequence(geo.tile_x(w, zoom), geo.tile_x(e, zoom))
    ys = F.sequence(geo.tile_y(n, zoom), geo.tile_y(s, zoom))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def _square(lat: str, lon: str) -> tuple[Column, Column]:
    return F.floor(F.col(lon) / SQUARE).alias("cx"), F.floor(F.col(lat) / SQUARE).alias("cy")


def _measured(pairs: DataFrame, sides: DataFrame, pad_m: float) -> DataFrame:
    """pid, fire_id, index_pos, inside, dist_m for pairs (pid, lat, lon, fire_id); dist_m is null or too large beyond pad_m.

    Edges are rows, dealt into bands of latitude that they span or come near. A point meets the edges of its own band only:
    those that decide parity cross its latitude, and those within pad_m are near it. A pair keeps its fire and band, so it is shuffled once.
    Dealt edges are many times the rows of their small files, so they are merged, never broadcast.
    """
    dlat = pad_m / geo.METRES_PER_DEGREE
    band = lambda lat: F.floor(lat / BAND)
    low, high = band(F.least("ay", "by") - dlat), band(F.greatest("ay", "by") + dlat)
    dealt = sides.withColumn("band", F.explode(F.sequence(low, high)))
    met = pairs.withColumn("band", band(F.col("lat"))).join(dealt.hint("merge"), ["fire_id", "band"])
    one = ["fire_id", "band", "pid", "index_pos"]
    ring = met.groupBy(*one, "poly", "ring").agg((F.count_if(geo.crosses("lon", "lat")) % 2).alias("odd"), F.min(geo.edge_m("lat", "lon")).alias("d"))
    outer = F.max(F.when(F.col("ring") == 0, F.col("odd")))
    poly = ring.groupBy(*one, "poly").agg((F.coalesce(outer, F.lit(0)) - F.coalesce(F.max(F.when(F.col("ring") > 0, F.col("odd"))), F.lit(0))).alias("inside"), F.min("d").alias("d"))
    return poly.groupBy(*one).agg((F.max("inside") == 1).alias("inside"), F.min("d").alias("dist_m")).drop("band")


def _met_fires(points: DataFrame, fires: DataFrame, pad_m: float) -> DataFrame:
    """pid, fire_id, index_pos, inside, dist_m of the fires that hold a point or, if none does, surely of those within pad_m.

    Fires are dealt to small squares that their padded boxes touch. Of the first fires in a square some hold all of it, as their edges are farther
    from its middle than its corners; every point there is in the first of these, and no later fire matters to it. So a point is compared
    with the few fires before that one, however many lie over one another; where no fire holds a square, with all of them, but
    for those that repeat an earlier fire's perimeter. Tables by square are merged: their files are far smaller than their rows.
    """
    fires = written(first_perimeters(fires), "perimeters")
    dlat = pad_m / geo.METRES_PER_DEGREE
    # the widest degree of longitude in the padded box is that of its northern edge
    dlon = dlat / F.cos(F.radians(F.greatest(F.abs(F.col("s")), F.abs(F.col("n"))) + dlat))
    boxes = bounding_boxes(fires, "index_pos").where("w IS NOT NULL")
    boxes = written(boxes.select(F.col("id").alias("fire_id"), "index_pos", (F.col("w") - dlon).alias("w"), (F.col("s") - dlat).alias("s"), (F.col("e") + dlon).alias("e"), (F.col("n") + dlat).alias("n")), "boxes")
    sides = written(edges(fires), "edges")
    (x0, y1), (x1, y0) = _square("n", "w"), _square("s", "e")
    near = boxes.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))
    whole = near.where((F.col("cx") * SQUARE >= F.col("w")) & ((F.col("cx") + 1) * SQUARE <= F.col("e")) & (F.col("cy") * SQUARE >= F.col("s")) & ((F.col("cy") + 1) * SQUARE <= F.col("n")))
    rank = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("index_pos"))
    first = whole.select("cx", "cy", "fire_id", "index_pos").withColumn("rank", rank).where(F.col("rank") <= TRIED)
    middles = first.select(F.struct("cx", "cy").alias("pid"), ((F.col("cy") + 0.5) * SQUARE).alias("lat"), ((F.col("cx") + 0.5) * SQUARE).alias("lon"), "fire_id")
    corner_m = SQUARE * geo.METRES_PER_DEGREE * 0.72  # at any latitude more than from the middle to a corner
    hold = _measured(middles, sides, corner_m * 1.05).where("inside").where(F.col("dist_m") > corner_m)
    hold = written(hold.groupBy("pid").agg(F.min(F.struct("index_pos", "fire_id")).alias("h")).select("pid.*", F.col("h.index_pos").alias("held_at"), F.col("h.fire_id").alias("holder")), "holders")
    left = written(near.join(hold.hint("merge"), ["cx", "cy"], "left").where("held_at IS NULL OR index_pos < held_at").drop("index_pos", "held_at", "holder"), "near")
    placed = points.select("pid", "lat", "lon", *_square("lat", "lon"))
    pairs = placed.join(left.hint("merge"), ["cx", "cy"]).where("lat BETWEEN s AND n AND lon BETWEEN w AND e").select("pid", "lat", "lon", "fire_id")
    sure = placed.join(hold.hint("merge"), ["cx", "cy"]).select("pid", F.col("holder").alias("fire_id"), F.col("held_at").alias("index_pos"), F.lit(True).alias("inside"), F.lit(0.0).alias("dist_m"))
    return _measured(pairs, sides.join(left.select("fire_id").distinct(), "fire_id", "left_semi"), pad_m).select("pid", "fire_id", "index_pos", "inside", "dist_m").unionByName(sure)


def points_in_fires(points: DataFrame, fires: DataFrame) -> DataFrame:
    """Pid and the first fire, in index order, that holds the point; points outside all fires are left out."""
    hit = _met_fires(points, fires, 0.0).where("inside")
    return hit.groupBy("pid").agg(F.min_by("fire_id", "index_pos").alias("fire_id"))


def attach_fires(points: DataFrame, fires: DataFrame, max_m: float = 100.0) -> DataFrame:
    """The fire that holds each point, else the nearest within max_m, earlier in the index on ties; null without one.

    points: pid, lat, lon, any further columns. Adds near_fire and dist_m (0 inside).
    """
    found = _met_fires(points, fires, max_m * 1.5)
    found = found.withColumn("dist_m", F.when(F.col("inside"), 0.0).otherwise(F.col("dist_m"))).where(F.col("dist_m") <= max_m)
    best = found.groupBy("pid").agg(F.min(F.struct((~F.col("inside")).alias("outside"), "dist_m", "index_pos", "fire_id")).alias("best"))
    return points.join(best.select("pid", F.col("best.fire_id").alias("near_fire"), F.col("best.dist_m").alias("dist_m")), "pid", "left")


def attach_grid_nodes(points: DataFrame, grid: DataFrame, max_m: float = 60.0) -> DataFrame:
    """The nearest node of a point's fire within max_m, ties by node order, with its rounded distance.

    points: pid, fire_id, lat, lon. Nodes lie in cells; a point looks into those that its reach touches, of which there are few as a cell is wider.
    """
    cell = max_m * 2 / geo.METRES_PER_DEGREE
    nodes = grid.select("fire_id", "node_pos", F.col("e"), F.col("n"), F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon"), "sev")
    nodes = nodes.withColumn("cy", F.floor(F.col("node_lat") / cell)).withColumn("cx", F.floor(F.col("node_lon") / (cell * 2)))
    # somewhat more than max_m, as distances are rounded; a degree of longitude is as long as at the point
    dlat = cell / 2 * 1.0001
    dlon = dlat / F.cos(F.radians("lat"))
    touched = lambda a, d, size: F.explode(F.sequence(F.floor((F.col(a) - d) / size), F.floor((F.col(a) + d) / size)))
    p = points.select("pid", "fire_id", "lat", "lon").withColumn("cy", touched("lat", dlat, cell)).withColumn("cx", touched("lon", dlon, cell * 2))
    pairs = p.join(nodes, ["fire_id", "cx", "cy"]).withColumn("dist", geo.local_m("lat", "lon", "node_lat", "node_lon"))
    best = pairs.groupBy("pid").agg(F.min(F.struct("dist", "node_pos", "e", "n", "sev")).alias("b")).where(F.col("b.dist") <= max_m)
    return best.select("pid", F.concat(F.lit("E"), F.col("b.e"), F.lit(" N"), F.col("b.n")).alias("grid_id"), geo.half_up(F.col("b.dist")).alias("grid_dist_m"), F.col("b.sev").alias("sev"), F.col("b.e").alias("e"), F.col("b.n").alias("n"))


def sampling_lattice(fires: DataFrame, spacing: int = 100) -> DataFrame:
    """National-grid cell centres inside each fire, by scan lines.

    A row of the lattice crosses the rings at sorted eastings; the nodes lie between the first and second, third and
    fourth, and so on, so only kept nodes are made. Polygons of one fire don't share area. A fire without a node gets
    one at the middle of its widest interior interval on the middle row (fallback true).
    """
    half = spacing // 2
    grid = geo.with_grid(geo.with_grid(edges(fires).select("fire_id", "ax", "ay", "bx", "by"), "ay", "ax", "ae", "an"), "by", "bx", "be", "bn")
    grid = written(grid.select("fire_id", "ae", "an", "be", "bn"), "sides")

    def intervals(lines: DataFrame, keys: list[str]) -> DataFrame:
        at = F.col("ae") + (F.col("y") - F.col("an")) / (F.col("bn") - F.col("an")) * (F.col("be") - F.col("ae"))
        hit = lines.where((F.col("an") > F.col("y")) != (F.col("bn") > F.col("y"))).groupBy(*keys, "y").agg(F.sort_array(F.collect_list(at)).alias("xs"))
        pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", i * 2).alias("from"), F.get("xs", i * 2 + 1).alias("to")))
        return hit.select(*keys, "y", F.explode(pair).alias("span")).select(*keys, "y", "span.from", "span.to")

    low = F.ceil((F.least("an", "bn") - half) / spacing).cast("bigint")
    high = F.floor((F.greatest("an", "bn") - half) / spacing).cast("bigint")
    rows = grid.where(low <= high).withColumn("line", F.explode(F.sequence(low, high))).withColumn("y", F.col("line") * spacing + half)
    first, last = F.ceil((F.col("from") - half) / spacing).cast("bigint"), F.floor((F.col("to") - half) / spacing).cast("bigint")
    # spans of a row follow one another, so where two share a node the later one begins behind it
    before = F.lag(last).over(Window.partitionBy("fire_id", "y").orderBy("from", "to"))
    spans = intervals(rows, ["fire_id"]).select("fire_id", "y", F.greatest(first, before + 1).alias("first"), last.alias("last")).where("first <= last")
    spans = written(spans, "spans")
    nodes = spans.select("fire_id", F.explode(F.sequence("first", "last")).alias("k"), F.col("y").alias("n")).select("fire_id", (F.col("k") * spacing + half).alias("e"), "n", F.lit(False).alias("fallback"))
    middle = grid.groupBy("fire_id").agg(((F.min("an") + F.max("an")) / 2).alias("y"))
    bare = grid.join(spans.select("fire_id").distinct(), "fire_id", "left_anti").join(middle, "fire_id")
    widest = intervals(bare, ["fire_id"]).groupBy("fire_id").agg(F.max(F.struct((F.col("to") - F.col("from")).alias("width"), "from", "to", "y")).alias("s"))
    single = widest.select("fire_id", geo.half_up((F.col("s.from") + F.col("s.to")) / 2).cast("bigint").alias("e"), geo.half_up(F.col("s.y")).cast("bigint").alias("n"), F.lit(True).alias("fallback"))
    out = geo.with_degrees(nodes.unionByName(single), "e", "n", "lat", "lon")
    return out.select("fire_id", "e", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "fallback")


#: Edge of the cells of the sphere's unit cube at each level; the first holds the sphere.
CELL_EDGES = [2.0 / 4**k for k in range(9)]


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """x, y, z on the unit sphere: no edge at a pole or a meridian, and chords grow with distances along the surface."""
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def _cell(level: int) -> Column:
    """The cell of a level that holds x, y, z, as one number; the first level has one cell."""
    if not level:
        return F.lit(0).cast("bigint")
    part = lambda c: F.floor((F.col(c) + 1.0) / CELL_EDGES[level])
    return (part("x") * 2_097_152 + part("y")) * 2_097_152 + part("z")


def fires_near(queries: DataFrame, fires: DataFrame, k: int = 25, most_in_cell: int = 200) -> DataFrame:
    """K1: the k nearest fires by haversine to their mean vertex, for each query point (qid, lat, lon), ties by fire_id.

    Fires lie in a tree of cells of the unit sphere, each with the box of its fires and their number. Every query starts at the root and
    goes down level by level: of the children of its cells it keeps those that are no farther than the boxes which surely hold k
    fires. What it keeps is written between levels; in the end it meets the fires of its last cells. A level is deep enough when no
    cell holds more than `most_in_cell` fires. Queries without a place have no rows; with fewer than k fires all are returned.
    """
    spark = queries.sparkSession
    centre = representative_points(fires).where("lat IS NOT NULL AND lon IS NOT NULL").select("id", F.col("lat").alias("flat"), F.col("lon").alias("flon"))
    places = centre.select("*", *_on_sphere("flat", "flon"))
    places = written(places.select("*", *[_cell(level).alias(f"c{level}") for level in range(len(CELL_EDGES))]), "places")
    deepest = len(CELL_EDGES) - 1
    largest = places.groupBy(*[f"c{i}" for i in range(deepest + 1)]).count()
    fullest = [largest.groupBy(f"c{i}").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0 for i in range(1, deepest + 1)]
    depth = next((i for i, n in enumerate(fullest, 1) if n <= most_in_cell), deepest)
    left = queries.where("lat IS NOT NULL AND lon IS NOT NULL").select("qid", "lat", "lon").select("qid", "lat", "lon", *_on_sphere("lat", "lon"), _cell(0).alias("cell"))
    by_reach = Window.partitionBy("qid").orderBy("far").rangeBetween(Window.unboundedPreceding, 0)
    square = lambda ends: sum((e * e for e in ends[1:]), ends[0] * ends[0])
    for level in range(1, depth + 1):
        box = [f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("0", F.min), ("1", F.max))]
        children = places.groupBy(F.col(f"c{level - 1}").alias("cell"), F.col(f"c{level}").alias("child")).agg(F.count("*").alias("n"), *box)
        met = left.join(children, "cell")
        near = F.sqrt(square([F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0)) for c in "xyz"]))
        far = F.sqrt(square([F.greatest(F.abs(F.col(f"{c}0") - F.col(c)), F.abs(F.col(f"{c}1") - F.col(c))) for c in "xyz"]))
        met = met.select("qid", "lat", "lon", "x", "y", "z", F.col("child").alias("cell"), "n", near.alias("near"), far.alias("far"))
        held = met.withColumn("held", F.sum("n").over(by_reach))
        reach = F.min(F.when(F.col("held") >= k, F.col("far"))).over(Window.partitionBy("qid"))
        kept = held.withColumn("reach", reach).where("reach IS NULL OR near <= reach * 1.000000001 + 1e-9")
        left = written(kept.select("qid", "lat", "lon", "x", "y", "z", "cell"), "near")
    last = left.join(places.select(F.col(f"c{depth}").alias("cell"), "id", "flat", "flon"), "cell")
    rank = Window.partitionBy("qid").orderBy("dist_m", "fire_id")
    found = last.select("qid", F.col("id").alias("fire_id"), geo.haversine_m("lat", "lon", "flat", "flon").alias("dist_m"))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("qid", "rank", "fire_id", "dist_m")


def viewport_fires(views: DataFrame, fires: DataFrame, most: int = 60) -> DataFrame:
    """Fires whose box meets each view's box, at most `most` a view, in index order."""
    boxes = _cells(bounding_boxes(fires).where("w IS NOT NULL").join(fires.select("id", "index_pos"), "id"), "w", "s", "e", "n", 6)
    seen = _cells(views.select("view_id", *[F.col(x).alias("v" + x) for x in "wsen"]), "vw", "vs", "ve", "vn", 6)
    met = seen.join(boxes, ["cx", "cy"]).where("w <= ve AND e >= vw AND s <= vn AND n >= vs").select("view_id", "id", "index_pos").distinct()
    rank = F.row_number().over(Window.partitionBy("view_id").orderBy("index_pos"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("view_id", F.col("id").alias("fire_id"), "rank")


def viewport_overlays(views: DataFrame, fires: DataFrame, most: int = 60, pad: float = 1.0, least_zoom: int = 9, refill: bool = True) -> DataFrame:
    """P14 over time: the overlays (fire_id, place in the order they were put there) that a session shows after each of its views.

    views: session, seq, zoom, w, s, e, n. Below least_zoom a view drops everything. Else overlays stay while they meet the view
    grown by `pad` of its size on each side; then fires that meet the view join in index order: with `refill` until there are `most`, else
    those of the first `most` that are not shown yet. A fold over a session's views in order, with its overlays as the state;
    a view brings no more candidates than can matter, as of twice `most` at least `most` are new. Candidates are found once for
    each box that views ask for; a box and a fire meet in the first tile that both touch, so no pair is found twice.
    """
    import pandas as pd

    x0, y0 = geo.tile_x("w", VIEW_ZOOM), geo.tile_y("n", VIEW_ZOOM)
    dealt = lambda df: _cells(df.withColumn("x0", x0).withColumn("y0", y0), "w", "s", "e", "n", VIEW_ZOOM)
    # boxes are written, so that their arrays of vertices are not searched again for every view
    boxes = written(bounding_boxes(fires, "index_pos").where("w IS NOT NULL"), "boxes")
    asked = views.where(F.col("zoom") >= least_zoom).select(*"wsen").distinct()
    asked = dealt(asked).select(*[F.col(x).alias("v" + x) for x in "wsen"], F.col("x0").alias("vx0"), F.col("y0").alias("vy0"), "cx", "cy")
    met = asked.join(dealt(boxes), ["cx", "cy"]).where("w <= ve AND e >= vw AND s <= vn AND n >= vs AND cx = greatest(x0, vx0) AND cy = greatest(y0, vy0)")
    view = ["vw", "vs", "ve", "vn"]
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy(*view).orderBy("index_pos"))).where(F.col("rank") <= (2 * most if refill else most))
    lists = first.groupBy(*view).agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", "id", "w", "s", "e", "n")))).alias("candidates"))
    ordered = views.join(lists, [F.col(x) == F.col("v" + x) for x in "wsen"], "left").select("session", "seq", "zoom", *"wsen", "candidates")
    tasks = int(views.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartition(tasks, "session").sortWithinPartitions("session", "seq")

    def step(shown: dict, v, candidates: list[dict]) -> dict:
        if v.zoom < least_zoom:
            return {}
        dx, dy = (v.e - v.w) * pad, (v.n - v.s) * pad
        shown = {i: b for i, b in shown.items() if b[0] <= v.e + dx and b[2] >= v.w - dx and b[1] <= v.n + dy and b[3] >= v.s - dy}
        room = most - len(shown)
        for c in candidates if refill else candidates[:most]:
            if refill and room <= 0:
                break
            if c["id"] not in shown:
                shown[c["id"]] = (c["w"], c["s"], c["e"], c["n"])
                room -= 1
        return shown

    def task(batches):
        import functools
        import json

        read = functools.lru_cache(1024)(json.loads)
        session, shown = None, {}
        for pdf in batches:
            out = []
            for v in pdf.itertuples():
                if v.session != session:
                    session, shown = v.session, {}
                shown = step(shown, v, read(v.candidates) if v.candidates else [])
                out += [(v.session, v.seq, i, at) for at, i in enumerate(shown, 1)]
            yield pd.DataFrame(out, columns=["session", "seq", "fire_id", "place"])

    kinds = dict(views.dtypes)
    return ordered.mapInPandas(task, f"session {kinds['session']}, seq {kinds['seq']}, fire_id string, place int")


def node_directions(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distance, bearing and compass point from a device to its target node: device, lat, lon and node_id, lat, lon."""
    to = nodes.select("device", "node_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    turn = geo.bearing("lat", "lon", "tlat", "tlon")
    return positions.join(to, "device").select(*positions.columns, "node_id", geo.local_m("lat", "lon", "tlat", "tlon").alias("dist_m"), geo.half_up(turn).alias("bearing_deg"), geo.compass(turn).alias("compass"))


def simplify_perimeters(fires: DataFrame, tolerance: float = 0.0004) -> DataFrame:
    """Rings with fewer vertices: those that keep every dropped vertex within the tolerance, first and last kept.

    A ring left with fewer than four vertices keeps all of its own. Each ring is one small Arrow row.
    """
    import numpy as np
    import pandas as pd

    def thin(x, y) -> list[int]:
        xy = np.column_stack([x, y])
        keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, v = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            length = np.hypot(*d)
            off = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / length if length else np.hypot(v[:, 0], v[:, 1])
            far = int(off.argmax())
            if off[far] > tolerance:
                keep.add(a + 1 + far)
                todo += [(a, a + 1 + far), (a + 1 + far, b)]
        return sorted(keep) if len(keep) >= 4 else list(range(len(xy)))

    def task(batches):
        for pdf in batches:
            kept = [thin(x, y) for x, y in zip(pdf["lons"], pdf["lats"], strict=True)]
            for c in ("lons", "lats"):
                pdf[c] = [np.asarray(v)[k] for v, k in zip(pdf[c], kept, strict=True)]
            yield pdf

    rings = fires.select("id", F.posexplode("geom").alias("poly", "rings")).select("id", "poly", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 0)
    each = lambda k: F.transform("points", lambda p: p[k])
    rings = rings.select("id", "poly", "ring", each("lon").alias("lons"), each("lat").alias("lats"))
    done = rings.mapInPandas(task, rings.schema)
    points = F.zip_with("lons", "lats", lambda x, y: F.struct(x.alias("lon"), y.alias("lat")))
    polys = done.groupBy("id", "poly").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", points.alias("p")))), lambda r: r["p"]).alias("rings"))
    return polys.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("poly", "rings"))), lambda r: r["rings"]).alias("geom"))
