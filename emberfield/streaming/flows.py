"""Streams of measurements, decisions and positions. Each has a batch twin on the same transformation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.survey import authorize_updates, validate_measurements
from ..sources.keyed import delete, merge_batch


def current_from_log(log: DataFrame, order: tuple[str, ...] = ("batch_id", "arrived")) -> DataFrame:
    """The latest valid row of each uuid. Retries and late rows give the same table in whatever order they come."""
    cols = [c for c in log.columns if c not in ("uuid", *order)]
    return log.groupBy("uuid").agg(F.max(F.struct(*order, F.struct(*cols).alias("v"))).alias("m")).select("uuid", *[F.col(f"m.v.{c}").alias(c) for c in cols])


def ingest_measurements(arrivals: DataFrame, log_path: str, rejected_path: str, checkpoint: str):
    """A stream of arrivals into an append-only log, and rows that break a rule into another.

    Each micro-batch overwrites its own folder, so a replayed batch leaves no double. No watermark: late rows are never
    dropped, and the state is the log itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_measurements(batch).persist()
        checked.where("valid").drop("valid", "failed", "odd").write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        checked.where("NOT valid").write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        checked.unpersist()

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def judged_decisions(decisions: DataFrame, measurements: DataFrame, admins: DataFrame) -> DataFrame:
    """T5: decisions (uuid, decision, reviewer, ts) with verdict: accepted, refused, or waiting while no measurement has the uuid."""
    asked = decisions.select("uuid", F.col("reviewer").alias("editor_uid"), "decision", "ts", F.lit("update").alias("op"))
    owner = measurements.select("uuid", F.col("user_id").alias("new_user_id"), F.lit(True).alias("known"))
    checked = authorize_updates(asked.join(owner, "uuid", "left"), measurements, admins)
    verdict = F.when(F.col("known").isNull(), "waiting").when(F.col("accepted"), "accepted").otherwise("refused")
    return checked.select("uuid", "decision", F.col("editor_uid").alias("reviewer"), "ts", verdict.alias("verdict"))


def authorized_decisions(decisions: DataFrame, measurements: DataFrame, admins: DataFrame) -> DataFrame:
    """T5: the decisions (uuid, decision, reviewer, ts) of reviewers who may take them."""
    return judged_decisions(decisions, measurements, admins).where("verdict = 'accepted'").drop("verdict")


def review_decisions(decisions: DataFrame, measurements: DataFrame, admins: DataFrame) -> DataFrame:
    """T5: measurements with the last authorised decision of each applied."""
    last = authorized_decisions(decisions, measurements, admins).groupBy("uuid").agg(F.max(F.struct("ts", "reviewer", "decision")).alias("d"))
    waits = F.col("status") == "pending_review"
    out = measurements.join(last, "uuid", "left")
    return out.withColumn("reviewed_at", F.when(waits, F.col("d.ts"))).withColumn("reviewed_by", F.when(waits, F.col("d.reviewer"))).withColumn("status", F.when(waits & F.col("d").isNotNull(), F.col("d.decision")).otherwise(F.col("status"))).drop("d")


def stream_decisions(decisions: DataFrame, measurements: Callable[[], DataFrame], admins: Callable[[], DataFrame], path: str, checkpoint: str):
    """T5 as a stream: authorised decisions are logged by batch; review_decisions over the log gives the table.

    Both tables are asked for in each batch, so rows that come later count. Under `path` are log, refused (the dead letters) and
    waiting: decisions whose measurement is not there yet are judged again with each later batch. A batch reads what waited after the one
    before it and overwrites its own folders, so a replayed batch leaves no double.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = batch.select("uuid", "decision", "reviewer", "ts")
        if batch_id:
            asked = asked.unionByName(spark.read.schema(asked.schema).parquet(f"{path}/waiting/batch_id={batch_id - 1}"))
        judged = judged_decisions(asked, measurements(), admins()).persist()
        for verdict, folder in (("accepted", "log"), ("refused", "refused"), ("waiting", "waiting")):
            judged.where(F.col("verdict") == verdict).drop("verdict").write.mode("overwrite").parquet(f"{path}/{folder}/batch_id={batch_id}")
        judged.unpersist()
        delete(spark, f"{path}/waiting/batch_id={batch_id - 2}")

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_fix(fixes: DataFrame) -> DataFrame:
    """T4: each device's fix with the highest sequence number, for a table or, in update mode, a stream."""
    return fixes.groupBy("device").agg(F.max_by(F.struct("seq", "ts", "lat", "lon"), "seq").alias("f")).select("device", "f.*")


def stream_latest_fix(fixes: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """T4 as a stream: each batch's latest fixes are merged by device into the keyed table at `path`, in whatever order they come."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(latest_fix(batch), path, batch_id, ("device",), ("seq",), buckets)

    return fixes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)


def stream_arrivals(fixes: DataFrame, targets: Callable[[], DataFrame], path: str, checkpoint: str, within_m: float = 5.0, buckets: int = 64):
    """T3 as a stream: arrivals are merged by all their columns into the keyed table at `path`, so a replay gives no double. Targets are asked
    for in each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(arrivals(batch, targets(), within_m), path, batch_id, ("device", "seq", "node_id", "dist_m"), (), buckets)

    return fixes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)


def stream_measurements(arriving: DataFrame, path: str, rejected_path: str, checkpoint: str, buckets: int = 64):
    """T1 into a keyed table: valid rows are merged by uuid, the later `arrived` wins; rows that break a rule go to another log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_measurements(batch).persist()
        merge_batch(checked.where("valid").drop("valid", "failed", "odd"), path, batch_id, ("uuid",), ("arrived",), buckets)
        checked.where("NOT valid").write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        checked.unpersist()

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def arrivals(fixes: DataFrame, targets: DataFrame, within_m: float = 5.0) -> DataFrame:
    """Fixes within reach of their device's target; a stream of fixes joins a table of targets."""
    to = targets.select("device", "node_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    met = fixes.join(to, "device").withColumn("dist_m", geo.local_m("lat", "lon", "tlat", "tlon"))
    return met.where(F.col("dist_m") <= within_m).select("device", "seq", "node_id", "dist_m")


def _moved(anchor: tuple[float, float], lat: float, lon: float) -> tuple[float, float]:
    """(metres, degrees from north) from an anchor, both as on the plane at its latitude."""
    import math

    dy = (lat - anchor[0]) * geo.METRES_PER_DEGREE
    dx = (lon - anchor[1]) * geo.METRES_PER_DEGREE * math.cos(math.radians(anchor[0]))
    return math.hypot(dx, dy), (math.degrees(math.atan2(dx, dy)) + 360) % 360


HEADING = "device string, seq long, bearing_deg int"


def _fold(device: str, anchor, rows: pd.DataFrame, least_m: float) -> tuple[list, tuple | None]:
    out = []
    for seq, lat, lon in zip(rows["seq"], rows["lat"], rows["lon"], strict=True):
        if anchor is None:
            anchor = (lat, lon)
            continue
        metres, degrees = _moved(anchor, lat, lon)
        if metres > least_m:
            out.append((device, int(seq), int(degrees + 0.5)))
            anchor = (lat, lon)
    return out, anchor


def track_heading(fixes: DataFrame, least_m: float = 4.0) -> DataFrame:
    """T2 over a table: a bearing whenever a device is more than least_m from its anchor, which then moves there.

    A fold over a device's fixes in order. Fixes are sorted by Spark and reach Python in Arrow batches, so a device's
    history is never held whole: the anchor is all that goes from one batch to the next.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, anchor = None, None
        for pdf in batches:
            out = []
            for key, rows in pdf.groupby("device", sort=False):
                if key != device:
                    device, anchor = key, None
                found, anchor = _fold(key, anchor, rows, least_m)
                out += found
            yield pd.DataFrame(out, columns=["device", "seq", "bearing_deg"])

    ordered = fixes.select("device", "seq", "lat", "lon").repartition("device").sortWithinPartitions("device", "seq")
    return ordered.mapInPandas(task, HEADING)


def stream_heading(fixes: DataFrame, least_m: float = 4.0) -> DataFrame:
    """T2 over a stream: the anchor is the state of a device. Fixes are put in order within a micro-batch only."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Anchor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("anchor", "lat double, lon double")

        def handleInputRows(self, key, rows, timerValues):
            frame = pd.concat(list(rows)).sort_values("seq")
            anchor = tuple(self.state.get()) if self.state.exists() else None
            out, anchor = _fold(key[0], anchor, frame, least_m)
            if anchor:
                self.state.update(anchor)
            yield pd.DataFrame(out, columns=["device", "seq", "bearing_deg"])

        def close(self) -> None:
            pass

    return fixes.groupBy("device").transformWithStateInPandas(Anchor(), HEADING, "append", "none")
