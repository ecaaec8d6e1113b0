"""Demand windows, late rows and appends as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.operators.demand import CAP, KEYS, QUALITY, WindowLane, described, worst_quality
from sightline.operators.hooks import Hooks
from sightline.streaming.stateful import hooks_stream


def demand_stream(packets: DataFrame, lane: WindowLane, width: str = "1 second", delay: str = "0 seconds") -> DataFrame:
    """Closed windows of a stream, each once (append mode): counts and sums for each key.

    packets needs event_time (timestamp). Windows are sent when the watermark passes their end, so with a delay of
    at least the real disorder the rows equal the batch lane's closed windows.
    """
    w = packets.where(F.expr(lane.admit)).withWatermark("event_time", delay)
    t = w.groupBy(F.window("event_time", width), *KEYS, *lane.keys).agg(
        F.count("*").alias("packet_count"), F.sum("bytes").alias("observed_bytes"), F.count("bytes").alias("known_lengths"), worst_quality(F.col("quality")).alias("quality"))
    return t.select(
        F.lit(lane.lane).alias("lane_id"), *KEYS, *lane.keys, F.unix_micros("window.start").alias("window_start"), F.unix_micros("window.end").alias("window_end"), "packet_count", "observed_bytes",
        (F.col("packet_count") - F.col("known_lengths")).alias("missing_lengths"), F.when(F.col("known_lengths") == F.col("packet_count"), F.col("observed_bytes")).alias("byte_count"), "quality")


def window_hooks(lane: WindowLane, width_us: int, cap: int = CAP) -> Hooks:
    """A window lane with all its measures as a mechanism: one state a key and window, which ends with the window and then speaks once.

    What is told apart (sources or tuples, and protocols) is bounded: a set of cap + 1 values says that the cap is reached.
    """
    keys = {**dict.fromkeys(KEYS, "string"), **{k: "int" if k == "protocol" else "string" for k in lane.keys}, "window_start": "long"}
    rank = {q: k for k, q in enumerate(QUALITY)}
    least = lambda a, b: b if a is None else a if b is None else min(a, b)

    def process(s: dict | None, r: dict, context: dict) -> tuple[dict, list]:
        first = [r["us"], r["obs_id"]]
        s = s or {"at": r["window_start"], "n": 0, "sum": None, "known": 0, "min": None, "max": None, "protocols": [], "first": first, "reverse": r["reverse"], "quality": 0, "seen": []}
        size, quality = r["bytes"], rank.get(r["quality"], 1)
        size = None if size is None or size != size else int(size)
        s = {**s, "n": s["n"] + 1, "last": first, "quality": max(s["quality"], quality), "min": least(s["min"], size)}
        if size is not None:
            s |= {"known": s["known"] + 1, "sum": (s["sum"] or 0) + size, "max": size if s["max"] is None else max(s["max"], size)}
        if r["protocol"] is not None and int(r["protocol"]) not in s["protocols"]:
            s["protocols"] = [*s["protocols"], int(r["protocol"])]
        value = r.get(lane.distinct) if lane.distinct else None
        if value is not None and len(s["seen"]) <= cap and value not in s["seen"]:
            s["seen"] = [*s["seen"], value]
        return s, []

    def closed(s: dict) -> list[tuple]:
        protocols = ",".join(sorted(map(str, s["protocols"])))
        return [(s["n"], s["sum"], s["known"], s["min"], s["max"], protocols, *s["first"], *s["last"], s["reverse"], QUALITY[s["quality"]], len(s["seen"]))]

    fields = tuple(dict.fromkeys(c for c in ("bytes", "protocol", "quality", "reverse", lane.distinct) if c and c not in keys))
    out = "packet_count long, observed_bytes long, known_lengths long, low long, high long, protocols string, first_us long, first_obs string, last_us long, last_obs string, reverse string, quality string, seen long"
    return Hooks(keys, fields, out, process, lambda s: s["at"] + width_us, on_expire=closed)


def windows_of(packets: DataFrame, lane: WindowLane, width_us: int, cap: int = CAP, policy: str = "CONTINUE", gaps: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """demand_window() over a stream, row for row: each window once, when the watermark has passed its end.

    packets: us, event_time, and what the lane reads. gaps: declared gaps of the lane; those name no key here, so they mark or disable.
    """
    hooks = window_hooks(lane, width_us, cap)
    # Rows that the lane does not admit move the watermark too: one test that reads event_time stays above it.
    admitted = F.when(F.col("event_time").isNotNull(), F.coalesce(F.expr(lane.admit), F.lit(False))).otherwise(False)
    rows = packets.withWatermark("event_time", delay).where(admitted).withColumn("window_start", F.floor(F.col("us") / width_us).cast("long") * width_us)
    rows = rows.withColumns({"kind": F.lit("ROW"), "gap_id": F.lit(None).cast("string"), "turn": F.lit(1), "position": F.col("position").cast("string") if "position" in rows.columns else F.lit(None).cast("string")})
    rows = rows.withColumns({k: F.col(k).cast(t) for k, t in hooks.keys.items()})
    found = hooks_stream(rows, hooks, policy, gaps, None)
    none = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c))
    raw = found.select(
        *hooks.keys, "packet_count", none("observed_bytes").alias("observed_bytes"), "known_lengths", (F.col("packet_count") - F.col("known_lengths")).alias("missing_lengths"), F.col("low").alias("_min"), F.col("high").alias("_max"), "protocols",
        F.struct(F.col("first_us").alias("us"), F.col("first_obs").alias("obs_id")).alias("_first"), F.struct(F.col("last_us").alias("us"), F.col("last_obs").alias("obs_id")).alias("_last"), "reverse", "quality", F.col("seen").alias("_distinct"),
    )
    return described(raw, lane, width_us, cap)


class Boundaries:
    """An explicit boundary for each lane: it only moves forward, staying where it is changes nothing, and going back is an error.

    Kept as one small file a step in a folder that outlives the process, so a restart goes on from what was reached; a step is written
    before its rows are, and the same step may be repeated.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store
        self.known: dict[str, int] = {}
        self.steps = 0
        try:
            rows = spark.read.schema("step long, lane_id string, boundary_us long").parquet(store).groupBy("lane_id").agg(F.max("boundary_us").alias("us"), F.max("step").alias("step")).collect()
        except AnalysisException:
            rows = []
        for r in rows:
            self.known[r["lane_id"]], self.steps = r["us"], max(self.steps, r["step"])

    def advance(self, lane_id: str, us: int) -> bool:
        """Moves a lane's boundary; True if it moved."""
        now = self.known.get(lane_id)
        if now is not None and us < now:
            raise ValueError(f"the boundary of {lane_id} cannot go back from {now} to {us}")
        if us == now:
            return False
        self.steps += 1
        self.spark.createDataFrame([(self.steps, lane_id, us)], "step long, lane_id string, boundary_us long").coalesce(1).write.mode("append").parquet(self.store)
        self.known[lane_id] = us
        return True

    def split(self, batch: DataFrame, lane_id: str) -> tuple[DataFrame, DataFrame]:
        """(on time, late) rows of a lane's batch by its boundary; equality is on time."""
        return split_late(batch, self.known.get(lane_id))


def split_late(batch: DataFrame, boundary_us: int | None) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows lie before the boundary; equality is on time."""
    if boundary_us is None:
        return batch, batch.where("1 = 0").withColumn("watermark_us", F.lit(None).cast("long"))
    late = batch.where(F.col("us") < boundary_us).withColumn("watermark_us", F.lit(boundary_us).cast("long")).withColumn("kind", F.lit("LATE_EVENT_OBSERVED"))
    return batch.where(F.col("us") >= boundary_us), late


class LateSplitter:
    """foreachBatch handler: late rows to one sink, the others to another, by the greatest time of all earlier batches.

    What each batch's times reached is kept by its epoch: as a table under `store`, which survives a restart, or in memory without one.
    A repeated batch finds the boundary that it had the first time, so it is split the same way.
    """

    def __init__(self, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], store: str | None = None):
        self.on_time, self.late, self.store, self.tops = on_time, late, store, {}

    def boundary(self, batch: DataFrame, epoch: int) -> int | None:
        if self.store is None:
            return max((top for e, top in self.tops.items() if e < epoch), default=None)
        # A file of this epoch at least stands there before the first read, so the folder always has a schema.
        batch.sparkSession.createDataFrame([(epoch, None)], "epoch long, top long").coalesce(1).write.mode("overwrite").parquet(f"{self.store}/batch={epoch}")
        return batch.sparkSession.read.schema("epoch long, top long").parquet(self.store).where(F.col("epoch") < epoch).agg(F.max("top")).first()[0]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good, late = split_late(batch, self.boundary(batch, epoch))
        self.on_time(good, epoch)
        self.late(late, epoch)
        top = batch.agg(F.max("us").alias("top"))
        if self.store is None:
            found = top.first()[0]
            if found is not None:
                self.tops[epoch] = found
        else:
            top.select(F.lit(epoch).cast("long").alias("epoch"), "top").coalesce(1).write.mode("overwrite").parquet(f"{self.store}/batch={epoch}")
        batch.unpersist()


def append_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Results of a stream into the content-addressed table, each id once, also when a batch is repeated."""
    from sightline.operators.results import append_results

    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: append_results(batch, path)).trigger(availableNow=True).start()
