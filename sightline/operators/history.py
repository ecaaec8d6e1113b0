"""Keyed history: sessions that break after a time to live, bounded event lists, recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.core import causal_order
from sightline.operators.ranges import previous, running

HORIZONS = (60, 3600)
MAX_EVENTS = 16
RECON_TTL = 3600
#: lane: (key columns, what is counted as distinct).
RECON = {
    "recon.h": (("initiator", "dport", "protocol"), {"hosts": ("target",)}),
    "recon.v": (("initiator", "target"), {"ports": ("dport",)}),
    "recon.2d": (("initiator",), {"hosts": ("target",), "ports": ("dport",), "pairs": ("target", "dport")}),
}


def in_order(rows: DataFrame, time: str = "us", identity: str = "obs_id") -> list[Column]:
    """Causal order of the rows; by source position too, if they have one."""
    return causal_order(time, "position" if "position" in rows.columns else None, identity)


def ttl_sessions(rows: DataFrame, keys: tuple[str, ...], ttl_us: int, time: str = "us", identity: str = "obs_id") -> DataFrame:
    """rows with session_no for each key: a gap of ttl or more starts a new session (equality breaks)."""
    w = Window.partitionBy(*keys).orderBy(*in_order(rows, time, identity))
    gap = F.when(F.col(time) - F.lag(time).over(w) >= ttl_us, 1).otherwise(0)
    return rows.withColumn("_break", gap).withColumn("session_no", F.sum("_break").over(w)).drop("_break")


def spread_sessions(rows: DataFrame, keys: tuple[str, ...], ttl_us: int) -> DataFrame:
    """ttl_sessions() with each key split by time over range partitions: the last time before a partition and its breaks so far are handed on."""
    rows = previous(rows, keys, ["us", "obs_id"], "us", "_before")
    rows = rows.withColumn("_break", F.when(F.col("us") - F.col("_before") >= ttl_us, 1).otherwise(0)).drop("_before")
    return running(rows, keys, [F.col("us"), F.col("obs_id")], session_no="_break").drop("_break", "_part")


def bounded_history(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], horizon_us: int, ttl_us: int, cap: int = MAX_EVENTS) -> DataFrame:
    """rows with history: the last `cap` events of the session up to the row that lie within the horizon, oldest first.

    dropped counts the events that the cap has pushed out so far; lower_bound says whether it has.
    """
    rows = ttl_sessions(rows, keys, ttl_us)
    order = Window.partitionBy(*keys, "session_no").orderBy(*in_order(rows))
    item = F.struct("us", "obs_id", *fields)
    recent = F.collect_list(item).over(order.rowsBetween(-(cap - 1), 0))
    pushed = F.when(F.lag("us", cap).over(order) >= F.col("us") - horizon_us, 1).otherwise(0)
    return (
        rows.withColumn("_recent", recent).withColumn("_pushed", pushed)
        .withColumn("dropped", F.sum("_pushed").over(order))
        .withColumn("history", F.filter("_recent", lambda x: x["us"] >= F.col("us") - horizon_us))
        .withColumn("truncated", F.col("dropped") > 0).drop("_recent", "_pushed")
    )


def state_set(history: str | Column, field: str) -> Column:
    """Sorted distinct states of a quality fact over a history."""
    return F.array_sort(F.array_distinct(F.transform(history, lambda x: x[field])))


def support_ids(identity: Column, history: str | Column) -> Column:
    """The current id first, then the others of the history, oldest first."""
    return F.array_distinct(F.concat(F.array(identity), F.transform(history, lambda x: x["obs_id"])))


def recon(rows: DataFrame, lane: str, horizons: tuple[int, ...] = HORIZONS, cap: int = MAX_EVENTS, ttl_s: int = RECON_TTL) -> DataFrame:
    """For each attempt and horizon: attempts and distinct hosts, ports or pairs among the retained history.

    The lower end of a horizon is closed; only rows that come before in causal order count, so peers at
    the same time that follow do not.
    """
    keys, counted = RECON[lane]
    fields = ("target", "dport", "quality")
    kept = bounded_history(rows, keys, fields, max(horizons) * 1_000_000, ttl_s * 1_000_000, cap)
    kept = kept.withColumn("horizon_s", F.explode(F.array(*map(F.lit, horizons))))
    inside = F.filter("history", lambda x: x["us"] >= F.col("us") - F.col("horizon_s").cast("long") * 1_000_000)
    kept = kept.withColumn("_inside", inside)

    def picked(names: tuple[str, ...]):
        return lambda x: F.struct(*(x[f].alias(f) for f in names))

    distinct = [F.size(F.array_distinct(F.transform("_inside", picked(c)))).alias(f"distinct_{n}") for n, c in counted.items()]
    return kept.select(
        F.lit(lane).alias("lane_id"), "obs_id", "us", "horizon_s", F.size("_inside").alias("attempts"), *distinct,
        F.size("history").alias("retained"), "dropped", "truncated",
        F.array_join(state_set("history", "quality"), ",").alias("quality_states"),
        F.array_contains(F.transform("history", lambda x: x["quality"]), "DEGRADED").alias("lower_bound"),
    )


def recurrence(flows: DataFrame, keys: tuple[str, ...], ttl_us: int, cap: int = 32, least: int = 3) -> DataFrame:
    """Communication recurrence over the last `cap` starts of a session.

    With fewer than `least` starts the row says how many are missing; else it has the count, span,
    intervals, their median, and the median absolute deviation from it.
    """
    rows = ttl_sessions(flows, keys, ttl_us)
    order = Window.partitionBy(*keys, "session_no").orderBy(*in_order(rows))
    frame = order.rowsBetween(-(cap - 1), 0)
    rows = rows.withColumn("_times", F.collect_list("us").over(frame)).withColumn("_ids", F.collect_list("obs_id").over(frame)).withColumn("version", F.row_number().over(order))
    n = F.size("_times")
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("_times", i + 1) - F.element_at("_times", i))
    enough = n >= least
    rows = rows.withColumn("_gaps", F.when(enough, gaps)).withColumn("_median", middle(F.col("_gaps")))
    mad = middle(F.transform("_gaps", lambda x: F.abs(x - F.col("_median"))))
    return rows.select(
        F.lit("c2.r1").alias("lane_id"), *keys, "obs_id", "us", n.alias("event_count"),
        F.when(enough, "REVIEW_FINDING").otherwise("INSUFFICIENT_EVIDENCE").alias("result_type"),
        F.when(~enough, least - n).alias("missing_events"),
        F.when(enough, F.element_at("_times", -1) - F.element_at("_times", 1)).alias("span_us"),
        F.when(enough, n - 1).alias("interval_count"),
        F.col("_median").alias("median_us"), F.when(enough, mad).alias("mad_us"),
        F.when(F.col("version") > 1, F.col("version") - 1).alias("state_version"),
        F.array_distinct(F.concat(F.array("obs_id"), "_ids")).alias("support"),
    )


def middle(values: Column) -> Column:
    """Median of an array: the middle value, or the mean of the two middle ones."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, low) + F.element_at(s, high)) / F.lit(2.0))
