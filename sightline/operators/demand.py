"""Traffic demand in tumbling event-time windows: one aggregation, six lanes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.measures import gaps_at
from sightline.operators.routing import LANES as ROUTED

KEYS = ("target", "service", "direction")
CAP = 256


@dataclass(frozen=True)
class WindowLane:
    """What a window lane admits and what it measures beside the base measures."""

    lane: str
    admit: str
    keys: tuple[str, ...] = ()
    distinct: str | None = None


#: What the lane's own condition admits is said once, by routing: base rule, protocol, direction and all.
_ADMITS = {x.lane_id: x.predicate for x in ROUTED}
LANES = {
    name: WindowLane(f"ddos.{name}", _ADMITS[f"ddos.{name}"], keys, distinct)
    for name, keys, distinct in (
        ("udp_demand", (), None), ("reflection_victim", ("protocol_context",), "src"), ("source_diversity", (), "src"), ("icmp_demand", (), None), ("fragment_demand", ("protocol",), None), ("connection_churn", (), "flow_tuple"),
    )
}
#: Order of quality facts from best to worst.
QUALITY = ("CLEAR", "UNKNOWN", "DEGRADED")


def worst_quality(quality: Column) -> Column:
    """DEGRADED over UNKNOWN over CLEAR, for an aggregation."""
    rank = F.max(F.when(quality == "DEGRADED", 2).when(quality == "CLEAR", 0).otherwise(1))
    return F.element_at(F.array(*map(F.lit, QUALITY)), rank + 1)


def demand_window(packets: DataFrame, lane: WindowLane, width_us: int, cap: int = CAP) -> DataFrame:
    """Base measures for each key and window of the packets that the lane admits.

    packets: us, obs_id, target, service, direction, protocol, bytes, quality, reverse, and what `lane` names. A byte
    sum with an unknown length is NULL; what is known goes to observed_bytes.
    """
    start = F.floor(F.col("us") / width_us).cast("long") * width_us
    first = F.struct("us", "obs_id")
    known = F.count("bytes")
    aggregates = [
        F.count("*").alias("packet_count"), F.sum("bytes").alias("observed_bytes"), known.alias("known_lengths"),
        (F.count("*") - known).alias("missing_lengths"), F.min("bytes").alias("_min"), F.max("bytes").alias("_max"),
        F.array_join(F.array_sort(F.collect_set(F.col("protocol").cast("string"))), ",").alias("protocols"),
        F.min(first).alias("_first"), F.max(first).alias("_last"),
        F.min_by("reverse", F.struct("us", "obs_id", "reverse")).alias("reverse"), worst_quality(F.col("quality")).alias("quality"),
    ]
    if lane.distinct:
        aggregates.append(F.count_distinct(lane.distinct).alias("_distinct"))
    keys = [*KEYS, *lane.keys]
    return described(packets.where(F.expr(lane.admit)).groupBy(*keys, start.alias("window_start")).agg(*aggregates), lane, width_us, cap)


def all_windows(packets: DataFrame, lanes: tuple[WindowLane, ...], width_us: int, cap: int = CAP) -> DataFrame:
    """What results need of all lanes' windows: their number of packets, first and last id and result type, as demand_window() gives them.

    Lanes share target, service, direction and start, so a packet is shuffled once by these, whatever lanes admit it; all
    aggregations, also of distinct values, then stay inside partitions.
    """
    start = F.floor(F.col("us") / width_us).cast("long") * width_us
    needed = dict.fromkeys(["us", "obs_id", *KEYS, "quality", *(k for x in lanes for k in x.keys), *(x.distinct for x in lanes if x.distinct)])
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    own = [F.when(F.col(f"_in{i}"), F.struct(F.lit(x.lane).alias("lane_id"), F.array(*map(text, x.keys)).cast("array<string>").alias("_more"), text(x.distinct).alias("_counted"))) for i, x in enumerate(lanes)]
    rows = packets.select(*needed, start.alias("window_start"), *(F.coalesce(F.expr(x.admit), F.lit(False)).alias(f"_in{i}") for i, x in enumerate(lanes)))
    any_of = lambda at: " OR ".join(f"_in{i}" for i in at)
    # What only some lanes read is shuffled for their packets only.
    uses = {c: [i for i, x in enumerate(lanes) if c in (*x.keys, x.distinct)] for c in needed}
    rows = rows.where(any_of(range(len(lanes)))).withColumns({c: F.when(F.expr(any_of(at)), F.col(c)) for c, at in uses.items() if at and c not in ("us", "obs_id", "quality", *KEYS)})
    rows = rows.repartition(*KEYS, "window_start")
    rows = rows.select("us", "obs_id", *KEYS, "quality", "window_start", F.explode(F.array(*own)).alias("_lane")).where("_lane IS NOT NULL").select("*", "_lane.*")
    out = rows.groupBy("lane_id", *KEYS, "_more", "window_start").agg(
        F.count("*").alias("packet_count"), F.min(F.struct("us", "obs_id")).alias("_first"), F.max(F.struct("us", "obs_id")).alias("_last"), worst_quality(F.col("quality")).alias("_quality"), F.count_distinct("_counted").alias("_distinct"))
    degraded = (F.col("_quality") == "DEGRADED") | (F.col("_distinct") > cap)
    return out.select("lane_id", *KEYS, "window_start", (F.col("window_start") + width_us).alias("window_end"), "packet_count", F.when(degraded, "QUALITY_DEGRADED").otherwise("REVIEW_FINDING").alias("result_type"),
                      F.col("_first.obs_id").alias("first_id"), F.col("_last.obs_id").alias("last_id"))


def described(out: DataFrame, lane: WindowLane, width_us: int, cap: int = CAP) -> DataFrame:
    """The lane's columns from what was counted in each window, in batch or in a stream."""
    keys = [*KEYS, *lane.keys]
    complete = F.col("missing_lengths") == 0
    columns = [
        F.lit(lane.lane).alias("lane_id"), *keys, "window_start", (F.col("window_start") + width_us).alias("window_end"),
        "packet_count", "observed_bytes", "known_lengths", "missing_lengths",
        F.when(complete, F.col("observed_bytes")).alias("byte_count"),
        F.when(complete, F.round(F.col("observed_bytes") / F.col("known_lengths"), 6)).alias("mean_bytes"),
        F.when(complete, F.col("_min")).alias("min_bytes"), F.when(complete, F.col("_max")).alias("max_bytes"), "protocols",
        F.col("_first.obs_id").alias("first_id"), F.col("_last.obs_id").alias("last_id"),
        F.col("_first.us").alias("first_us"), F.col("_last.us").alias("last_us"), "reverse", "quality",
        (F.col("quality") == "DEGRADED").alias("lower_bound"),
    ]
    full = F.lit(False)
    if lane.distinct:
        full = F.col("_distinct") > cap
        columns += [F.least("_distinct", F.lit(cap)).alias("distinct_count"), full.alias("capacity_reached")]
    degraded = (F.col("quality") == "DEGRADED") | full
    columns.append(F.when(degraded, "QUALITY_DEGRADED").otherwise("REVIEW_FINDING").alias("result_type"))
    columns.append(F.concat_ws(
        ",", F.when(~complete, "packet_length"), F.when(degraded, "complete_coverage"),
        F.when(full, "further_sources" if lane.distinct == "src" else "further_tuples"),
    ).alias("missing_evidence"))
    return out.select(*columns)


def degrade_in_gaps(windows: DataFrame, gaps: DataFrame) -> DataFrame:
    """windows with QUALITY_DEGRADED for those that close while a quality gap of their lane is open.

    gaps: lane_id, gap_id, opened_us, closed_us (NULL: still open). Only distinct lanes and ends meet the gaps.
    """
    ends = windows.select("lane_id", F.col("window_end").alias("us"), F.col("window_end").cast("string").alias("obs_id")).distinct()
    open_then = gaps_at(ends, gaps).where("gap_count > 0").select("lane_id", F.col("us").alias("window_end"), F.lit(True).alias("_gap"))
    out, hit = windows.join(open_then, ["lane_id", "window_end"], "left"), F.coalesce("_gap", F.lit(False))
    covered = F.when(F.col("missing_evidence").contains("complete_coverage"), F.col("missing_evidence")).otherwise(
        F.concat_ws(",", F.nullif("missing_evidence", F.lit("")), F.lit("complete_coverage")))
    return out.withColumns({
        "result_type": F.when(hit, "QUALITY_DEGRADED").otherwise(F.col("result_type")), "lower_bound": F.col("lower_bound") | hit,
        "missing_evidence": F.when(hit, covered).otherwise(F.col("missing_evidence")),
    }).drop("_gap")


def closed_only(windows: DataFrame, records: DataFrame) -> DataFrame:
    """Windows that the end of input closes: those that end by one microsecond after the last record of any type."""
    end = records.agg((F.max("us") + 1).alias("_end"))
    return windows.join(F.broadcast(end), F.col("window_end") <= F.col("_end")).drop("_end")


def closing_boundary(windows: DataFrame, records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """created_us of closed windows: the first record time at or after their end, else the end of input if that is late enough.

    by: columns of windows and records that tell inputs apart, each with times and an end of its own.

    An as-of join over distinct ends and distinct times: both are sorted together and each end takes the next
    time. Days split the sort: each day gets the first time of any later day as its fallback.
    """
    from pyspark.sql import Window

    day = 86_400_000_000
    times = records.select(*by, "us").distinct().withColumn("t", F.col("us"))
    ends = windows.select(*by, F.col("window_end").alias("us")).distinct().withColumn("t", F.lit(None).cast("long"))
    both = times.unionByName(ends).withColumn("day", F.floor(F.col("us") / day))
    inside = Window.partitionBy(*by, "day").orderBy("us", F.col("t").desc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy(*by).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy(*by, "day").agg(F.min("t").alias("first")).withColumn("after", F.min("first").over(later)).select(*by, "day", "after")
    end = records.groupBy(*by).agg((F.max("us") + 1).alias("_end"))
    found = both.withColumn("next", F.first("t", ignorenulls=True).over(inside)).where("t is null").join(days, [*by, "day"])
    found = (
        (found.join(end, list(by)) if by else found.join(F.broadcast(end)))
        .select(*by, F.col("us").alias("window_end"), F.coalesce("next", "after", F.when(F.col("_end") >= F.col("us"), F.col("_end"))).alias("created_us"))
    )
    return windows.join(found.where("created_us is not null"), [*by, "window_end"])
