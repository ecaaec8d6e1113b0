"""Third-party mechanisms, gap policies, side outputs and shown observations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.core import config_hash
from sightline.operators.hooks import POLICIES, Hooks, run_hooks
from sightline.operators.routing import LANES, Lane, fan_out

#: Bounds of a shown observation.
MAX_ROLES, MAX_FIELDS, MAX_CHARS = 16, 32, 200


@dataclass(frozen=True)
class Mechanism:
    """A lane with its measure, a function from the lane's records to drafts, or with hooks that keep state by key, and its gap policy."""

    lane: Lane
    measure: Callable[[DataFrame], DataFrame] | None = None
    parameters: dict = field(default_factory=dict)
    hooks: Hooks | None = None
    policy: str = "CONTINUE"


class Registry:
    """Mechanisms by lane id. A mechanism sees only records that its lane selects, and stamps its configuration's hash."""

    def __init__(self) -> None:
        self._known: dict[str, Mechanism] = {}

    def register(self, mechanism: Mechanism) -> None:
        if (mechanism.measure is None) == (mechanism.hooks is None):
            raise ValueError("a mechanism has either a measure or hooks")
        if mechanism.policy not in POLICIES:
            raise ValueError(f"unknown policy {mechanism.policy}")
        if mechanism.lane.lane_id in self._known or any(x.lane_id == mechanism.lane.lane_id for x in LANES):
            raise ValueError(f"lane {mechanism.lane.lane_id} is registered already")
        self._known[mechanism.lane.lane_id] = mechanism

    def run(self, records: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
        """Bag union of all mechanisms' drafts with lane_id and config_hash. gaps: as in hooks.with_gaps, with lane_id."""
        routed = fan_out(records, tuple(m.lane for m in self._known.values()))
        out = None
        for name, m in self._known.items():
            own = routed.where(F.array_contains("routes", name)).drop("routes")
            mine = None if gaps is None else gaps.where(F.col("lane_id") == name)
            drafts = m.measure(own) if m.hooks is None else run_hooks(own, m.hooks, m.policy, mine)
            drafts = drafts.withColumn("lane_id", F.lit(name)).withColumn("config_hash", F.lit(config_hash(m.parameters)))
            out = drafts if out is None else out.unionByName(drafts, allowMissingColumns=True)
        if out is None:
            raise ValueError("no mechanism is registered")
        return out


def apply_gap_policy(rows: DataFrame, policy: str) -> DataFrame:
    """rows (with gap_count, from gaps_at) under a policy: what is marked, broken, held back or dropped.

    CONTINUE marks; RESET and REENTER_WARMUP also break the keyed session where a gap begins (breaks), the latter with
    warm-up rows held back until the gap is over; ABSTAIN holds all rows in a gap back; DISABLE drops them.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    inside = F.col("gap_count") > 0
    out = rows.withColumn("quality_degraded", inside).withColumn("breaks", inside & F.lit(policy in ("RESET", "REENTER_WARMUP"))).withColumn("suppressed", inside & F.lit(policy in ("ABSTAIN", "REENTER_WARMUP")))
    return out.where(~inside) if policy == "DISABLE" else out


def sessions_with_gaps(rows: DataFrame, keys: tuple[str, ...], ttl_us: int) -> DataFrame:
    """session_no as in history.ttl_sessions, with one more break where a row enters a gap that resets."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("us", "obs_id")
    enters = F.col("breaks") & ~F.coalesce(F.lag("breaks").over(w), F.lit(False))
    gap = F.coalesce(F.col("us") - F.lag("us").over(w) >= ttl_us, F.lit(False))
    return rows.withColumn("_break", (gap | enters).cast("int")).withColumn("session_no", F.sum("_break").over(w)).drop("_break")


def write_side_outputs(batch: DataFrame, control_path: str, gap_path: str, epoch: int) -> None:
    """Control events and quality gaps of one micro-batch; for foreachBatch, beside the result sink.

    Each epoch has its own folder, so a batch that is repeated replaces what it wrote before.
    """
    batch.where("kind <> 'QUALITY_GAP'").select("kind", "lane_id", "obs_id", "us", "detail").write.mode("overwrite").parquet(f"{control_path}/epoch={epoch}")
    batch.where("kind = 'QUALITY_GAP'").select("lane_id", "obs_id", F.col("us").alias("opened_us"), "detail").write.mode("overwrite").parquet(f"{gap_path}/epoch={epoch}")


def observation_summary(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A bounded view of observations: at most 16 roles, 32 of the allowed fields, 200 characters of each value."""

    def short(c: Column) -> Column:
        return F.when(F.length(c) > MAX_CHARS, F.concat(F.substring(c, 1, MAX_CHARS), F.lit("…"))).otherwise(c)

    roles = F.slice(F.array_sort(F.transform("roles", lambda r: F.struct(r["role"].alias("role"), short(r["identifier"]).alias("identifier")))), 1, MAX_ROLES)
    shown = F.slice(F.filter(F.array(*(F.struct(F.lit(f).alias("field"), short(F.col(f).cast("string")).alias("value")) for f in sorted(fields))), lambda x: x["value"].isNotNull()), 1, MAX_FIELDS)
    return rows.select("obs_id", roles.alias("roles"), shown.alias("facts"))


def change_feed(results: DataFrame, after: tuple[int, str] | None, limit: int) -> DataFrame:
    """Rows after a consumer's cursor in order; a consumer that has fallen behind starts again from None."""
    out = results
    if after is not None:
        at = F.struct(F.lit(after[0]).cast("long").alias("created_us"), F.lit(after[1]).alias("result_id"))
        out = out.where(F.struct("created_us", "result_id") > at)
    return out.orderBy("created_us", "result_id").limit(limit)


def search_views(views: DataFrame, family: str | None, text: str) -> DataFrame:
    """Family views by family and text in their ids or sources, newest end first."""
    out = views if family is None else views.where(F.col("family") == family)
    hay = F.lower(F.concat_ws(" ", "view_id", "family", "result_ids", "source_ids"))
    return out.where(hay.contains(text.lower())).orderBy(F.desc("end_us"), "view_id")
