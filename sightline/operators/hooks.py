"""Third-party mechanisms with state: hooks for rows, boundaries, expiry and quality gaps, run in batch and in streams alike.

A key's rows come in causal order. Before each row the boundary moves to its time: on_watermark may speak, and a state whose deadline is
reached expires. Gap rows that name a key stand in that key's order, before other rows of their time; what they do is the lane's policy:

* CONTINUE only marks: every row inside an open gap of the lane, whatever its key, carries quality_degraded.
* RESET forgets the key's state where a gap opens.
* REENTER_WARMUP forgets it too, and holds rows back until ready(state) holds again.
* ABSTAIN goes on stepping the state but holds the key's rows back until all its gaps are closed.
* DISABLE drops all of the lane's rows from the first opening on; closing a gap does not enable a lane again.

A gap without a key does no more than mark (and disable).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import machines

#: What a lane does with records that fall into an open quality gap.
POLICIES = ("CONTINUE", "RESET", "REENTER_WARMUP", "ABSTAIN", "DISABLE")
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Hooks:
    """What a mechanism does. States are values of its own, None before the first row; rows are tuples of `out`.

    process(state, row, context) and on_quality_gap(state, gap) give (state, rows); on_watermark(state, us) too; on_expire(state) gives rows.
    context has quality_degraded. deadline(state) is the time at which a state ends, or None. dump and load turn a state into JSON values and back.
    """

    keys: dict[str, str]
    fields: tuple[str, ...]
    out: str
    process: Callable
    deadline: Callable = staticmethod(lambda state: None)
    on_watermark: Callable | None = None
    on_expire: Callable | None = None
    on_quality_gap: Callable | None = None
    ready: Callable = staticmethod(lambda state: True)
    dump: Callable = staticmethod(lambda state: state)
    load: Callable = staticmethod(lambda state: state)

    @property
    def schema(self) -> str:
        return f"{self.out}, quality_degraded boolean"


def fresh() -> dict:
    """What is kept of a key beside its state: open gaps that make it abstain, whether it warms up, and the last boundary's mark."""
    return {"state": None, "gaps": [], "warming": False}


def stepper(hooks: Hooks, policy: str) -> Callable:
    """One row of a key: (kept, row) gives (kept, rows)."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")

    def step(kept: dict | None, r: dict) -> tuple[dict, list[tuple]]:
        kept, out, marked = kept or fresh(), [], bool(r["degraded_by_gap"])
        state = kept["state"]
        if state is not None and hooks.on_watermark:
            state, made = hooks.on_watermark(state, r["us"])
            out += made
        if state is not None:
            due = hooks.deadline(state)
            if due is not None and due <= r["us"]:
                out += hooks.on_expire(state) if hooks.on_expire else []
                state = None
        said = len(out)
        if r["kind"] == "ROW":
            state, made = hooks.process(state, r, {"quality_degraded": marked})
            out += made
            kept["warming"] = kept["warming"] and not hooks.ready(state)
        else:
            if hooks.on_quality_gap:
                state, made = hooks.on_quality_gap(state, {"gap_id": r["gap_id"], "us": r["us"], "open": r["kind"] == "GAP_OPEN"})
                out += made
            if r["kind"] == "GAP_OPEN" and policy in ("RESET", "REENTER_WARMUP"):
                kept["warming"] = kept["warming"] or (policy == "REENTER_WARMUP" and state is not None)
                state = None
            elif r["kind"] == "GAP_OPEN" and policy == "ABSTAIN" and r["gap_id"] not in kept["gaps"]:
                kept["gaps"] = [*kept["gaps"], r["gap_id"]]
            elif r["kind"] == "GAP_CLOSE":
                kept["gaps"] = [g for g in kept["gaps"] if g != r["gap_id"]]
        kept["state"] = state
        silent = bool(kept["gaps"]) or kept["warming"]
        # What the boundary said before the row is held back only if the key was silent before it, too.
        shown = out[:said] if not kept.get("silent") else []
        shown = shown + ([] if silent else out[said:])
        kept["silent"] = silent
        return kept, [(*x, marked) for x in shown]

    return step


def due_of(hooks: Hooks) -> Callable:
    """When what is kept of a key ends; a key that only waits for its gaps never does."""
    never = 2**62

    def due(kept: dict) -> int:
        at = None if kept["state"] is None else hooks.deadline(kept["state"])
        return never if at is None else at

    return due


def finisher(hooks: Hooks) -> Callable:
    def finish(kept: dict) -> list[tuple]:
        state, out = kept["state"], []
        if state is not None and hooks.on_watermark:
            state, out = hooks.on_watermark(state, hooks.deadline(state))
        if state is not None and hooks.on_expire:
            out = [*out, *hooks.on_expire(state)]
        return [] if kept.get("silent") else [(*x, False) for x in out]

    return finish


def open_spans(gaps: DataFrame) -> DataFrame:
    """Disjoint (from_us, to_us) in which some gap is open; to_us is the first moment after, NULL if a gap never closes."""
    ends = gaps.select("opened_us", F.coalesce(F.col("closed_us") + 1, F.lit(2**62)).alias("to"))
    order = Window.orderBy("opened_us", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_new", F.when(F.col("opened_us") > F.coalesce(before, F.lit(-(2**62))), 1).otherwise(0)).withColumn("_span", F.sum("_new").over(order))
    spans = ends.groupBy("_span").agg(F.min("opened_us").alias("from_us"), F.max("to").alias("to"))
    return spans.select("from_us", F.when(F.col("to") < 2**62, F.col("to")).alias("to_us"))


def mark_rows(rows: DataFrame, gaps: DataFrame | None, policy: str, last_us: int | None = None) -> DataFrame:
    """rows with degraded_by_gap: is any gap of the lane open at their time? Under DISABLE, rows from the first opening on are gone.

    rows may be a stream, gaps a table of one lane (gap_id, opened_us, closed_us). Its merged spans, cut into days, meet the rows in an
    equality join in which a row has one match at most. A stream has to say in last_us how far spans without an end are cut.
    """
    if gaps is None:
        return rows.withColumn("degraded_by_gap", F.lit(False))
    if policy == "DISABLE":
        first = gaps.agg(F.min("opened_us")).first()[0]
        before = F.col("us") < first if first is not None else F.lit(True)
        if rows.isStreaming and first is not None:
            # The dropped rows still move the watermark: one test that reads event_time stays above it.
            before = F.coalesce(F.col("event_time") < F.timestamp_micros(F.lit(first)), before)
        return rows.where(before).withColumn("degraded_by_gap", F.lit(False))
    if last_us is None:
        last_us = rows.agg(F.max("us")).first()[0] or 0
    spans = open_spans(gaps).where(F.col("from_us") <= last_us)
    day = lambda c: F.floor(c / DAY_US)
    spans = spans.select("from_us", "to_us", F.explode(F.sequence(day(F.col("from_us")), day(F.least(F.coalesce("to_us", F.lit(last_us)), F.lit(last_us))))).alias("_day"))
    rows = rows.withColumn("_day", day(F.col("us")))
    hit = (rows["_day"] == spans["_day"]) & (F.col("us") >= F.col("from_us")) & (F.col("to_us").isNull() | (F.col("us") < F.col("to_us")))
    return rows.join(spans, hit, "left").withColumn("degraded_by_gap", F.col("from_us").isNotNull()).drop("from_us", "to_us", "_day")


def with_gaps(rows: DataFrame, hooks: Hooks, gaps: DataFrame | None) -> DataFrame:
    """A mechanism's rows and, of the gaps that name a key, one row at their opening and one at their closing: kind, gap_id, turn.

    gaps: gap_id, opened_us, closed_us (NULL: still open), and the key's columns (NULL: the gap names no key).
    """
    position = F.col("position").cast("string") if "position" in rows.columns else F.lit(None).cast("string")
    shape = [*hooks.keys, "us", "obs_id", *(c for c in hooks.fields if c not in hooks.keys)]
    data = rows.select(*shape, position.alias("position"), F.lit("ROW").alias("kind"), F.lit(None).cast("string").alias("gap_id"), F.lit(1).alias("turn"))
    if gaps is None:
        return data
    types = dict(data.dtypes)
    out = data
    for kind, at in (("GAP_OPEN", "opened_us"), ("GAP_CLOSE", "closed_us")):
        named = gaps.where(F.col(at).isNotNull()).where(" AND ".join(f"{k} IS NOT NULL" for k in hooks.keys))
        own = [F.col(k).cast(types[k]).alias(k) for k in hooks.keys] + [F.lit(None).cast(types[c]).alias(c) for c in hooks.fields if c not in hooks.keys]
        out = out.unionByName(named.select(*own, F.col(at).alias("us"), F.concat_ws(":", F.lit(kind), "gap_id").alias("obs_id"), F.lit(None).cast("string").alias("position"), F.lit(kind).alias("kind"), "gap_id", F.lit(0).alias("turn")))
    return out


def run_hooks(rows: DataFrame, hooks: Hooks, policy: str = "CONTINUE", gaps: DataFrame | None = None, end_us: int | None = None) -> DataFrame:
    """A mechanism over a table of its rows (us, obs_id, keys, fields, and position if there is one). end_us: where the input ends, if states shall not outlive it."""
    ready = mark_rows(with_gaps(rows, hooks, gaps), gaps, policy)
    whole = F.col("position").rlike("^[0-9]+$")
    order = ("us", "turn", F.when(whole, 0).otherwise(1), F.col("position").try_cast("decimal(38,0)"), "position", "obs_id")
    names = [*hooks.keys, *dict.fromkeys(["us", "obs_id", *hooks.fields, "position", "kind", "gap_id", "turn", "degraded_by_gap"])]
    key_schema = ", ".join(f"{k} {t}" for k, t in hooks.keys.items())
    return machines.fold(ready.select(*dict.fromkeys(names)), tuple(hooks.keys), stepper(hooks, policy), finisher(hooks), hooks.schema, key_schema, end_us, order=order, due=due_of(hooks))
