"""Keyed lanes as streams: rows wait until the watermark passes them and are then stepped in causal order.

A key's rows lie in map state by the millisecond that releases them, so a timer reads only what the watermark has passed
and the answer does not depend on the order of arrival. State is bounded as in batch (an attempt, 16 or 32 events) and ends by
timer. The step functions are those of the batch operators, or give the same rows as their windows (history lanes).
All streams need the RocksDB state store and an `event_time` column beside `us`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.functions.deploy import ship
from sightline.operators import machines
from sightline.operators.hooks import Hooks, due_of, finisher, mark_rows, stepper
from sightline.streaming import steps

TCP_TTL_US = 3_600_000_000


@dataclass(frozen=True)
class StreamLane:
    """step(state, row) gives the next state and output rows; deadline(state) says when its time is over, and
    finish(state) what is then left to say. dump and load turn a state into JSON values and back."""

    keys: tuple[str, ...]
    key_schema: str
    fields: tuple[str, ...]
    out_schema: str
    step: Callable
    deadline: Callable
    finish: Callable | None = None
    dump: Callable = staticmethod(lambda s: s)
    load: Callable = staticmethod(lambda s: s)


def causal_key(r: dict) -> tuple:
    """Order of a key's rows: time, gap rows before others, source position (whole numbers first and by value), id."""
    p = r.get("position")
    whole = p is not None and p.isascii() and p.isdigit()
    return r["us"], r.get("turn", 1), not whole, int(p) if whole else 0, p or "", r["obs_id"]


class KeyedOrder(StatefulProcessor):
    """Holds, orders, steps and expires one lane's keys."""

    def __init__(self, lane: StreamLane) -> None:
        self.lane = lane
        self.columns = [*lane.keys, *(c.split()[0] for c in lane.out_schema.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string")
        self.waiting = handle.getMapState("waiting", "due long", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[dict]] = {}
        for df in rows:
            for r in df[["us", "obs_id", *self.lane.fields]].to_dict("records"):
                body = {c: v.tolist() if hasattr(v, "tolist") else v for c, v in r.items()}
                new.setdefault(body["us"] // 1000 + 1, []).append(body)
        for due, bodies in new.items():
            if self.waiting.containsKey((due,)):
                bodies = json.loads(self.waiting.getValue((due,))[0]) + bodies
            self.waiting.updateValue((due,), (json.dumps(bodies),))
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Steps all that the watermark has passed, then expires the state if its time is over too.

        The watermark decides, not the one timer: a deadline that a step sets may have passed already, and then no later batch need come.
        """
        due, now, out, lane = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), [], self.lane
        at, state = json.loads(self.state.get()[0]) if self.state.exists() else (None, None)
        if not self.waiting.containsKey((due,)) and (at is None or at > now):
            return
        state = None if state is None else lane.load(state)
        for passed in sorted(k[0] for k in self.waiting.keys() if k[0] <= now):
            for r in sorted(json.loads(self.waiting.getValue((passed,))[0]), key=causal_key):
                state, made = lane.step(state, {**dict(zip(lane.keys, key)), **r})
                out += made
            self.waiting.removeKey((passed,))
        if state is not None and lane.deadline(state) < now * 1000:
            made = lane.finish(state) if lane.finish else []
            out += made if isinstance(made, list) else [made]
            state = None
        if state is None:
            self.state.clear()
        else:
            if at is None or at <= now:
                at = lane.deadline(state) // 1000 + 1
                self.handle.registerTimer(at)
            self.state.update((json.dumps((at, lane.dump(state))),))
        if out:
            yield pd.DataFrame([(*key, *m) for m in out], columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def keyed_stream(rows: DataFrame, lane: StreamLane, delay: str | None) -> DataFrame:
    """delay None: the rows have their watermark already."""
    ship(rows.sparkSession)
    rows = rows if delay is None else rows.withWatermark("event_time", delay)
    ready = rows.select("event_time", *lane.keys, "us", "obs_id", *lane.fields)
    return ready.groupBy(*lane.keys).transformWithStateInPandas(KeyedOrder(lane), f"{lane.key_schema}, {lane.out_schema}", "append", "EventTime")


SYN = StreamLane(
    machines.SYN_KEYS, "target string, service string, protocol int, pair string", ("direction", "flags", "signature", "both_visible", "degraded"), machines.SYN_OUT,
    machines.step_syn, lambda s: s.first_us + machines.SYN_TTL_US, machines.expire_syn, lambda s: s.__dict__, lambda d: machines.SynState(**d),
)
TCP = StreamLane(
    machines.TCP_KEYS, "initiator string, target string, sport long, dport long, protocol int", ("fact",), machines.TCP_OUT,
    machines.step_tcp, lambda s: s.events[-1][0] + TCP_TTL_US, None, lambda s: s.__dict__, lambda d: machines.TcpState([tuple(e) for e in d["events"]], d["dropped"]),
)


def syn_state_stream(packets: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The handshake machine over a stream of packets with the batch operator's columns."""
    return keyed_stream(packets, SYN, delay)


def recon_tcp_stream(packets: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The scan outcome machine over a stream of packets with the batch operator's columns."""
    return keyed_stream(packets.withColumn("fact", machines.tcp_fact()).where("fact IS NOT NULL"), TCP, delay)


def recon_stream(rows: DataFrame, lane: str, delay: str = "0 seconds") -> DataFrame:
    """history.recon over a stream: for each attempt and horizon, what the retained history holds."""
    keys = steps.RECON[lane][0]
    types = {"initiator": "string", "target": "string", "dport": "int", "protocol": "int"}
    made = StreamLane(
        keys, ", ".join(f"{k} {types[k]}" for k in keys), tuple(c for c in ("target", "dport", "quality") if c not in keys), steps.recon_out(lane),
        steps.recon_step(lane), lambda s: s["last"] + steps.RECON_TTL * 1_000_000,
    )
    out = keyed_stream(rows.withColumns({k: F.col(k).cast(types[k]) for k in ("dport", "protocol")}), made, delay)
    return out.select(F.lit(lane).alias("lane_id"), *(c.split()[0] for c in made.out_schema.split(", ")))


def recurrence_stream(flows: DataFrame, keys: dict[str, str], ttl_us: int, delay: str = "5 seconds", cap: int = 32, least: int = 3) -> DataFrame:
    """history.recurrence over a stream. keys: name and type of each key column."""
    made = StreamLane(tuple(keys), ", ".join(f"{k} {t}" for k, t in keys.items()), (), steps.RECURRENCE_OUT, steps.recurrence_step(ttl_us, cap, least), lambda s: s["times"][-1] + ttl_us)
    return keyed_stream(flows, made, delay).withColumn("lane_id", F.lit("c2.r1"))


def hooks_stream(rows: DataFrame, hooks: Hooks, policy: str = "CONTINUE", gaps: DataFrame | None = None, delay: str | None = "0 seconds", last_us: int = 2**62) -> DataFrame:
    """operators.hooks.run_hooks over a stream.

    rows: as hooks.with_gaps gives them (kind, gap_id, turn, position), so openings and closings that name a key are rows of the stream;
    gaps: the lane's gaps known so far, for marks and disabling; last_us: how far a gap without an end is followed; delay None: the rows have
    their watermark already.
    """
    ready = mark_rows(rows if delay is None else rows.withWatermark("event_time", delay), gaps, policy, last_us)
    fields = tuple(dict.fromkeys([*(c for c in hooks.fields if c not in hooks.keys), "position", "kind", "gap_id", "turn", "degraded_by_gap"]))
    key_schema = ", ".join(f"{k} {t}" for k, t in hooks.keys.items())
    pack = lambda kept: {**kept, "state": None if kept["state"] is None else hooks.dump(kept["state"])}
    unpack = lambda kept: {**kept, "state": None if kept["state"] is None else hooks.load(kept["state"])}
    lane = StreamLane(tuple(hooks.keys), key_schema, fields, hooks.schema, stepper(hooks, policy), due_of(hooks), finisher(hooks), pack, unpack)
    return keyed_stream(ready, lane, None)
