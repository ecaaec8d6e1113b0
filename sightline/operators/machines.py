"""Keyed state machines over ordered records: handshake state and scan outcome.

What is stored depends on what is already stored, so neither is a window function. In batch, rows are dealt by key, sorted
within partitions and folded as they stream by: a task holds one key's small state, never a key's rows.
The same step functions run in streams (see sightline.streaming.stateful).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.core import causal_order
from sightline.functions.deploy import ship

SYN_TTL_US = 5_000_000
SYN_KEYS = ("target", "service", "protocol", "pair")
TCP_KEYS = ("initiator", "target", "sport", "dport", "protocol")
SYN_OUT = "obs_id string, us long, before string, after string, kind string, result_type string, support array<string>, syn_count long, retransmissions long"
TCP_OUT = "obs_id string, us long, fact string, kind string, result_type string, syn_count long, syn_ack_count long, rst_count long, ack_count long, no_reverse boolean, retained long, dropped long, support array<string>"


@dataclass
class SynState:
    """An attempt that a visible first SYN has opened."""

    phase: str
    first_us: int
    ids: list[str]
    signature: str | None
    both_visible: bool
    degraded: bool
    syns: int = 1
    retransmissions: int = 0


def expire_syn(s: SynState) -> tuple:
    """The outcome of an attempt whose time is over: quality first, then visibility, then incompleteness."""
    if s.degraded:
        kind, result = "TCP_SYN_STATE_QUALITY_DEGRADED", "QUALITY_DEGRADED"
    elif not s.both_visible:
        kind, result = "REVERSE_TCP_STATE_UNOBSERVABLE", "INSUFFICIENT_EVIDENCE"
    else:
        kind, result = "CAPTURED_INCOMPLETE_SYN_STATE_EVIDENCE", "REVIEW_FINDING"
    return (None, s.first_us + SYN_TTL_US, s.phase, "EXPIRED", kind, result, list(s.ids), s.syns, s.retransmissions)


def step_syn(s: SynState | None, r: dict) -> tuple[SynState | None, list[tuple]]:
    """One packet of a key. The time to live runs from the first SYN; later ones do not extend it, and reaching it ends it."""
    out = []
    if s is not None and r["us"] >= s.first_us + SYN_TTL_US:
        out.append(expire_syn(s))
        s = None
    flags, forward, us, me = set(r["flags"]), r["direction"] == "FORWARD", r["us"], r["obs_id"]
    syn, ack, rst = "SYN" in flags, "ACK" in flags, "RST" in flags
    opening = syn and not ack and forward

    def row(before, after, kind, result, support, state):
        out.append((me, us, before, after, kind, result, support, state.syns if state else 0, state.retransmissions if state else 0))

    if s is None:
        if opening and not rst:
            s = SynState("SYN_SEEN", us, [me], r["signature"], r["both_visible"], r["degraded"])
            row("UNKNOWN", "SYN_SEEN", "SYN_ARRIVAL_FACT", "REVIEW_FINDING", [me], s)
        else:
            row("UNKNOWN", "UNKNOWN", "TCP_STATE_HISTORY_INSUFFICIENT", "INSUFFICIENT_EVIDENCE", [me], None)
        return s, out
    support = [me, *(x for x in s.ids if x != me)]
    if rst:
        row(s.phase, "RST_SEEN", "CAPTURED_TCP_RESET_FACT", "REVIEW_FINDING", support, s)
        return None, out
    if opening:
        s.syns += 1
        s.retransmissions += r["signature"] is not None and r["signature"] == s.signature
        s.degraded |= r["degraded"]
        row(s.phase, s.phase, "SYN_ARRIVAL_FACT", "REVIEW_FINDING", support, s)
    elif flags == {"SYN", "ACK"} and not forward and s.phase == "SYN_SEEN":
        s.phase, s.degraded = "SYNACK_SEEN", s.degraded | r["degraded"]
        row("SYN_SEEN", "SYNACK_SEEN", "CAPTURED_SYNACK_TRANSITION_FACT", "REVIEW_FINDING", support, s)
        s.ids.append(me)
    elif ack and not syn and forward and s.phase == "SYNACK_SEEN":
        row("SYNACK_SEEN", "ACK_SEEN", "CAPTURED_TCP_HANDSHAKE_PROGRESSION_FACT", "REVIEW_FINDING", support, s)
        return None, out
    else:
        row(s.phase, s.phase, "TCP_STATE_TRANSITION_INSUFFICIENT", "INSUFFICIENT_EVIDENCE", support, s)
    return s, out


@dataclass
class TcpState:
    """The retained facts of one five-tuple."""

    events: list[tuple[int, str, str]] = field(default_factory=list)
    dropped: int = 0


def step_tcp(s: TcpState | None, r: dict, cap: int = 16, ttl_us: int = 3_600_000_000) -> tuple[TcpState | None, list[tuple]]:
    """One fact. Without a SYN in the retained history only a SYN is stored; only stored facts refresh the time to live."""
    if s is not None and s.events and r["us"] - s.events[-1][0] >= ttl_us:
        s = None
    fact, me, us = r["fact"], r["obs_id"], r["us"]
    before = s.events if s else []
    if fact != "SYN" and all(e[2] != "SYN" for e in before):
        return s, [(me, us, fact, "MIDSTREAM_TCP_RESPONSE_OR_PROGRESSION", "INSUFFICIENT_EVIDENCE", None, None, None, None, None, None, None, [me])]
    events = sorted([*before, (us, me, fact)])
    over = max(0, len(events) - cap)
    s = TcpState(events[over:], (s.dropped if s else 0) + over)
    facts = [e[2] for e in s.events]
    acks = facts[facts.index("SYN_ACK") + 1 :].count("ACK") if "SYN_ACK" in facts else 0
    return s, [(
        me, us, fact, "OBSERVED_TCP_ATTEMPT_OUTCOME_FACTS", "REVIEW_FINDING", facts.count("SYN"), facts.count("SYN_ACK"), facts.count("RST"), acks,
        "SYN_ACK" not in facts and "RST" not in facts, len(facts), s.dropped, [me, *(e[1] for e in s.events if e[1] != me)],
    )]


def fold(rows: DataFrame, keys: tuple[str, ...], step: Callable, finish: Callable | None, out_schema: str, key_schema: str, end_us: int | None = None, position: str | None = None, order: tuple[str, ...] | None = None, due: Callable | None = None) -> DataFrame:
    """Fold each key's rows in causal order (by the source position too, if its column is named), or in that of the columns `order`.

    finish(state) gives what is left of a key at the end of input (one row or a list), if due(state), by default an attempt's end, is no later.
    """
    due = due or (lambda s: s.first_us + SYN_TTL_US)
    ship(rows.sparkSession)
    names = list(rows.columns)
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *(order or causal_order(position=position)))
    schema = f"{key_schema}, {out_schema}"
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def close():
            if not finish or key is None or state is None or (end_us is not None and due(state) > end_us):
                return []
            made = finish(state)
            return [(*key, *m) for m in (made if isinstance(made, list) else [made])]

        for b in batches:
            out = []
            for values in zip(*(b.column(c).to_pylist() for c in names)):
                r = dict(zip(names, values))
                own = tuple(r[k] for k in keys)
                if own != key:
                    out += close()
                    key, state = own, None
                state, made = step(state, r)
                out += [(*own, *m) for m in made]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        last = close()
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), arrow)], schema=arrow)

    return sorted_rows.mapInArrow(run, schema)


def syn_state(packets: DataFrame, end_us: int | None = None) -> DataFrame:
    """Handshake states and expiries. packets: us, obs_id, the keys, direction, flags, signature, both_visible, degraded.

    end_us: the final watermark (last time + 1 microsecond); attempts that live on then have no expiry row.
    """
    rows = packets.select(*SYN_KEYS, "us", "obs_id", "direction", "flags", "signature", "both_visible", "degraded")
    return fold(rows, SYN_KEYS, step_syn, expire_syn, SYN_OUT, "target string, service string, protocol int, pair string", end_us)


def tcp_fact() -> Column:
    """The fact of a packet: forward SYN, reverse SYN+ACK, reverse RST or forward ACK; NULL for any other. Flags count in any case."""
    flags = F.split(F.upper(F.concat_ws(",", "flags")), ",")
    has = lambda name: F.array_contains(flags, name)
    forward, backward = F.col("direction") == "FORWARD", F.col("direction") == "REVERSE"
    return (
        F.when(forward & has("SYN") & ~has("ACK"), "SYN").when(backward & has("SYN") & has("ACK"), "SYN_ACK").when(backward & has("RST"), "RST")
        .when(forward & has("ACK") & ~has("SYN") & ~has("RST"), "ACK")
    )


def recon_tcp(packets: DataFrame) -> DataFrame:
    """Attempt outcomes from the four facts of tcp_fact."""
    rows = packets.withColumn("fact", tcp_fact()).where("fact IS NOT NULL").select(*TCP_KEYS, "us", "obs_id", "fact")
    return fold(rows, TCP_KEYS, step_tcp, None, TCP_OUT, "initiator string, target string, sport long, dport long, protocol int")
