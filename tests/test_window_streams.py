"""Window lanes as streams with every measure, boundaries, and plain folds of the two state machines."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import demand, machines
from sightline.plans import machines as plans
from sightline.streaming import windows
from tests.conftest import DATA
from tests.test_keyed_streams import SECOND, run, same

SCHEMA = (
    "us long, obs_id string, target string, service string, direction string, protocol int, bytes long, quality string, reverse string, src string, flags array<string>, flow_tuple string, "
    "response_like boolean, protocol_context string, is_fragment boolean"
)


def packets(seed, many=260):
    r = random.Random(seed)
    return [(
        r.randrange(12 * SECOND), f"p{i:03d}", r.choice(["t1", "t2", None]), r.choice(["s", "s", None]), r.choice(["FORWARD", "FORWARD", "REVERSE", "UNKNOWN"]), r.choice([1, 6, 17, 17]), r.choice([None, 40, 60, 1500]) if i % 3 else 40,
        r.choice(["CLEAR", "CLEAR", "CLEAR", "UNKNOWN", "DEGRADED"]), r.choice(["AVAILABLE", "UNAVAILABLE"]), f"a{r.randrange(6)}", r.choice([["SYN"], ["SYN", "ACK"], []]), f"f{r.randrange(9)}", r.random() < 0.7, r.choice(["DNS", "NTP", " "]), r.random() < 0.5,
    ) for i in range(many)]


@pytest.mark.parametrize("name", list(demand.LANES))
def test_window_streams_equal_batch_with_every_measure(spark, tmp_path, name):
    lane, rows = demand.LANES[name], packets(sum(map(ord, name)))
    got = run_windows(spark, tmp_path, rows, lane, "w_" + name)
    want = demand.demand_window(spark.createDataFrame(rows, SCHEMA), lane, SECOND, 1)
    assert lane.distinct != "src" or want.where("capacity_reached").count()
    same(got, want)


def run_windows(spark, tmp_path, flat, lane, name):
    """tests.test_keyed_streams.run, whose rows are filtered by us: windows have no such column, so it is their first row's."""
    return run(spark, tmp_path, flat, SCHEMA, lambda s: windows.windows_of(s, lane, SECOND, 1, delay="2 seconds").withColumn("us", F.col("first_us")), name).drop("us")


def test_boundaries(spark, tmp_path):
    store = str(tmp_path / "boundaries")
    own = windows.Boundaries(spark, store)
    batch = spark.createDataFrame([(4, "a"), (5, "b"), (6, "c")], "us long, obs_id string")
    assert [x.count() for x in own.split(batch, "x")] == [3, 0]
    assert own.advance("x", 5) and not own.advance("x", 5) and own.advance("y", 1)
    with pytest.raises(ValueError):
        own.advance("x", 4)
    good, late = own.split(batch, "x")
    assert [r["us"] for r in good.collect()] == [5, 6] and [(r["us"], r["watermark_us"], r["kind"]) for r in late.collect()] == [(4, 5, "LATE_EVENT_OBSERVED")]
    again = windows.Boundaries(spark, store)
    assert again.known == {"x": 5, "y": 1} and not again.advance("x", 5) and again.advance("x", 9)
    with pytest.raises(ValueError):
        again.advance("y", 0)


def handshakes_by_hand(rows, end):
    """The handshake rules as a table of cases, on its own: rows by key and time."""
    out = []
    keys = {}
    for r in rows:
        keys.setdefault((r["target"], r["service"], r["protocol"], r["pair"]), []).append(r)
    for key, own in keys.items():
        live = None

        def ends(live):
            kind = ("TCP_SYN_STATE_QUALITY_DEGRADED", "QUALITY_DEGRADED") if live["bad"] else ("CAPTURED_INCOMPLETE_SYN_STATE_EVIDENCE", "REVIEW_FINDING") if live["both"] else ("REVERSE_TCP_STATE_UNOBSERVABLE", "INSUFFICIENT_EVIDENCE")
            out.append((*key, None, live["t0"] + 5_000_000, live["phase"], "EXPIRED", *kind, ",".join(live["ids"]), live["syns"], live["again"]))

        for r in sorted(own, key=lambda r: (r["us"], r["obs_id"])):
            if live and r["us"] - live["t0"] >= 5_000_000:
                ends(live)
                live = None
            f, out_way = frozenset(r["flags"]), r["direction"] == "FORWARD"
            first = out_way and "SYN" in f and "ACK" not in f
            say = lambda a, b, kind, result, ids, s: out.append((*key, r["obs_id"], r["us"], a, b, kind, result, ",".join(dict.fromkeys(ids)), s["syns"] if s else 0, s["again"] if s else 0))
            if live is None:
                if first and "RST" not in f:
                    live = {"t0": r["us"], "phase": "SYN_SEEN", "ids": [r["obs_id"]], "sig": r["signature"], "both": r["both_visible"], "bad": r["degraded"], "syns": 1, "again": 0}
                    say("UNKNOWN", "SYN_SEEN", "SYN_ARRIVAL_FACT", "REVIEW_FINDING", [r["obs_id"]], live)
                else:
                    say("UNKNOWN", "UNKNOWN", "TCP_STATE_HISTORY_INSUFFICIENT", "INSUFFICIENT_EVIDENCE", [r["obs_id"]], None)
                continue
            ids = [r["obs_id"], *live["ids"]]
            if "RST" in f:
                say(live["phase"], "RST_SEEN", "CAPTURED_TCP_RESET_FACT", "REVIEW_FINDING", ids, live)
                live = None
            elif first:
                live["syns"] += 1
                live["again"] += r["signature"] is not None and r["signature"] == live["sig"]
                live["bad"] = live["bad"] or r["degraded"]
                say(live["phase"], live["phase"], "SYN_ARRIVAL_FACT", "REVIEW_FINDING", ids, live)
            elif not out_way and f == {"SYN", "ACK"} and live["phase"] == "SYN_SEEN":
                live["phase"], live["bad"] = "SYNACK_SEEN", live["bad"] or r["degraded"]
                say("SYN_SEEN", "SYNACK_SEEN", "CAPTURED_SYNACK_TRANSITION_FACT", "REVIEW_FINDING", ids, live)
                live["ids"].append(r["obs_id"])
            elif out_way and "ACK" in f and "SYN" not in f and live["phase"] == "SYNACK_SEEN":
                say("SYNACK_SEEN", "ACK_SEEN", "CAPTURED_TCP_HANDSHAKE_PROGRESSION_FACT", "REVIEW_FINDING", ids, live)
                live = None
            else:
                say(live["phase"], live["phase"], "TCP_STATE_TRANSITION_INSUFFICIENT", "INSUFFICIENT_EVIDENCE", ids, live)
        if live and live["t0"] + 5_000_000 <= end:
            ends(live)
    return out


def test_handshakes_of_the_whole_view_equal_a_fold_of_their_own(spark):
    rows = [r.asDict() for r in plans.handshakes(spark, DATA).collect()]
    want = handshakes_by_hand(rows, max(r["us"] for r in rows) + 1)
    got = plans.syn_state(spark, DATA).select("target", "service", "protocol", "pair", "obs_id", "us", "before", "after", "kind", "result_type", "support", "syn_count", "retransmissions")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len({w[8] for w in want}) >= 5


def test_scan_outcomes_of_the_whole_view_equal_a_fold_of_their_own(spark):
    want, kept = [], {}
    rows = [r.asDict() for r in plans.handshakes(spark, DATA).collect()]
    for r in sorted(rows, key=lambda r: (r["us"], r["obs_id"])):
        f, out_way = {x.upper() for x in r["flags"]}, r["direction"] == "FORWARD"
        fact = "SYN" if out_way and "SYN" in f and "ACK" not in f else "SYN_ACK" if not out_way and {"SYN", "ACK"} <= f else "RST" if not out_way and "RST" in f else "ACK" if out_way and "ACK" in f and not f & {"SYN", "RST"} else None
        if fact is None:
            continue
        key = (r["initiator"], r["target"], r["sport"], r["dport"], r["protocol"])
        events, dropped = kept.get(key, ([], 0))
        if events and r["us"] - events[-1][0] >= 3_600_000_000:
            events, dropped = [], 0
        if fact != "SYN" and "SYN" not in [e[2] for e in events]:
            want.append((*key, r["obs_id"], r["us"], "INSUFFICIENT_EVIDENCE", None, None, None, None, None, None))
            kept[key] = (events, dropped)
            continue
        events = sorted([*events, (r["us"], r["obs_id"], fact)])
        dropped += max(0, len(events) - 16)
        events = events[-16:]
        kept[key] = (events, dropped)
        facts = [e[2] for e in events]
        after = facts[facts.index("SYN_ACK"):].count("ACK") if "SYN_ACK" in facts else 0
        want.append((*key, r["obs_id"], r["us"], "REVIEW_FINDING", facts.count("SYN"), facts.count("SYN_ACK"), facts.count("RST"), after, len(facts), dropped))
    got = plans.recon_tcp(spark, DATA).select("initiator", "target", "sport", "dport", "protocol", "obs_id", "us", "result_type", "syn_count", "syn_ack_count", "rst_count", "ack_count", "retained", "dropped")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
