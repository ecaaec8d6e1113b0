"""Hand-made rows with known answers for windows, histories, machines, names and stores."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import core
from sightline.operators import conform, demand, history, lexical, machines, measures, relate, results, routing

MS, S = 1_000, 1_000_000


def packets(spark, rows):
    """rows: (us, id, bytes) and optional overrides."""
    base = {"target": "t", "service": "s", "direction": "FORWARD", "protocol": 17, "quality": "CLEAR", "reverse": "AVAILABLE", "src": "a", "is_fragment": False, "response_like": True, "protocol_context": "DNS", "flow_tuple": "x"}
    data = [{**base, "us": r[0], "obs_id": r[1], "bytes": r[2], **(r[3] if len(r) > 3 else {})} for r in rows]
    schema = "us long, obs_id string, bytes long, target string, service string, direction string, protocol int, quality string, reverse string, src string, is_fragment boolean, response_like boolean, protocol_context string, flow_tuple string"
    return spark.createDataFrame(data, schema).withColumn("flags", F.array(F.lit("SYN")))


def window(spark, rows, name="udp_demand", **kw):
    return demand.demand_window(packets(spark, rows), demand.LANES[name], S, **kw).orderBy("window_start").collect()


def test_window_measures_and_edges(spark):
    r = window(spark, [(100 * MS, "a", 100), (900 * MS, "b", 200), (1000 * MS, "c", 5)])
    assert (r[0]["packet_count"], r[0]["byte_count"], r[0]["mean_bytes"], r[0]["min_bytes"], r[0]["max_bytes"]) == (2, 300, 150.0, 100, 200)
    assert [x["packet_count"] for x in window(spark, [(999 * MS, "a", 1), (1000 * MS, "b", 1)])] == [1, 1]


def test_missing_length_is_not_zero(spark):
    r = window(spark, [(1, "a", 100), (2, "b", None)])[0]
    assert (r["packet_count"], r["byte_count"], r["observed_bytes"], r["missing_lengths"]) == (2, None, 100, 1)


def test_capped_distinct(spark):
    rows = [(i, f"p{i}", 1, {"src": s}) for i, s in enumerate("aabc")]
    r = window(spark, rows, "source_diversity", cap=2)[0]
    assert (r["packet_count"], r["distinct_count"], r["capacity_reached"], r["result_type"]) == (4, 2, True, "QUALITY_DEGRADED")
    assert window(spark, rows, "source_diversity", cap=3)[0]["capacity_reached"] is False


def test_worst_quality_and_order_do_not_matter(spark):
    rows = [(1, "a", 1, {"quality": "UNKNOWN"}), (2, "b", 1, {"quality": "DEGRADED"}), (3, "c", 1)]
    a = window(spark, rows)
    random.Random(1).shuffle(rows)
    assert a == window(spark, rows) and a[0]["quality"] == "DEGRADED" and a[0]["lower_bound"]


def test_open_last_window_and_boundary(spark):
    p = packets(spark, [(100 * MS, "a", 1), (1500 * MS, "b", 1)])
    w = demand.demand_window(p, demand.LANES["udp_demand"], S)
    assert [r["window_start"] for r in demand.closed_only(w, p).collect()] == [0]
    assert [(r["window_end"], r["created_us"]) for r in demand.closing_boundary(w, p).collect()] == [(S, 1500 * MS)]
    exact = packets(spark, [(100 * MS, "a", 1), (S - 1, "b", 1)])
    assert demand.closing_boundary(demand.demand_window(exact, demand.LANES["udp_demand"], S), exact).first()["created_us"] == S


def attempts(spark, rows):
    return spark.createDataFrame([(us, f"o{i:02d}", "i", t, p, 6, "CLEAR") for i, (us, t, p) in enumerate(rows)], "us long, obs_id string, initiator string, target string, dport long, protocol int, quality string")


def last(spark, rows, lane, **kw):
    return history.recon(attempts(spark, rows), lane, **kw).where(f"horizon_s = {kw.get('horizons', (60, 3600))[-1]}").orderBy(F.desc("us"), F.desc("obs_id")).first()


def test_scan_breadth(spark):
    r = last(spark, [(0, "1", 22), (S, "1", 22), (2 * S, "2", 22)], "recon.h")
    assert (r["distinct_hosts"], r["attempts"]) == (2, 3)
    r = last(spark, [(0, "1", 22), (S, "1", 22), (2 * S, "1", 443)], "recon.v")
    assert (r["distinct_ports"], r["attempts"]) == (2, 3)
    r = last(spark, [(0, "1", 22), (S, "1", 443), (2 * S, "2", 443)], "recon.2d")
    assert (r["distinct_hosts"], r["distinct_ports"], r["distinct_pairs"], r["attempts"]) == (2, 2, 3, 3)


def test_horizons_and_cap(spark):
    rows = history.recon(attempts(spark, [(0, "1", 22), (8 * S, "1", 22), (20 * S, "1", 22)]), "recon.h", (10, 60)).where(f"us = {20 * S}").orderBy("horizon_s").collect()
    assert [r["attempts"] for r in rows] == [1, 3]
    r = last(spark, [(i * S, str(i), 22) for i in range(17)], "recon.h")
    assert (r["retained"], r["dropped"], r["truncated"]) == (16, 1, True)


def test_ttl_breaks_at_equality(spark):
    df = spark.createDataFrame([(0, "a"), (9 * S, "b"), (19 * S, "c")], "us long, obs_id string").withColumn("k", F.lit(1))
    assert [r["session_no"] for r in history.ttl_sessions(df, ("k",), 10 * S).orderBy("us").collect()] == [0, 0, 1]


def recurrence(spark, seconds, **kw):
    rows = spark.createDataFrame([(s * S, f"flow-{s}", "c") for s in seconds], "us long, obs_id string, client string")
    return history.recurrence(rows, ("client",), 10**12, **kw).orderBy("us").collect()


def test_recurrence(spark):
    r = recurrence(spark, [0, 60, 120])
    assert [x["result_type"] for x in r] == ["INSUFFICIENT_EVIDENCE"] * 2 + ["REVIEW_FINDING"] and [x["missing_events"] for x in r] == [2, 1, None]
    assert (r[2]["event_count"], r[2]["span_us"], r[2]["interval_count"], r[2]["median_us"], r[2]["mad_us"]) == (3, 120 * S, 2, 60.0 * S, 0.0)
    assert [x["state_version"] for x in r] == [None, 1, 2] and r[2]["support"] == ["flow-120", "flow-0", "flow-60"]
    assert recurrence(spark, [0, 10, 20, 30], cap=3)[-1]["span_us"] == 20 * S


def handshake(spark, rows, end=None):
    data = [(us, f"p{i}", "t", "s", 6, "x", d, f.split(","), sig, both, bad) for i, (us, d, f, sig, both, bad) in enumerate(rows)]
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, "us long, obs_id string, target string, service string, protocol int, pair string, direction string, flags array<string>, signature string, both_visible boolean, degraded boolean")
    return [(r["kind"], r["result_type"]) for r in machines.syn_state(df, end).orderBy("us", F.col("obs_id").asc_nulls_last()).collect()]


def test_handshake_outcomes(spark):
    syn = (0, "FORWARD", "SYN", "q", True, False)
    assert handshake(spark, [syn, (S, "REVERSE", "SYN,ACK", None, True, False), (2 * S, "FORWARD", "ACK", None, True, False)])[-1] == ("CAPTURED_TCP_HANDSHAKE_PROGRESSION_FACT", "REVIEW_FINDING")
    later = (6 * S, "FORWARD", "ACK", None, True, False)
    assert handshake(spark, [syn, later])[1] == ("CAPTURED_INCOMPLETE_SYN_STATE_EVIDENCE", "REVIEW_FINDING")
    assert handshake(spark, [(0, "FORWARD", "SYN", None, False, False), later])[1] == ("REVERSE_TCP_STATE_UNOBSERVABLE", "INSUFFICIENT_EVIDENCE")
    assert handshake(spark, [(0, "FORWARD", "SYN", None, False, True), later])[1] == ("TCP_SYN_STATE_QUALITY_DEGRADED", "QUALITY_DEGRADED")
    assert handshake(spark, [syn, (S, "REVERSE", "RST", None, True, False)], 10)[-1] == ("CAPTURED_TCP_RESET_FACT", "REVIEW_FINDING")
    assert handshake(spark, [(0, "REVERSE", "SYN,ACK", None, True, False)]) == [("TCP_STATE_HISTORY_INSUFFICIENT", "INSUFFICIENT_EVIDENCE")]
    assert [k for k, _ in handshake(spark, [syn, (S, "FORWARD", "SYN", "q", True, False)], 2 * S)] == ["SYN_ARRIVAL_FACT"] * 2
    assert handshake(spark, [syn], 5 * S)[-1][0] == "CAPTURED_INCOMPLETE_SYN_STATE_EVIDENCE" and len(handshake(spark, [syn], 5 * S - 1)) == 1


def test_retransmission_does_not_extend_life():
    row = dict(direction="FORWARD", flags=["SYN"], signature="q", both_visible=True, degraded=False)
    s, _ = machines.step_syn(None, {**row, "us": 0, "obs_id": "a"})
    s, _ = machines.step_syn(s, {**row, "us": 4 * S, "obs_id": "b"})
    assert (s.syns, s.retransmissions) == (2, 1)
    s, out = machines.step_syn(s, {**row, "us": 5 * S, "obs_id": "c"})
    assert out[0][3] == "EXPIRED" and s.first_us == 5 * S


def test_scan_outcome_machine():
    s, out = machines.step_tcp(None, {"us": 0, "obs_id": "m", "fact": "SYN_ACK"})
    assert s is None and out[0][4] == "INSUFFICIENT_EVIDENCE"
    for i, f in enumerate(["SYN", "ACK", "SYN_ACK", "ACK", "RST"]):
        s, out = machines.step_tcp(s, {"us": i, "obs_id": f"e{i}", "fact": f})
    assert out[0][5:9] == (1, 1, 1, 1) and out[0][9] is False
    for i in range(5, 17):
        s, out = machines.step_tcp(s, {"us": i, "obs_id": f"e{i:02d}", "fact": "RST"})
    assert out[0][10:12] == (16, 1)
    assert machines.step_tcp(s, {"us": 17, "obs_id": "z", "fact": "RST"})[1][0][4] == "INSUFFICIENT_EVIDENCE"


def test_names(spark):
    names = ["A1.Xn--Exmple-Cua.UNKNOWN.", "", ".", "foo..example.com", "example.com..", " x.com", "a\tb"]
    df = spark.createDataFrame([(n,) for n in names], "q string")
    r = df.select(core.labels("q").alias("l"), core.name_problem("q").alias("p")).collect()
    assert r[0]["l"] == ["a1", "xn--exmple-cua", "unknown"]
    assert [x["p"] for x in r] == [None, "EMPTY_NAME", "ROOT_NAME_NOT_APPLICABLE", "EMPTY_LABEL", "EMPTY_LABEL", "WHITESPACE_IN_NAME", "WHITESPACE_IN_NAME"]


def test_roles_and_directions(spark):
    df = spark.sql("SELECT array(named_struct('identifier', 'a', 'role', 'r'), named_struct('identifier', 'b', 'role', 'r')) AS two, array(named_struct('identifier', 'a', 'role', 'r')) AS one, array(named_struct('identifier', ' ', 'role', 'r')) AS blank")
    assert df.select(core.resolve_role("two", "r"), core.resolve_role("one", "r"), core.resolve_role("blank", "r")).first()[:] == (None, "a", None)
    d = spark.createDataFrame([("10.0.0.1", "192.168.0.1"), ("192.168.0.1", "10.0.0.1"), ("8.8.8.8", "10.0.0.1"), ("10.0.0.1", "10.0.0.2")], "src string, dst string")
    assert [r["direction"] for r in conform.classify_direction(d, ("10.0.0.0/8",), ("192.168.0.0/16",)).collect()] == ["FORWARD", "REVERSE", "UNKNOWN", "UNKNOWN"]


def test_visibility_merge(spark):
    df = spark.sql("SELECT map('a', 'X') AS l, map('b', 'Y') AS r, map('a', 'Z') AS c")
    assert df.select(conform.merge_visibility(F.col("l"), F.col("r"))).first()[0] == {"a": "X", "b": "Y"}
    assert df.select(conform.merge_visibility(F.col("l"), F.col("c"))).first()[0] is None


def test_lane_ids_are_distinct(spark):
    with pytest.raises(ValueError):
        routing.lane_table(spark, (routing.LANES[0], routing.LANES[0]))


def test_append_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([("r1", "h1", "x"), ("r2", "h2", "x"), ("r1", "h1", "x")], "result_id string, content_hash string, lane_id string")
    path = str(tmp_path / "results")
    assert results.append_results(batch, path) == 2 and results.append_results(batch, path) == 0
    with pytest.raises(ValueError):
        results.append_results(batch.withColumn("content_hash", F.lit("other")), path)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2"), ("z2", "z1")], "a string, b string")
    roots = {r["node"]: r["root"] for r in relate.components(edges).collect()}
    assert set(roots.values()) == {"n000", "z1"} and len(roots) == 61


def test_ranking_measures_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    assert lexical.auroc(df).first()[0] == pytest.approx(0.625)
    assert lexical.average_precision(df).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_nearest_rank_does_not_interpolate(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    r = measures.nearest_rank(df, ("k",), "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r["p50"], r["p95"]) == (3.0, 4.0)


def test_lexical_training_separates(spark):
    rows = spark.createDataFrame([(f"{'qxz' * 3}{i % 7}", 1) for i in range(20)] + [(f"{'banana'}{i % 7}", 0) for i in range(20)], "text string, label int")
    counter, idf, model = lexical.train_lexical(rows, vocabulary=500)
    assert model.summary.accuracy == 1.0


def test_empty_inputs(spark):
    none = packets(spark, [(0, "a", 1)]).limit(0)
    assert demand.closed_only(demand.demand_window(none, demand.LANES["udp_demand"], S), none).count() == 0
    assert history.recon(attempts(spark, [(0, "a", 1)]).limit(0), "recon.h").count() == 0


def test_registry_runs_selected_records_only(spark):
    from sightline.operators.extend import Mechanism, Registry

    rows = spark.createDataFrame([("a", 6, 5), ("b", 17, 5)], "obs_id string, protocol int, us long").select(
        "*", F.lit("PACKET").alias("observation_type"), F.lit("v1").alias("contract"), F.array(F.lit("protocol")).alias("present_fields"), F.array(F.lit("PACKET_FACTS")).alias("available"), F.lit("IMMEDIATE").alias("record_finality"), F.lit("IMMEDIATE").alias("availability_basis"))
    mine = Mechanism(routing.Lane("own.udp", "PACKET", ("protocol",), ("PACKET_FACTS",), "protocol = 17"), lambda d: d.select("obs_id"), {"x": 1})
    reg = Registry()
    reg.register(mine)
    assert [(r["obs_id"], r["lane_id"]) for r in reg.run(rows).collect()] == [("b", "own.udp")]
    with pytest.raises(ValueError):
        reg.register(mine)


def test_gap_policies(spark):
    from sightline.operators import extend

    rows = spark.createDataFrame([(i, f"o{i}", "k", int(i in (2, 3))) for i in range(5)], "us long, obs_id string, k string, gap_count long")
    assert extend.apply_gap_policy(rows, "DISABLE").count() == 3
    assert extend.apply_gap_policy(rows, "ABSTAIN").where("suppressed").count() == 2
    reset = extend.sessions_with_gaps(extend.apply_gap_policy(rows, "RESET"), ("k",), 100).orderBy("us")
    assert [r["session_no"] for r in reset.collect()] == [0, 0, 1, 1, 1]


def test_observation_summary_is_bounded(spark):
    from sightline.operators.extend import observation_summary

    df = spark.createDataFrame([("o", "x" * 500, None)], "obs_id string, qname string, rcode string").withColumn("roles", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.cast("string").alias("identifier"), F.lit("r").alias("role"))))
    r = observation_summary(df, ("qname", "rcode")).first()
    assert len(r["roles"]) == 16 and [f["field"] for f in r["facts"]] == ["qname"] and len(r["facts"][0]["value"]) == 201
