"""Joins with sidecars, merged facts, feeds, and a trained model applied, on rows made here."""

import json

from pyspark.sql import functions as F

from sightline.functions.core import endpoint_pair
from sightline.operators import conform, demand, extend, lexical, relate, results
from sightline.sources import captures


def test_sidecar_joins(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({
        "source_id": "s1", "capture_file": "a.pcap", "packet_count": 2, "endpoint_roles": {"10.0.0.1": [{"identifier": "c1", "role": "client_id"}]},
        "services": [{"address": "10.0.0.2", "protocol": 6, "port": 80, "service_id": "web"}], "reflection_facts": {},
    }))
    side = captures.read_capture_manifest(spark, str(tmp_path))
    assert side["sources"].first()["source_id"] == "s1" and side["roles"].first()["address"] == "10.0.0.1" and side["reflection"].count() == 0
    assert side["services"].first()["service_id"] == "web"


def test_roles_and_manifests_keep_rows_without_a_match(spark):
    packets = spark.createDataFrame([("s1", "1", "a", "b"), ("s2", "2", "b", "z")], "source_id string, position string, src string, dst string")
    roles = spark.createDataFrame([("s1", "a", ["client"]), ("s1", "b", ["server", "dns"])], "source_id string, address string, roles array<string>")
    got = {r["position"]: (r["src_roles"], r["dst_roles"]) for r in conform.attach_roles(packets, roles).collect()}
    assert got == {"1": (["client"], ["server", "dns"]), "2": ([], [])}
    known = conform.attach_manifest(packets, spark.createDataFrame([("s1", "FORWARD")], "source_id string, manifest_direction string"))
    assert {r["source_id"]: r["manifest_direction"] for r in known.collect()} == {"s1": "FORWARD", "s2": None}


def test_reflection_facts_are_for_udp(spark):
    packets = spark.createDataFrame([("s", "1", 17), ("s", "2", 6), ("s", "3", 6)], "source_id string, position string, protocol int")
    facts = spark.createDataFrame([("s", "1", True), ("s", "2", True)], "source_id string, position string, response_like boolean")
    got = {r["position"]: (r["response_like"], r["reflection_error"]) for r in conform.attach_reflection(packets, facts).collect()}
    assert got == {"1": (True, None), "2": (True, "REFLECTION_FACT_ON_NON_UDP"), "3": (None, None)}


def test_one_way_visibility(spark):
    rows = spark.createDataFrame([("FORWARD",), ("REVERSE",), ("UNKNOWN",)], "d string").select("d", conform.direction_visibility(F.col("d")).alias("v")).collect()
    assert [r["v"]["REVERSE_FACTS"] for r in rows] == ["UNAVAILABLE", "AVAILABLE", "UNKNOWN"]


def test_endpoints_have_one_key_in_both_directions(spark):
    rows = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1), ("a", 2, "b", 1)], "s string, sp int, d string, dp int")
    keys = [str(r[0]) for r in rows.select(endpoint_pair(F.col("s"), F.col("sp"), F.col("d"), F.col("dp"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_facts_of_equal_pairs_are_merged(spark):
    schema = "left_id string, right_id string, shared array<string>"
    left, right = spark.createDataFrame([("a", "b", ["y", "x"])], schema), spark.createDataFrame([("a", "b", ["z", "x"]), ("a", "c", [])], schema)
    assert {r["right_id"]: r["shared"] for r in relate.merge_candidates(left, right).collect()} == {"b": ["x", "y", "z"], "c": []}


def test_change_feed_goes_on_after_its_cursor(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (3, "z")], "created_us long, result_id string")
    seen, at = [], None
    while page := [tuple(r) for r in extend.change_feed(rows, at, 3).collect()]:
        seen, at = seen + page, page[-1]
    assert seen == [(1, "a"), (1, "b"), (2, "a"), (3, "z")]


def test_display_quality_and_view_search(spark):
    states = spark.createDataFrame([(["CLEAR", "DEGRADED"],), (["UNKNOWN", "CLEAR"],), (["CLEAR"],)], "q array<string>")
    assert [r[0] for r in states.select(results.display_quality(F.col("q"))).collect()] == ["Degraded", "Unknown", "Clear"]
    views = spark.createDataFrame([("v1", "DDoS", ["r1"], ["o9"], 5), ("v2", "DDoS", ["r2"], ["o8"], 7), ("v3", "Other", ["r9"], ["o8"], 9)], "view_id string, family string, result_ids array<string>, source_ids array<string>, end_us long")
    assert [r["view_id"] for r in extend.search_views(views, "DDoS", "O").collect()] == ["v2", "v1"]
    assert [r["view_id"] for r in extend.search_views(views, None, "o8").collect()] == ["v3", "v2"]


def test_windows_that_close_in_a_gap_are_degraded(spark):
    rows = spark.createDataFrame([(us, f"p{us}", "t", "s", "FORWARD", 17, 5, "CLEAR", "AVAILABLE") for us in (1, 11, 21)], "us long, obs_id string, target string, service string, direction string, protocol int, bytes long, quality string, reverse string")
    windows = demand.demand_window(rows, demand.LANES["udp_demand"], 10)
    gaps = spark.createDataFrame([("ddos.udp_demand", "g1", 15, 25), ("ddos.icmp_demand", "g2", 0, None)], "lane_id string, gap_id string, opened_us long, closed_us long")
    got = {r["window_end"]: (r["result_type"], r["lower_bound"], r["missing_evidence"]) for r in demand.degrade_in_gaps(windows, gaps).collect()}
    assert got == {10: ("REVIEW_FINDING", False, ""), 20: ("QUALITY_DEGRADED", True, "complete_coverage"), 30: ("REVIEW_FINDING", False, "")}


def test_a_trained_model_is_applied_and_its_absence_is_said(spark):
    names = [("example", 0), ("library", 0), ("kitchen", 0), ("exampled", 0), ("libraries", 0), ("qxzvkj", 1), ("zqxjvk", 1), ("vkqxzj", 1), ("xzvkqj", 1), ("qxzvk", 1)]
    rows = spark.createDataFrame(names, "text string, label int")
    model = lexical.train_lexical(rows)
    asked = spark.createDataFrame([("exam",), ("qxzv",), (None,), ("",)], "text string")
    got = {r["text"]: r for r in lexical.score_model(asked, model).collect()}
    assert got["exam"]["score"] < 0.5 < got["qxzv"]["score"] and got["exam"]["result_type"] == "REVIEW_FINDING"
    assert got[None]["score"] is None and got[""]["score"] is None and got[None]["reason"] == got[""]["reason"] == "REPRESENTATION_UNAVAILABLE"
    assert {(r["score"], r["reason"]) for r in lexical.score_model(asked, None).collect()} == {(None, "MODEL_UNAVAILABLE")}
