"""From bundles and captures to results: golden counts, rejected records, lanes' fact contracts, growing components."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import adapt, relate
from sightline.plans.relations import FAMILY  # noqa: F401
from sightline.sources import bundles

ROLE = {"basis": "SOURCE_DECLARED_ROLE"}
FAMILIES = {x.lane_id: x.lane_id.split(".")[0] if x.lane_id[:3] in ("ddo", "rec", "c2.") else "names" if x.lane_id[0] == "d" else x.lane_id for x in adapt.LANES}


def line(kind, position, second, declared, payload, roles=(), **kw):
    base = {"schema_version": "1", "position": position, "timestamp": f"2026-01-05T00:{second // 60:02d}:{second % 60:02d}Z", "finality": "CURRENT", "observation_type": kind, "payload": payload,
            "declared_observed_fields": declared, "role_assignments": [{"role": r, "identifier": i, **ROLE} for r, i in roles], "canonicalization_options": {}}
    return json.dumps({**base, **kw})


def packet(position, second, protocol, port, flags=None, src=None, service=True, **kw):
    """A packet to one target; port None: a protocol without ports, to no service."""
    src = src or f"198.51.100.{9 + position}"
    payload = {"protocol": protocol, "lengths": {"ip": 40}, "src_address": src, "dst_address": "192.0.2.10", "src_port": port and 50000 + position, "dst_port": port, "flags": flags, "observed_l4_facts": {"protocol": protocol}, "fragmentation": None}
    payload |= kw.pop("payload", {})
    roles = [("initiator_id", src), ("target_id", "192.0.2.10")] + ([("service_id", f"service/{port}/{protocol}")] if port and service else [])
    declared = [f for f in ("lengths", "protocol", "observed_l4_facts", "src_address", "dst_address", "src_port", "dst_port", "flags", "fragmentation") if payload[f] is not None]
    return line("PACKET", position, second, declared, payload, kw.pop("roles", roles), **kw)


def flow(position, second, peer, port, end, bytes_c2s):
    at = lambda s: f"2026-01-05T00:{s // 60:02d}:{s % 60:02d}Z"
    payload = {"flow_id_basis": "record", "endpoints": ["192.0.2.44", peer], "protocol": 6, "start_time": at(second), "end_time": at(end), "export_time": at(end), "supplied_directional_counters": {"bytes_c2s": bytes_c2s}, "exporter_semantics": "exporter"}
    return line("FLOW", position, second, list(payload), payload, [("client_id", "client"), ("peer_id", peer), ("peer_port", port)], finality="TERMINAL")


def name(position, second, qname):
    payload = {"flow_reference": "f", "qname": qname, "qtype": "A", "parser_version": "1"}
    return line("DNS", position, second, list(payload), payload, canonicalization_options={"clear_dns_fields": True})


def mixed(ports, extra):
    """Forward SYNs a second apart, then packets of other protocols."""
    rows = [packet(k + 1, k, 6, port, ["SYN"]) for k, port in enumerate(ports)]
    return rows + [packet(len(ports) + 1 + k, len(ports) + k, *x) for k, x in enumerate(extra)]


ONE_WAY = {"available": ["PACKET_FACTS", "FORWARD_FACTS"], "unavailable": ["REVERSE_FACTS"], "degraded": []}
#: bundle: (lines, visibility, records, results, routes, views, links, records without a route)
GOLDEN = {
    "mixed": (mixed([443, 443, 443, 22, 80, 443, 25], [(17, 53), (1, None), (99, None), (6, 8443, ["SYN"]), (17, 123)]), ONE_WAY, 12, 65, 60, 17, 8, 2),
    "one_way": (mixed([443, 443, 22, 443, 8443], [(1, None), (17, 53), (99, None)]), ONE_WAY, 8, 40, 37, 11, 5, 2),
    "recurrence": ([flow(1, 0, "a", "443", 1, 100), flow(2, 41, "a", "443", 43, 87), flow(3, 66, "b", "8443", 67, 45), flow(4, 103, "a", "443", 104, 126), flow(5, 178, "a", "443", 179, 93), flow(6, 217, "c", "443", 218, 58), flow(7, 249, "a", "443", 251, 111)],
                   {"available": ["FORWARD_FACTS"], "unavailable": ["REVERSE_FACTS"], "degraded": []}, 7, 14, 14, 10, 7, 0),
    "names": ([name(k + 1, 20 * k, f"n{k}x.example.{t}") for k, t in enumerate(("com", "net", "org", "net", "org", "com"))], {"available": ["CLEAR_DNS_FIELDS", "FORWARD_FACTS"], "unavailable": [], "degraded": []}, 6, 12, 12, 6, 0, 0),
    "session": ([line("TLS", 1, 60, ["flow_reference", "tcp_reassembly_state", "parser_version", "parsed_handshake_metadata", "gaps"],
                      {"flow_reference": "f", "tcp_reassembly_state": "COMPLETE_PREFIX", "parser_version": "1", "parsed_handshake_metadata": {"sni": "x.test"}, "gaps": []}, canonicalization_options={"handshake_metadata": True, "record_metadata": False})],
                {"available": ["FORWARD_FACTS"], "unavailable": [], "degraded": []}, 1, 1, 1, 1, 0, 0),
}


def write(folder, lines, visibility, direction="FORWARD", **kw):
    folder.mkdir()
    quality = dict.fromkeys(adapt.QUALITY_FACTS, "CLEAR")
    manifest = {"schema_version": "1", "source_id": folder.name, "source_kind": "DERIVED", "input_observation_contract": "REPLAY_TYPED_V1", "timestamp_semantics": "SOURCE_EVENT_TIME", "direction_basis": "CAPTURE_INTERFACE", "wire_direction": direction,
                "visibility": visibility, "quality": quality, "event_time_order": "NONDECREASING", "record_count": len(lines)}
    (folder / "manifest.json").write_text(json.dumps({**manifest, **kw}))
    (folder / "records.ndjson").write_text("\n".join(lines) + "\n")


def results_of(spark, path):
    rows = relate.stored(adapt.routed(bundles.read_bundle(spark, str(path))))
    found = relate.stored(adapt.lane_results(rows))
    return rows, found, found.join(relate.families(spark, FAMILIES), "lane_id", "left")


def test_golden_counts_of_five_sources_in_one_run(spark, tmp_path):
    for source, (lines, visibility, *_) in GOLDEN.items():
        write(tmp_path / source, lines, visibility)
    rows, found, known = results_of(spark, tmp_path)
    got = {r["source_id"]: [r["n"], r["routes"], r["zero"]] for r in rows.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.size("routes")).alias("routes"), F.count_if(F.size("routes") == 0).alias("zero")).collect()}
    assert got == {s: [n, routes, zero] for s, (_, _, n, _, routes, _, _, zero) in GOLDEN.items()}
    assert {r["source_id"]: r["count"] for r in found.groupBy("source_id").count().collect()} == {s: g[3] for s, g in GOLDEN.items()}
    views = relate.stored(relate.family_views(known))
    of = lambda c: F.regexp_extract(F.get(c, F.lit(0)), "^[a-z]+:([^:]+):", 1).alias("source_id")
    assert {r["source_id"]: r["count"] for r in views.select(of(F.col("source_ids"))).groupBy("source_id").count().collect()} == {s: g[5] for s, g in GOLDEN.items()}
    links = relate.investigation_links(views)
    assert {r["source_id"]: r["count"] for r in links.select(of(F.col("shared"))).groupBy("source_id").count().collect()} == {s: g[6] for s, g in GOLDEN.items() if g[6]}
    again = adapt.lane_results(adapt.routed(bundles.read_bundle(spark, str(tmp_path))))
    assert again.join(found.select("result_id"), "result_id", "left_anti").count() == 0
    assert found.select("result_id").distinct().count() == found.count()
    # The graph grows by parts as it does at once.
    part = F.pmod(F.xxhash64("result_id"), F.lit(10))
    grown = None
    for k in range(10):
        grown = relate.membership(known.where((part == k) & F.col("family").isNotNull()), grown)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, relate.membership(known.where("family IS NOT NULL")).collect()))


def test_records_that_are_refused(spark, tmp_path):
    both = {"available": ["PACKET_FACTS", "FORWARD_FACTS", "REVERSE_FACTS"], "unavailable": [], "degraded": []}
    ok = packet(1, 0, 6, 443, ["SYN"])
    lines = [
        ok, packet(2, 1, 6, 443, ["SYN"], wire_direction="REVERSE"), line("PACKET", 3, 2, [], {"protocol": 6}), line("DNS", 4, 3, ["qtype"], {"qtype": "A"}, canonicalization_options={"clear_dns_fields": True}),
        line("PACKET", 5, 4, ["protocol", "flags"], {"protocol": 6, "flags": None}), line("PACKET", 6, 5, ["protocol"], {"protocol": 6}, canonicalization_options={"clear_dns_fields": True}), packet(7, 6, 6, 443, ["SYN"], roles=[("target_id", "")]),
    ]
    write(tmp_path / "f", lines, ONE_WAY)
    write(tmp_path / "u", [packet(1, 0, 17, 53), packet(2, 1, 17, 53, wire_direction="FORWARD")], both, "UNKNOWN")
    write(tmp_path / "v", [ok], both)
    write(tmp_path / "b", [ok], ONE_WAY, direction_basis="UNKNOWN")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "records.ndjson").write_text(ok + "\n")
    got = {r["bundle"] + r["position"]: r["rejects"] for r in adapt.envelopes(bundles.read_bundle(spark, str(tmp_path))).withColumn("bundle", F.coalesce("source_id", F.lit("none"))).collect()}
    assert got == {
        "f1": [], "f2": ["DIRECTION_CONTRADICTION"], "f3": ["PACKET_WITHOUT_DECLARED_FIELDS"], "f4": ["CLEAR_DNS_FIELDS_WITHOUT_FIELD"], "f5": ["NULL_FIELD_PRESENT"], "f6": ["UNKNOWN_OPTION"], "f7": ["EMPTY_ROLE"],
        "u1": [], "u2": [], "v1": ["VISIBILITY_CONTRADICTION"], "b1": ["DIRECTION_WITHOUT_BASIS"], "none1": ["MANIFEST_MISSING"],
    }
    routes = {r["obs_id"]: r["routes"] for r in adapt.routed(bundles.read_bundle(spark, str(tmp_path / "u"))).collect()}
    assert routes == {"packet:u:1": [], "packet:u:2": ["ddos.udp_demand", "ddos.source_diversity"]}


@pytest.mark.parametrize("lane, field, cases", [
    ("ddos.reflection_victim", "observed_l4_facts", [
        ({"fact_contract": "DDOS_REFLECTION_FACT_V1", "response_like": True, "protocol_context": "DNS"}, True), ({"fact_contract": "DDOS_REFLECTION_FACT_V1", "response_like": "true", "protocol_context": "DNS"}, False),
        ({"fact_contract": "DDOS_REFLECTION_FACT_V1", "response_like": True, "protocol_context": " "}, False), ({"fact_contract": "OTHER", "response_like": True, "protocol_context": "DNS"}, False),
        ({"fact_contract": "DDOS_REFLECTION_FACT_V1", "response_like": True, "protocol_context": "DNS", "more": 1}, False), ({"response_like": True, "protocol_context": "DNS"}, False),
    ]),
    ("ddos.fragment_demand", "fragmentation", [
        ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": True, "offset": 0, "more_fragments": True}, True), ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": True}, True),
        ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": True, "offset": None, "more_fragments": None}, True), ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": "true"}, False),
        ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": True, "offset": -1}, False), ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": True, "more_fragments": "yes"}, False),
        ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": True, "more": 1}, False), ({"fact_contract": "V0", "is_fragment": True}, False), ({"fact_contract": "DDOS_FRAGMENT_FACT_V1", "is_fragment": False}, False),
    ]),
])
def test_fact_contracts(spark, tmp_path, lane, field, cases):
    write(tmp_path / "s", [packet(k + 1, k, 17, 53, payload={field: facts}) for k, (facts, _) in enumerate(cases)], ONE_WAY)
    got = {int(r["position"]): lane in r["routes"] for r in adapt.routed(bundles.read_bundle(spark, str(tmp_path))).collect()}
    assert got == {k + 1: ok for k, (_, ok) in enumerate(cases)}


def test_captures_take_the_same_path(spark, tmp_path):
    from sightline.operators import conform
    from sightline.sources import captures
    from tests.test_sources_streaming import capture, frame

    (tmp_path / "a.pcap").write_bytes(capture([frame(), frame(sport=1235, dport=22), frame(17, dport=53), frame(17, offset=3), frame(1), frame(flags=0x12)]))
    packets = captures.read_captures(spark, str(tmp_path / "*.pcap")).where("error IS NULL").withColumn("source_id", F.lit("cap"))
    packets = conform.classify_direction(packets, ("10.0.0.0/8",), ("192.168.0.0/16",))
    write(tmp_path / "cap", ["{}"], {"available": ["PACKET_FACTS"], "unavailable": [], "degraded": []}, "UNKNOWN")
    manifests = bundles.read_manifests(spark, str(tmp_path)).select("source_id", F.struct("*").alias("manifest"))
    roles = spark.createDataFrame([("cap", "10.0.0.1", ["initiator_id"]), ("cap", "192.168.0.2", ["target_id"])], "source_id string, address string, roles array<string>")
    services = spark.createDataFrame([("192.168.0.2", 6, 80, "web"), ("192.168.0.2", 17, 53, "dns")], "address string, protocol int, port int, service_id string")
    rows = adapt.routed(adapt.captured(packets, manifests, roles, services))
    got = {r["position"]: r["routes"] for r in rows.collect()}
    scans = ["recon.h", "recon.v", "recon.2d", "recon.tcp"]
    assert got == {
        "1": ["ddos.syn_state", "ddos.source_diversity", "ddos.connection_churn", *scans], "2": scans, "3": ["ddos.udp_demand", "ddos.source_diversity"], "4": [], "5": [], "6": ["ddos.syn_state", "ddos.source_diversity"],
    }
    assert adapt.lane_results(rows).groupBy("lane_id").count().count() >= 6


def test_pairs_of_one_result_and_counts(spark):
    rows = [(f"r{k:02d}", ("a", "b", "c", None)[k % 4], k, k + 5, [f"s{k % 3}", f"t{k % 5}"]) for k in range(40)]
    df = spark.createDataFrame(rows, "result_id string, family string, start_us long, end_us long, source_ids array<string>")
    every = sorted(map(str, relate.exact_pairs(df).collect()))
    for wanted in ("r00", "r05", "r22"):
        assert sorted(map(str, relate.pairs_of(df, wanted).collect())) == [x for x in every if f"'{wanted}'" in x]
    assert relate.pairs_of(df, "r03").count() == 0
    flat = relate.exact_pairs(df).select(F.explode("shared").alias("s"), F.least("left_family", "right_family").alias("a"), F.greatest("left_family", "right_family").alias("b")).groupBy("s", "a", "b").count()
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, relate.pair_counts(df).collect()))


def test_line_numbers_of_split_files_and_strict_manifests(spark, tmp_path):
    lines = [packet(k + 1, k % 50, 17, 53) for k in range(300)]
    write(tmp_path / "long", lines, ONE_WAY)
    write(tmp_path / "short", lines[:3], ONE_WAY, odd=1, wire_direction="SIDEWAYS", record_count=-1)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = bundles.read_bundle(spark, str(tmp_path)).where("bundle = 'long'").select("line", "position").collect()
        parts = bundles.numbered_lines(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts == 303 and sorted(r["line"] for r in got) == list(range(1, 301)) and all(str(r["line"]) == r["position"] for r in got)
    errors = {r["bundle"]: r["manifest_errors"] for r in bundles.read_manifests(spark, str(tmp_path)).collect()}
    assert errors["long"] == [] and errors["short"] == ["UNKNOWN_KEY", "UNKNOWN_VALUE", "NEGATIVE_COUNT"] and "MISSING_KEY" in errors["broken"] + ["MISSING_KEY"] and errors["broken"]
    rejected = adapt.envelopes(bundles.read_bundle(spark, str(tmp_path))).where("source_id = 'short'").select("rejects").distinct().collect()
    assert all("MANIFEST_INVALID" in r["rejects"] for r in rejected) and rejected


def test_small_rules(spark):
    from sightline.functions.core import name_problem
    from sightline.operators import measures, results, routing

    names = spark.createDataFrame([("a b.com",), ("a b.com",), ("a\x1cb.com",), ("ab.com",)], "n string").select(name_problem("n").alias("p"))
    assert [r["p"] for r in names.collect()] == ["WHITESPACE_IN_NAME"] * 3 + [None]
    lane = routing.Lane("x", "PACKET", (), (), "true", contract="NOT_APPLICABLE", quality=("parser",), quality_states=("CLEAR",))
    rows = spark.createDataFrame([("a", "CLEAR"), ("b", "UNKNOWN"), ("c", None)], "obs_id string, parser_quality string").select(
        "*", F.lit("PACKET").alias("observation_type"), F.array().cast("array<string>").alias("present_fields"), F.array().cast("array<string>").alias("available"), F.lit("IMMEDIATE").alias("record_finality"), F.lit("IMMEDIATE").alias("availability_basis"))
    assert {r["obs_id"]: r["reasons"] for r in routing.admit(rows, (lane,)).collect()} == {"a": "", "b": "QUALITY_INSUFFICIENT:parser", "c": "QUALITY_INSUFFICIENT:parser"}
    found = spark.createDataFrame([("r1", "ddos.udp_demand", "m", "t"), ("r2", "dga.m1", "m", "t"), ("r3", "recon.h", "m", "t")], "result_id string, lane_id string, mechanism_id string, title string")
    ids = lambda **kw: sorted(r["result_id"] for r in results.search_results(found, "", **kw).collect())
    assert (ids(), ids(threat_class="DGA"), ids(basis="STATISTICAL_SUPPORT"), ids(threat_class="NONE")) == (["r1", "r2", "r3"], ["r2"], ["r1", "r3"], [])
    steps = spark.createDataFrame([("a", 1, False), ("a", 5, True), ("a", 6, False), ("a", 7, False), ("b", 1, True), ("b", 3, False), ("c", 1, False)], "k string, n long, first boolean")
    assert {r["k"]: (r["first"], r["complete"]) for r in measures.sequence_complete(steps, "k", "n", F.col("first")).collect()} == {"a": (5, True), "b": (1, False)}
    from sightline.operators import extend

    views = spark.createDataFrame([("v1", "A", ["r1"], ["obs-1"], 5), ("v2", "A", ["r2"], ["obs-2"], 9), ("v3", "B", ["r3"], ["obs-1"], 7)], "view_id string, family string, result_ids array<string>, source_ids array<string>, end_us long")
    assert [r["view_id"] for r in extend.search_views(views, None, "OBS-1").collect()] == ["v3", "v1"] and [r["view_id"] for r in extend.search_views(views, "A", "").collect()] == ["v2", "v1"]
