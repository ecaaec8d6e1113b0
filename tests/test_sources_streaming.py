"""Readers on files made here, and streams against batch."""

import json
import struct

from pyspark.sql import functions as F

from sightline.operators import demand, extend, machines
from sightline.sources import bundles, captures
from sightline.streaming import stateful, windows


def frame(proto=6, flags=0x02, offset=0, more=False, sport=1234, dport=80):
    l4 = struct.pack(">HHIIBBHHH", sport, dport, 7, 9, 5 << 4, flags, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8, 0) if proto == 17 else b"\x08\x00\x00\x00"
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, (0x2000 if more else 0) | offset, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([192, 168, 0, 2]))
    return b"\0" * 12 + b"\x08\x00" + ip + l4


def capture(frames, cut=0):
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        data += struct.pack("<IIII", 100 + i, 5, len(f), len(f)) + f
    return data[: len(data) - cut]


def test_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([frame(), frame(17), frame(1), frame(17, offset=3), frame(17, more=True), b"\0" * 20], cut=0))
    (tmp_path / "b.pcap").write_bytes(capture([frame(flags=0x12)], cut=3))
    (tmp_path / "c.pcap").write_bytes(b"not a capture")
    rows = {(r["path"][-6:], r["position"]): r for r in captures.read_captures(spark, str(tmp_path / "*.pcap")).collect()}
    a = rows["a.pcap", "1"]
    assert (a["src"], a["dst"], a["sport"], a["dport"], a["flags"], a["seq"], a["ack"], a["us"], a["is_fragment"]) == ("10.0.0.1", "192.168.0.2", 1234, 80, ["SYN"], 7, 9, 100_000_005, False)
    assert rows["a.pcap", "2"]["dport"] == 80 and rows["a.pcap", "3"]["icmp_type"] == 8
    assert rows["a.pcap", "4"]["dport"] is None and rows["a.pcap", "4"]["is_fragment"] and rows["a.pcap", "5"]["is_fragment"]
    assert rows["a.pcap", "6"]["error"] == "NOT_IPV4" and rows["b.pcap", "1"]["error"] == "TRUNCATED_RECORD" and rows["c.pcap", "0"]["error"] == "NOT_A_CAPTURE_FILE"


def record(**kw):
    base = {"schema_version": "1", "finality": "IMMEDIATE", "observation_type": "PACKET", "position": 1, "timestamp": "2024-01-01T00:00:00Z", "declared_observed_fields": ["protocol"], "payload": {"protocol": 6}}
    return json.dumps({**base, **kw})


def test_bundles(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    (d / "manifest.json").write_text(json.dumps({"source_id": "s1", "record_count": 2, "quality": {"packet_loss": "CLEAR"}}))
    lines = [record(), record(extra=1), record(observation_type="X"), record(payload={"protocol": 6, "odd": 1}), record(declared_observed_fields=["protocol", "protocol"]), record(declared_observed_fields=["flags"]), "nonsense", record(timestamp="soon")]
    (d / "records.ndjson").write_text("\n".join(lines) + "\n")
    got = [r["errors"] for r in bundles.read_bundle(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [[], ["UNKNOWN_KEY"], ["UNKNOWN_TYPE"], ["UNKNOWN_PAYLOAD_FIELD"], ["REPEATED_FIELD"], ["DECLARED_FIELD_ABSENT"], ["NOT_AN_OBJECT"], ["BAD_TIMESTAMP"]]
    first = bundles.read_bundle(spark, str(tmp_path)).orderBy("line").first()
    assert first["packet"]["protocol"] == 6 and first["manifest"]["source_id"] == "s1"
    q = bundles.read_bundle_stream(spark, str(d)).writeStream.format("memory").queryName("bundle_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("bundle_rows").count() == len(lines)


def test_window_stream_equals_batch(spark, tmp_path):
    rows = [(i * 300_000, f"p{i}", "t", "s", "FORWARD", 17, None if i == 4 else i, "CLEAR", "AVAILABLE") for i in range(20)]
    schema = "us long, obs_id string, target string, service string, direction string, protocol int, bytes long, quality string, reverse string"
    df = spark.createDataFrame(rows, schema)
    for k in range(4):
        df.where((F.col("us") / 1_500_000).cast("int") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("event_time", F.timestamp_micros("us"))
    q = windows.demand_stream(stream, demand.LANES["udp_demand"], "1 second", "1 second").writeStream.format("memory").queryName("demand_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r["window_start"], r["packet_count"], r["byte_count"]) for r in spark.table("demand_rows").collect()}
    batch = demand.demand_window(df, demand.LANES["udp_demand"], 1_000_000)
    closed = max(r[0] for r in rows) - 1_000_000
    want = {(r["window_start"], r["packet_count"], r["byte_count"]) for r in batch.collect() if r["window_start"] + 1_000_000 <= closed}
    assert got == want and len(want) == 4


def test_late_rows_go_aside_and_equality_is_on_time(spark):
    good, late = [], []
    s = windows.LateSplitter(lambda d, e: good.extend(r["us"] for r in d.collect()), lambda d, e: late.extend((r["us"], r["watermark_us"]) for r in d.collect()))
    for n, batch in enumerate(([5], [4, 5, 7], [6, 7])):
        s(spark.createDataFrame([(x,) for x in batch], "us long"), n)
    assert sorted(good) == [5, 5, 7, 7] and late == [(4, 5), (6, 7)]


def test_late_boundary_survives_a_restart_and_a_repeated_batch(spark, tmp_path):
    def run(epoch, values):
        good, late = [], []
        s = windows.LateSplitter(lambda d, e: good.extend(r["us"] for r in d.collect()), lambda d, e: late.extend(r["us"] for r in d.collect()), str(tmp_path / "tops"))
        s(spark.createDataFrame([(x,) for x in values], "us long"), epoch)
        return sorted(good), sorted(late)

    assert run(0, [5, 3]) == ([3, 5], []) and run(1, [4, 9]) == ([9], [4])
    assert run(1, [4, 9]) == ([9], [4]) and run(2, [8, 9]) == ([9], [8])


def test_side_outputs_of_a_repeated_batch_stay_once(spark, tmp_path):
    rows = spark.createDataFrame([("LATE_EVENT_OBSERVED", "l", "o1", 1, "x"), ("QUALITY_GAP", "l", "o2", 2, "y")], "kind string, lane_id string, obs_id string, us long, detail string")
    for epoch in (0, 0, 1):
        extend.write_side_outputs(rows, str(tmp_path / "control"), str(tmp_path / "gaps"), epoch)
    assert spark.read.parquet(str(tmp_path / "control")).count() == 2 and {r["opened_us"] for r in spark.read.parquet(str(tmp_path / "gaps")).collect()} == {2}


def test_steps_survive_json():
    s, _ = machines.step_syn(None, dict(us=0, obs_id="a", direction="FORWARD", flags=["SYN"], signature=None, both_visible=True, degraded=False))
    assert machines.SynState(**json.loads(json.dumps(s.__dict__))) == s
    assert stateful.KeyedOrder(stateful.SYN).columns[4] == "obs_id"
