"""Keyed lanes as streams give the rows of the batch operators, whatever the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import history, machines
from sightline.streaming import stateful

SECOND = 1_000_000
FAR = 40_000 * SECOND


def run(spark, tmp_path, rows, schema, make, name):
    """make(stream) over files that hold the rows shuffled within two seconds' delay, then one far later row."""
    rng, us = random.Random(7), schema.split(", ").index("us long")
    rows = sorted(rows, key=lambda r: r[us] + rng.randrange(1_500_000))
    step = -(-len(rows) // 5)
    for n, part in enumerate([rows[i : i + step] for i in range(0, len(rows), step)] + [[tuple(FAR if i == us else v for i, v in enumerate(rows[0]))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*")).withColumn("event_time", F.timestamp_micros("us"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return spark.table(name).where(F.col("us") < FAR)


def same(got, want):
    columns = sorted(want.columns)
    plain = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert plain(want) and plain(got) == plain(want)


def test_handshakes(spark, tmp_path):
    rng = random.Random(1)
    kinds = [("FORWARD", ["SYN"]), ("REVERSE", ["SYN", "ACK"]), ("FORWARD", ["ACK"]), ("REVERSE", ["RST"]), ("FORWARD", ["SYN"])]
    rows = [("t", "s", 6, f"k{rng.randrange(3)}", rng.randrange(30 * SECOND), f"p{i:03d}", *rng.choice(kinds), rng.choice([None, "a"]), rng.random() < 0.7, rng.random() < 0.1) for i in range(120)]
    schema = "target string, service string, protocol int, pair string, us long, obs_id string, direction string, flags array<string>, signature string, both_visible boolean, degraded boolean"
    same(run(spark, tmp_path, rows, schema, lambda s: stateful.syn_state_stream(s, "2 seconds"), "syn_rows"), machines.syn_state(spark.createDataFrame(rows, schema)))


def test_scan_outcomes(spark, tmp_path):
    rng = random.Random(2)
    kinds = [("FORWARD", ["syn"]), ("REVERSE", ["ACK", "SYN"]), ("FORWARD", ["ACK"]), ("REVERSE", ["RST"]), ("FORWARD", ["FIN"])]
    rows = [("i", "t", 1, rng.randrange(2), 6, rng.randrange(9_000 * SECOND), f"p{i:03d}", *rng.choice(kinds)) for i in range(120)]
    schema = "initiator string, target string, sport long, dport long, protocol int, us long, obs_id string, direction string, flags array<string>"
    same(run(spark, tmp_path, rows, schema, lambda s: stateful.recon_tcp_stream(s, "2 seconds"), "tcp_rows"), machines.recon_tcp(spark.createDataFrame(rows, schema)))


@pytest.mark.parametrize("lane", ["recon.h", "recon.2d"])
def test_scan_breadth(spark, tmp_path, lane):
    rng = random.Random(3)
    rows = [(f"i{rng.randrange(2)}", f"t{rng.randrange(9)}", rng.randrange(3), 6, rng.choice([0, 9_000 * SECOND]) + rng.randrange(300 * SECOND), f"p{i:03d}", rng.choice(["CLEAR", "DEGRADED"])) for i in range(150)]
    schema = "initiator string, target string, dport int, protocol int, us long, obs_id string, quality string"
    same(run(spark, tmp_path, rows, schema, lambda s: stateful.recon_stream(s, lane, "2 seconds"), "scan_" + lane[-1]), history.recon(spark.createDataFrame(rows, schema), lane))


def test_recurrence(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(3)}", rng.choice([0, 5_000 * SECOND]) + rng.randrange(200 * SECOND), f"f{i:03d}") for i in range(150)]
    schema, keys = "client string, us long, obs_id string", {"client": "string"}
    same(run(spark, tmp_path, rows, schema, lambda s: stateful.recurrence_stream(s, keys, 3_600 * SECOND, "2 seconds"), "again_rows"), history.recurrence(spark.createDataFrame(rows, schema), ("client",), 3_600 * SECOND))
