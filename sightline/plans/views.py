"""Deterministic views over the driver's tables: packets, flows, transfers, names, sessions.

Each view is one list of expressions that Spark and DuckDB read alike; only the time column differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.core import micros

DAY = 86_400_000_000
SECOND = 1_000_000

PACKET = {
    "obs_id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))",
    "source_id": "concat('sensor-', CAST(l_suppkey % 4 AS STRING))",
    "src": "concat('10.', CAST(o_custkey % 200 AS STRING), '.', CAST(o_custkey % 250 AS STRING), '.', CAST(o_custkey % 7 AS STRING))",
    "target": "concat('192.168.', CAST(l_suppkey % 16 AS STRING), '.', CAST(l_suppkey % 100 AS STRING))",
    "sport": "1024 + l_orderkey % 60000",
    "dport": "20 + l_partkey % 50",
    "service": "concat('svc-', CAST(20 + l_partkey % 50 AS STRING))",
    "protocol": "CASE l_linenumber % 4 WHEN 3 THEN 17 WHEN 0 THEN 1 ELSE 6 END",
    "direction": "CASE l_returnflag WHEN 'N' THEN 'FORWARD' ELSE 'REVERSE' END",
    "flag_text": "CASE l_returnflag WHEN 'N' THEN 'SYN' WHEN 'A' THEN 'SYN,ACK' ELSE 'RST' END",
    "bytes": "CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END",
    "is_fragment": "l_tax = 0.08",
    "quality": "CASE WHEN l_tax = 0 THEN 'DEGRADED' WHEN l_tax = 0.01 THEN 'UNKNOWN' ELSE 'CLEAR' END",
    "reverse": "CASE l_linestatus WHEN 'F' THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END",
    "response_like": "l_linestatus = 'F' OR l_linenumber = 7",
    "protocol_context": "CASE l_partkey % 3 WHEN 0 THEN 'DNS' WHEN 1 THEN 'NTP' ELSE ' ' END",
    "flow_tuple": "concat_ws('|', CAST(o_custkey AS STRING), CAST(1024 + l_orderkey % 60000 AS STRING), CAST(l_suppkey AS STRING), CAST(20 + l_partkey % 50 AS STRING))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (micros("o_orderdate") + F.col("l_linenumber") * SECOND).alias("us"), *(F.expr(e).alias(n) for n, e in PACKET.items()),
    ).withColumn("flags", F.split("flag_text", ","))


def duck(expression: str) -> str:
    return expression.replace("STRING", "VARCHAR")


PACKET_SQL = (
    f"SELECT CAST(epoch_us(o_orderdate) AS BIGINT) + l_linenumber * {SECOND} AS us, "
    + ", ".join(f"{duck(e)} AS {n}" for n, e in PACKET.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)

FLOW = {"obs_id": "concat('flow-', CAST(event_id AS STRING))", "client": "user_id", "peer": "event_type", "quality": "CASE WHEN event_id % 17 = 0 THEN 'DEGRADED' ELSE 'CLEAR' END"}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(micros("ts").alias("us"), *(F.expr(e).alias(n) for n, e in FLOW.items()), F.lit(443).alias("service"), F.lit(6).alias("protocol"))


FLOW_SQL = "SELECT CAST(epoch_us(ts) AS BIGINT) AS us, " + ", ".join(f"{duck(e)} AS {n}" for n, e in FLOW.items()) + ", 443 AS service, 6 AS protocol FROM events"

TRANSFER = {
    "obs_id": PACKET["obs_id"],
    "start_us": "CAST(l_orderkey AS BIGINT) * 1000000",
    "end_us": "CAST(l_orderkey AS BIGINT) * 1000000 + (l_linenumber - 1) * 1000000 - CASE WHEN l_tax = 0.08 AND l_linenumber = 1 THEN 1 ELSE 0 END",
    "bytes_c2s": "CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_tax = 0.07 AND l_linenumber = 2 THEN -1 ELSE 1 END",
    "packets_c2s": "CAST(l_quantity AS BIGINT)",
    "bytes_s2c": "CAST(l_partkey AS BIGINT)",
    "packets_s2c": "CAST(l_suppkey AS BIGINT)",
    "forward": "CASE WHEN l_linestatus = 'O' THEN 'AVAILABLE' WHEN l_partkey % 2 = 0 THEN 'DEGRADED' ELSE 'UNAVAILABLE' END",
    "backward": "CASE WHEN l_returnflag = 'R' THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END",
    "semantics": "CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'BIDIRECTIONAL_COUNTERS' END",
}


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(n) for n, e in TRANSFER.items()))


TRANSFER_SQL = "SELECT " + ", ".join(f"{duck(e)} AS {n}" for n, e in TRANSFER.items()) + " FROM lineitem"

#: The host of a url, upper-cased or dotted for some rows so that every name rule is met.
HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
NAME = {
    "obs_id": "concat('dns-', CAST(page_id AS STRING))",
    "qname": f"CASE page_id % 8 WHEN 0 THEN upper({HOST}) WHEN 1 THEN concat({HOST}, '.') WHEN 2 THEN concat('a..', {HOST}) WHEN 3 THEN concat(' ', {HOST}) "
    f"WHEN 4 THEN CASE WHEN page_id % 16 = 4 THEN '' ELSE '.' END WHEN 5 THEN concat('x1-', CAST(page_id * 7919 AS STRING), '.', {HOST}) ELSE {HOST} END",
}


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(*(F.expr(e).alias(n) for n, e in NAME.items()))


NAME_SQL = "SELECT " + ", ".join(f"{duck(e)} AS {n}" for n, e in NAME.items()) + " FROM pages"
