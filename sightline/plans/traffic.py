"""Queries over packets and flows: demand windows, scan breadth, recurrence, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import demand, history
from sightline.plans.views import DAY, FLOW_SQL, PACKET_SQL, flows, packets

FLOW_KEYS = ("client", "peer", "service", "protocol")
FLOW_TTL = 5 * DAY
#: Scan attempts of the packet view: forward SYN without ACK; days stand for the lanes' seconds.
ATTEMPTS = "protocol = 6 AND direction = 'FORWARD' AND flag_text = 'SYN'"
HORIZONS = (60, 3600 * 24 * 30)
RECON_TTL = 3600 * 24 * 60


#: Some packets have no known direction, target or service: no window lane may count them.
UNSURE = {"direction": "CASE WHEN bytes % 10 = 3 THEN 'UNKNOWN' ELSE direction END", "target": "CASE WHEN bytes % 10 = 4 THEN NULL ELSE target END", "service": "CASE WHEN bytes % 10 = 5 THEN NULL ELSE service END"}
#: The window lanes' rules once more, by hand.
_HERE = "direction IN ('FORWARD', 'REVERSE') AND target IS NOT NULL AND service IS NOT NULL"
ADMITS = {
    "udp_demand": f"protocol = 17 AND {_HERE}",
    "reflection_victim": f"protocol = 17 AND direction = 'FORWARD' AND response_like AND trim(protocol_context) <> '' AND src <> '' AND {_HERE}",
    "source_diversity": f"src <> '' AND protocol >= 0 AND protocol <= 255 AND {_HERE}",
    "icmp_demand": f"protocol = 1 AND {_HERE}",
    "fragment_demand": f"is_fragment AND {_HERE}",
    "connection_churn": f"protocol = 6 AND direction = 'FORWARD' AND flag_text = 'SYN' AND {_HERE}",
}


def _window(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = packets(spark, sf_dir).withColumns({c: F.expr(e) for c, e in UNSURE.items()})
        return demand.closed_only(demand.demand_window(rows, demand.LANES[name], DAY), rows)

    return query


def _window_sql(name: str, unsure: bool = True) -> str:
    lane, admit = demand.LANES[name], ADMITS[name]
    rows = f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in UNSURE.items())}) FROM ({PACKET_SQL})" if unsure else PACKET_SQL
    keys = [*demand.KEYS, *lane.keys]
    distinct = f", count(DISTINCT {lane.distinct}) AS d" if lane.distinct else ""
    counted = f"least(d, {demand.CAP}) AS distinct_count, d > {demand.CAP} AS capacity_reached," if lane.distinct else ""
    full = f" OR d > {demand.CAP}" if lane.distinct else ""
    further = f"CASE WHEN d > {demand.CAP} THEN '{'further_tuples' if name == 'connection_churn' else 'further_sources'}' END" if lane.distinct else "NULL"
    return f"""
WITH v AS ({rows}),
w AS (SELECT {', '.join(keys)}, us - us % {DAY} AS window_start, count(*) AS packet_count, CAST(sum(bytes) AS BIGINT) AS observed_bytes,
  count(bytes) AS known_lengths, count(*) - count(bytes) AS missing_lengths, min(bytes) AS lo, max(bytes) AS hi,
  array_to_string(list_sort(list(DISTINCT CAST(protocol AS VARCHAR))), ',') AS protocols,
  first(obs_id ORDER BY us, obs_id) AS first_id, last(obs_id ORDER BY us, obs_id) AS last_id, min(us) AS first_us, max(us) AS last_us,
  first(reverse ORDER BY us, obs_id, reverse) AS reverse, max(CASE quality WHEN 'DEGRADED' THEN 2 WHEN 'CLEAR' THEN 0 ELSE 1 END) AS q{distinct}
  FROM v WHERE {admit} GROUP BY ALL)
SELECT '{lane.lane}' AS lane_id, {', '.join(keys)}, window_start, window_start + {DAY} AS window_end, packet_count, observed_bytes, known_lengths, missing_lengths,
  CASE WHEN missing_lengths = 0 THEN observed_bytes END AS byte_count,
  CASE WHEN missing_lengths = 0 THEN round(observed_bytes / known_lengths, 6) END AS mean_bytes,
  CASE WHEN missing_lengths = 0 THEN lo END AS min_bytes, CASE WHEN missing_lengths = 0 THEN hi END AS max_bytes,
  protocols, first_id, last_id, first_us, last_us, reverse, CASE q WHEN 2 THEN 'DEGRADED' WHEN 1 THEN 'UNKNOWN' ELSE 'CLEAR' END AS quality,
  q = 2 AS lower_bound, {counted}
  CASE WHEN q = 2{full} THEN 'QUALITY_DEGRADED' ELSE 'REVIEW_FINDING' END AS result_type,
  concat_ws(',', CASE WHEN missing_lengths > 0 THEN 'packet_length' END, CASE WHEN q = 2{full} THEN 'complete_coverage' END, {further}) AS missing_evidence
FROM w WHERE window_start + {DAY} <= (SELECT max(us) + 1 FROM v)"""


def closing_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir)
    windows = demand.demand_window(rows, demand.LANES["udp_demand"], DAY)
    return demand.closing_boundary(windows, rows).select("target", "service", "direction", "window_end", "created_us")


CLOSING_SQL = f"""
WITH v AS ({PACKET_SQL}),
e AS (SELECT DISTINCT target, service, direction, us - us % {DAY} + {DAY} AS window_end FROM v WHERE protocol = 17),
t AS (SELECT DISTINCT us FROM v),
m AS (SELECT max(us) + 1 AS last FROM v),
b AS (SELECT d.window_end, (SELECT min(us) FROM t WHERE us >= d.window_end) AS nxt FROM (SELECT DISTINCT window_end FROM e) d)
SELECT target, service, direction, window_end, coalesce(nxt, last) AS created_us
FROM e JOIN b USING (window_end), m WHERE nxt IS NOT NULL OR last >= window_end"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).where(ATTEMPTS).select("us", "obs_id", F.col("src").alias("initiator"), "target", "dport", "protocol", "quality")


def _recon(lane: str):
    return lambda spark, sf_dir: history.recon(_attempts(spark, sf_dir), lane, HORIZONS, ttl_s=RECON_TTL)


def _recon_sql(lane: str) -> str:
    keys, counted = history.RECON[lane]
    k = ", ".join(keys)
    field = lambda c: "{" + ", ".join(f"'{f}': x.{f}" for f in c) + "}"
    distinct = "".join(f", len(list_distinct(list_transform(inside, lambda x: {field(c)}))) AS distinct_{n}" for n, c in counted.items())
    return f"""
WITH v AS ({PACKET_SQL}),
a AS (SELECT us, obs_id, src AS initiator, target, dport, protocol, quality FROM v WHERE {ATTEMPTS}),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {k} ORDER BY us, obs_id) >= {RECON_TTL * 10**6} THEN 1 ELSE 0 END AS br FROM a),
s AS (SELECT *, sum(br) OVER (PARTITION BY {k} ORDER BY us, obs_id) AS session_no FROM b),
h AS (SELECT *, list({{'us': us, 'target': target, 'dport': dport, 'quality': quality}}) OVER (PARTITION BY {k}, session_no ORDER BY us, obs_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS recent,
  CASE WHEN lag(us, 16) OVER (PARTITION BY {k}, session_no ORDER BY us, obs_id) >= us - {max(HORIZONS) * 10**6} THEN 1 ELSE 0 END AS pushed FROM s),
d AS (SELECT *, CAST(sum(pushed) OVER (PARTITION BY {k}, session_no ORDER BY us, obs_id) AS BIGINT) AS dropped,
  list_filter(recent, lambda x: x.us >= us - {max(HORIZONS) * 10**6}) AS history FROM h),
i AS (SELECT d.*, horizon_s, list_filter(history, lambda x: x.us >= d.us - CAST(horizon_s AS BIGINT) * 1000000) AS inside FROM d, (VALUES {', '.join(f'({x})' for x in HORIZONS)}) AS hz(horizon_s))
SELECT '{lane}' AS lane_id, obs_id, us, horizon_s, len(inside) AS attempts{distinct}, len(history) AS retained, dropped, dropped > 0 AS truncated,
  array_to_string(list_sort(list_distinct(list_transform(history, lambda x: x.quality))), ',') AS quality_states,
  list_contains(list_transform(history, lambda x: x.quality), 'DEGRADED') AS lower_bound FROM i"""


def c2_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recurrence(flows(spark, sf_dir), FLOW_KEYS, FLOW_TTL).withColumn("support", F.array_join("support", ","))


C2_SQL = f"""
WITH v AS ({FLOW_SQL}),
b AS (SELECT *, CASE WHEN us - lag(us) OVER w >= {FLOW_TTL} THEN 1 ELSE 0 END AS br FROM v WINDOW w AS (PARTITION BY client, peer ORDER BY us, obs_id)),
s AS (SELECT *, sum(br) OVER (PARTITION BY client, peer ORDER BY us, obs_id) AS session_no FROM b),
h AS (SELECT *, list(us) OVER f AS times, list(obs_id) OVER f AS ids, row_number() OVER (PARTITION BY client, peer, session_no ORDER BY us, obs_id) AS ver FROM s
  WINDOW f AS (PARTITION BY client, peer, session_no ORDER BY us, obs_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN len(times) >= 3 THEN list_transform(range(1, len(times)), lambda i: times[i + 1] - times[i]) END AS gaps FROM h),
m AS (SELECT *, CAST(list_aggregate(gaps, 'median') AS DOUBLE) AS med FROM g)
SELECT 'c2.r1' AS lane_id, client, peer, service, protocol, obs_id, us, len(times) AS event_count,
  CASE WHEN len(times) >= 3 THEN 'REVIEW_FINDING' ELSE 'INSUFFICIENT_EVIDENCE' END AS result_type,
  CASE WHEN len(times) < 3 THEN 3 - len(times) END AS missing_events,
  CASE WHEN len(times) >= 3 THEN times[len(times)] - times[1] END AS span_us, CASE WHEN len(times) >= 3 THEN len(times) - 1 END AS interval_count,
  med AS median_us, CASE WHEN len(times) >= 3 THEN list_aggregate(list_transform(gaps, lambda x: abs(x - med)), 'median') END AS mad_us,
  CASE WHEN ver > 1 THEN ver - 1 END AS state_version,
  array_to_string(list_concat([obs_id], list_filter(ids, lambda x: x <> obs_id)), ',') AS support FROM m"""


def ttl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.spread_sessions(flows(spark, sf_dir), FLOW_KEYS, FLOW_TTL)
    return rows.groupBy(*FLOW_KEYS, "session_no").agg(F.count("*").alias("events"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


SESSIONS_SQL = f"""
WITH v AS ({FLOW_SQL}),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client, peer ORDER BY us, obs_id) >= {FLOW_TTL} THEN 1 ELSE 0 END AS br FROM v),
s AS (SELECT *, CAST(sum(br) OVER (PARTITION BY client, peer ORDER BY us, obs_id) AS BIGINT) AS session_no FROM b)
SELECT client, peer, service, protocol, session_no, count(*) AS events, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY ALL"""

QUERIES = {name: _window(name) for name in demand.LANES} | {
    "closing_boundary": closing_boundary, "recon_h": _recon("recon.h"), "recon_v": _recon("recon.v"), "recon_2d": _recon("recon.2d"),
    "c2_recurrence": c2_recurrence, "ttl_sessions": ttl_sessions,
}
SQL = {name: _window_sql(name) for name in demand.LANES} | {
    "closing_boundary": CLOSING_SQL, "recon_h": _recon_sql("recon.h"), "recon_v": _recon_sql("recon.v"), "recon_2d": _recon_sql("recon.2d"),
    "c2_recurrence": C2_SQL, "ttl_sessions": SESSIONS_SQL,
}
