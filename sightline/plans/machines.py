"""State machines over a handshake view of the events (rows-only checks, tested on fixtures and by a fold of their own), and mechanisms with hooks over flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.core import micros
from sightline.operators import hooks, machines
from sightline.plans.traffic import C2_SQL, FLOW_TTL
from sightline.plans.views import DAY, FLOW_SQL, flows, table
from sightline.streaming.steps import RECURRENCE_OUT, recurrence_step

_VIEW = {
    "obs_id": "concat('e-', CAST(event_id AS STRING))", "target": "concat('t', CAST(user_id % 20 AS STRING))", "service": "concat('s', CAST(user_id % 3 AS STRING))", "protocol": "6",
    "initiator": "concat('i', CAST(user_id AS STRING))", "sport": "CAST(1024 + user_id AS BIGINT)", "dport": "CAST(20 + user_id % 5 AS BIGINT)", "pair": "concat('pair-', CAST(user_id AS STRING))",
    "direction": "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'FORWARD' ELSE 'REVERSE' END",
    "flags": "CASE event_type WHEN 'view' THEN array('SYN') WHEN 'click' THEN array('SYN') WHEN 'signup' THEN array('ACK') WHEN 'purchase' THEN array('SYN', 'ACK') ELSE array('RST') END",
    "signature": "CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) END", "both_visible": "user_id % 2 = 0", "degraded": "value > 95",
}
#: Days stand for the lane's milliseconds: event times are divided by this before the machine runs.
SCALE = 86_400_000 // 1_000


def handshakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(micros("ts") / SCALE).cast("long").alias("us"), *(F.expr(e).alias(n) for n, e in _VIEW.items()))
    return rows.withColumn("degraded", F.coalesce("degraded", F.lit(False)))


def syn_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = handshakes(spark, sf_dir)
    end = rows.agg(F.max("us")).first()[0]
    return machines.syn_state(rows, None if end is None else end + 1).withColumn("support", F.array_join("support", ","))


def recon_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.recon_tcp(handshakes(spark, sf_dir)).withColumn("support", F.array_join("support", ","))


FLOW_KEYS = {"client": "long", "peer": "string"}
#: Days after the first event at which a gap opens for each seventh client, and how many it lasts.
GAP_DAYS, GAP_LENGTH = (3, 11, 12), 2


def registered_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence lane once more, as a mechanism with hooks."""
    step = recurrence_step(FLOW_TTL)
    own = hooks.Hooks(FLOW_KEYS, (), RECURRENCE_OUT, lambda s, r, c: step(s, r), lambda s: s["times"][-1] + FLOW_TTL)
    found = hooks.run_hooks(flows(spark, sf_dir).withColumn("client", F.col("client").cast("long")), own)
    return found.select(F.lit("c2.r1").alias("lane_id"), "client", "peer", F.lit(443).alias("service"), F.lit(6).alias("protocol"), *(c for c in found.columns if c not in ("client", "peer", "support", "quality_degraded")), F.array_join("support", ",").alias("support"))


def _policy(policy: str):
    """How many rows a key has had since it was last forgotten, under a gap policy."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = flows(spark, sf_dir).withColumn("client", F.col("client").cast("long"))
        first = rows.agg(F.min("us").alias("first"))
        named = rows.where("client % 7 = 0").select("client", "peer").distinct().crossJoin(F.broadcast(first))
        day = F.explode(F.array(*map(F.lit, GAP_DAYS))).alias("day")
        gaps = named.select("client", "peer", "first", day).select(
            F.concat_ws("-", F.col("client"), F.col("peer"), F.col("day")).alias("gap_id"), (F.col("first") + F.col("day") * DAY).alias("opened_us"), (F.col("first") + (F.col("day") + GAP_LENGTH) * DAY).alias("closed_us"), "client", "peer")
        counted = hooks.Hooks(FLOW_KEYS, (), "obs_id string, us long, n long", lambda s, r, c: ((s or 0) + 1, [(r["obs_id"], r["us"], (s or 0) + 1)]))
        return hooks.run_hooks(rows, counted, policy, gaps)

    return query


_GAPPED = f"""v AS (SELECT CAST(client AS BIGINT) AS client, peer, us, obs_id FROM ({FLOW_SQL})), f AS (SELECT min(us) AS first FROM v),
days AS (SELECT first + d * {DAY} AS opened, first + (d + {GAP_LENGTH}) * {DAY} AS closed FROM f, (VALUES {', '.join(f'({d})' for d in GAP_DAYS)}) AS t(d)),
g AS (SELECT v.*, (SELECT count(*) FROM days WHERE opened <= us) AS opened, EXISTS (SELECT 1 FROM days WHERE opened <= us AND us < closed) AS held, EXISTS (SELECT 1 FROM days WHERE opened <= us AND us <= closed) AS marked FROM v)"""
RESET_SQL = f"WITH {_GAPPED} SELECT client, peer, obs_id, us, row_number() OVER (PARTITION BY client, peer, CASE WHEN client % 7 = 0 THEN opened END ORDER BY us, obs_id) AS n, marked AS quality_degraded FROM g"
ABSTAIN_SQL = f"WITH {_GAPPED}, c AS (SELECT *, row_number() OVER (PARTITION BY client, peer ORDER BY us, obs_id) AS n FROM g) SELECT client, peer, obs_id, us, n, marked AS quality_degraded FROM c WHERE NOT (held AND client % 7 = 0)"
CONTINUE_SQL = f"WITH {_GAPPED} SELECT client, peer, obs_id, us, row_number() OVER (PARTITION BY client, peer ORDER BY us, obs_id) AS n, marked AS quality_degraded FROM g"
DISABLE_SQL = f"WITH {_GAPPED} SELECT client, peer, obs_id, us, row_number() OVER (PARTITION BY client, peer ORDER BY us, obs_id) AS n, false AS quality_degraded FROM g WHERE opened = 0"

QUERIES = {
    "syn_state": syn_state, "recon_tcp": recon_tcp, "registered_mechanism": registered_mechanism, "gap_reset": _policy("RESET"), "gap_abstain": _policy("ABSTAIN"), "gap_continue": _policy("CONTINUE"), "gap_disable": _policy("DISABLE"),
}
SQL: dict[str, str] = {"registered_mechanism": C2_SQL, "gap_reset": RESET_SQL, "gap_abstain": ABSTAIN_SQL, "gap_continue": CONTINUE_SQL, "gap_disable": DISABLE_SQL}
