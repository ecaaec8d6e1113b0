"""Queries over names, transfers, sessions, scores and operating measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.core import micros
from sightline.operators import flowlanes, lexical, measures
from sightline.plans.views import DAY, NAME_SQL, TRANSFER_SQL, names, table, transfers

SUFFIXES, NEW_SUFFIXES = ("com", "net", "org"), ("com", "org", "example.com", "io")


def _suffixes(spark: SparkSession, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "suffix string")


def dns_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flowlanes.dns_structure(names(spark, sf_dir)).select("obs_id", "canonical", "problem", "label_count")
    return rows


_CANON = "CASE WHEN qname = '' THEN 'EMPTY_NAME' WHEN qname = '.' THEN 'ROOT_NAME_NOT_APPLICABLE' WHEN regexp_matches(qname, '\\s') THEN 'WHITESPACE_IN_NAME' WHEN starts_with(qname, '.') OR contains(qname, '..') OR ends_with(regexp_replace(qname, '\\.$', ''), '.') THEN 'EMPTY_LABEL' END"
_NAMES = f"n AS (SELECT *, {_CANON} AS problem FROM ({NAME_SQL})), c AS (SELECT *, CASE WHEN problem IS NULL THEN regexp_replace(lower(qname), '\\.$', '') END AS canonical FROM n), p AS (SELECT *, string_split(canonical, '.') AS parts FROM c)"
CANONICAL_SQL = f"WITH {_NAMES} SELECT obs_id, canonical, problem, len(parts) AS label_count FROM p"
_count = lambda p: f"len(regexp_extract_all(canonical, '{p}'))"
STRUCTURE_SQL = f"""WITH {_NAMES} SELECT obs_id, problem, canonical, length(canonical) AS name_length, len(parts) AS label_count, list_max(list_transform(parts, lambda x: length(x))) AS max_label_length, length(parts[1]) AS left_label_length,
  len(parts) - 1 AS boundaries, {_count('[a-z]')} AS letters, {_count('[0-9]')} AS digits, {_count('-')} AS hyphens, {_count('[^a-z0-9.-]')} AS others,
  round({_count('[0-9]')} / length(replace(canonical, '.', '')), 6) AS digit_fraction, round({_count('-')} / length(replace(canonical, '.', '')), 6) AS hyphen_fraction,
  regexp_matches(parts[1], '^[a-z2-7]+$') AS base32_like, regexp_matches(parts[1], '^[A-Za-z0-9+/_-]+$') AS base64_like FROM p"""

_PROBLEM = "CASE WHEN trim(semantics) = '' THEN 'EMPTY_COUNTER_SEMANTICS' WHEN end_us < start_us THEN 'END_BEFORE_START' WHEN least(bytes_c2s, packets_c2s, bytes_s2c, packets_s2c) < 0 THEN 'NEGATIVE_COUNTER' END"
_TRANSFERS = f"t AS (SELECT *, {_PROBLEM} AS problem, (end_us - start_us) / 1e6 AS duration_s FROM ({TRANSFER_SQL}) WHERE forward IN ('AVAILABLE', 'DEGRADED'))"
_shown = {c: (c if c.endswith("c2s") else f"CASE WHEN backward = 'AVAILABLE' THEN {c} END") for c in flowlanes.COUNTERS}
TRANSFER_RESULT_SQL = f"WITH {_TRANSFERS} SELECT obs_id, duration_s, {', '.join(f'{e} AS {c}' for c, e in _shown.items())}, CASE WHEN backward = 'AVAILABLE' THEN 'BOTH' ELSE 'FORWARD_ONLY' END AS direction_scope, " + ", ".join(
    f"CASE WHEN duration_s > 0 THEN round({e} / duration_s, 6) END AS {c}_per_second" for c, e in _shown.items()) + " FROM t WHERE problem IS NULL"
TRANSFER_REJECT_SQL = f"WITH {_TRANSFERS} SELECT obs_id, problem FROM t WHERE problem IS NOT NULL"

_TLS = {"obs_id": "concat('tls-', CAST(page_id AS STRING))", "server_name": "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)", "alpn": "CASE page_id % 3 WHEN 0 THEN 'h2' ELSE 'http/1.1' END", "version": "CASE page_id % 2 WHEN 0 THEN 'TLS1.3' ELSE 'TLS1.2' END"}


def tls_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://")).select(*(F.expr(e).alias(n) for n, e in _TLS.items()), F.expr("CASE page_id % 5 WHEN 0 THEN array('version') WHEN 1 THEN array('version', 'alpn') ELSE array('version', 'alpn', 'server_name') END").alias("present_fields"))
    return flowlanes.tls_context(rows, ("server_name", "alpn", "version"))


TLS_SQL = "WITH v AS (SELECT page_id, " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in _TLS.items()) + " FROM pages WHERE starts_with(url, 'https://')) SELECT obs_id, CASE WHEN page_id % 5 > 1 THEN server_name END AS server_name, CASE WHEN page_id % 5 > 0 THEN alpn END AS alpn, version FROM v"


def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flowlanes.registrable_domain(names(spark, sf_dir), _suffixes(spark, SUFFIXES))


def _domain_cte(tag: str, values: tuple[str, ...]) -> str:
    known = ", ".join(f"'{v}'" for v in values)
    return f"""{tag} AS (SELECT obs_id, canonical, problem, parts, list_max(list_filter(range(1, len(parts) + 1), lambda k: array_to_string(parts[len(parts) - k + 1:], '.') IN ({known}))) AS k FROM p),
{tag}r AS (SELECT obs_id, canonical, coalesce(problem, CASE WHEN regexp_matches(canonical, '[^\\x00-\\x7f]') THEN 'UNICODE_IDNA_POLICY_UNRESOLVED' WHEN k IS NULL THEN 'UNKNOWN_OR_INTERNAL_SUFFIX' WHEN len(parts) <= k THEN 'NO_REGISTRABLE_DOMAIN' END) AS reason, parts, k FROM {tag})"""


_domain = "CASE WHEN reason IS NULL THEN array_to_string(parts[len(parts) - k:], '.') END"
DOMAIN_SQL = f"WITH {_NAMES}, {_domain_cte('a', SUFFIXES)} SELECT obs_id, canonical, {_domain} AS registrable, reason FROM ar"
AUDIT_SQL = f"""WITH {_NAMES}, {_domain_cte('a', SUFFIXES)}, {_domain_cte('b', NEW_SUFFIXES)},
x AS (SELECT obs_id, {_domain} AS old FROM ar), y AS (SELECT obs_id, {_domain} AS new FROM br),
z AS (SELECT obs_id, CASE WHEN old IS NULL OR new IS NULL THEN 'UNAVAILABLE' WHEN old = new THEN 'EXACT' ELSE 'CHANGED' END AS category FROM x JOIN y USING (obs_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY obs_id) AS n FROM z)
SELECT category, count(*) AS names, string_agg(obs_id, ',' ORDER BY obs_id) FILTER (WHERE n <= 10) AS examples FROM r GROUP BY category"""

_WEIGHT = "(ascii(substr(gram, 1, 1)) * 31 + ascii(substr(gram, 2, 1)) * 17) % 41 - 20"


def ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are a fixed rule over the pages' own bigrams, kept for two thirds of them."""
    rows = names(spark, sf_dir).withColumn("text", flowlanes.canonical_name("qname"))
    grams = rows.select(F.explode(lexical.ngrams("text", (2,))).alias("gram")).distinct()
    weights = grams.withColumn("weight", F.expr(_WEIGHT) / 64.0).where(F.expr(f"({_WEIGHT}) % 3 <> 0"))
    return lexical.score_grams(rows, weights, "obs_id", "text", -0.5, (2,))


NGRAM_SQL = f"""WITH {_NAMES}, g AS (SELECT obs_id, canonical, unnest(list_transform(range(1, length(canonical)), lambda i: substr(canonical, i, 2))) AS gram FROM p),
k AS (SELECT obs_id, count(*) AS known, sum(({_WEIGHT}) / 64.0) AS s FROM g WHERE ({_WEIGHT}) % 3 <> 0 GROUP BY obs_id)
SELECT obs_id, CASE WHEN canonical IS NOT NULL THEN round(1 / (1 + exp(-(-0.5 + coalesce(s, 0)))), 9) END AS score, CASE WHEN canonical IS NOT NULL THEN coalesce(known, 0) END AS known_grams FROM p LEFT JOIN k USING (obs_id)"""

_SCORE = "((n_chars * 37 + doc_id * 11) % 1009) / 1009.0 * 0.6 + quality * 0.3"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("label"), F.expr(f"round(CAST({_SCORE} AS DOUBLE), 3)").alias("score"), F.col("lang").alias("split"))


_SCORED = f"v AS (SELECT l.doc_id, quality AS label, round(CAST({_SCORE} AS DOUBLE), 3) AS score, lang AS split FROM labels l JOIN (SELECT doc_id, n_chars, lang FROM documents) d ON l.doc_id = d.doc_id)".replace("doc_id * 11", "l.doc_id * 11")
METRICS_SQL = f"""WITH {_SCORED}, t AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM v)
SELECT tp + fp + fn + tn AS rows, tp + fn AS positive, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0 END AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM t"""
AUROC_SQL = f"WITH {_SCORED}, g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM v GROUP BY score), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 9) AS auroc FROM b"
AP_SQL = f"WITH {_SCORED}, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM v GROUP BY score), b AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS al FROM g) SELECT round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(al AS DOUBLE)) / CAST(sum(pos) AS DOUBLE), 9) AS average_precision FROM b"
QUANTILES_SQL = f"WITH {_SCORED} SELECT split, count(*) AS rows, " + ", ".join(f"round(quantile_cont(score, {q}), 9) AS {n}" for n, q in (("q01", 0.01), ("q05", 0.05), ("q50", 0.5), ("q95", 0.95), ("q99", 0.99))) + ", round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS share_from_half FROM v GROUP BY split"
DELTA_SAMPLES = 100


def model_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("score").alias("old"), F.round(F.col("score") * 0.9 + (F.col("doc_id") % 10) / 100, 3).alias("new"))
    return lexical.model_delta(rows, DELTA_SAMPLES)


DELTA_SQL = f"WITH {_SCORED}, r AS (SELECT doc_id AS key, score AS old, round(score * 0.9 + (doc_id % 10) / 100, 3) AS new, row_number() OVER (ORDER BY doc_id) - 1 AS n, greatest(1, count(*) OVER () // {DELTA_SAMPLES}) AS step FROM v) SELECT key, old, new, round(new - old, 9) AS delta FROM r WHERE n % step = 0 AND n // step < {DELTA_SAMPLES}"


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("value").alias("latency_ms"), micros("ts").alias("us"))


QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
LATENCY_SQL = "WITH v AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS samples, " + ", ".join(f"max(x) FILTER (WHERE i = CAST(round_even((n - 1) * {q}, 0) AS BIGINT)) AS {n}" for n, q in QS.items()) + " FROM v GROUP BY event_type"


def backlog_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latency(spark, sf_dir).select(F.expr("event_id % 20").alias("run"), F.expr("CAST(event_id AS DOUBLE)").alias("x"), F.expr("CAST((event_id * 7 + user_id) % 50 AS DOUBLE) * CASE WHEN event_id % 20 < 10 THEN 1 ELSE 0 END").alias("y"))
    return measures.backlog_trend(rows, "run", "x", "y")


BACKLOG_SQL = """WITH v AS (SELECT event_id % 20 AS run, CAST(event_id AS DOUBLE) AS x, CAST((event_id * 7 + user_id) % 50 AS DOUBLE) * CASE WHEN event_id % 20 < 10 THEN 1 ELSE 0 END AS y FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY x) AS i, count(*) OVER (PARTITION BY run) AS n FROM v),
t AS (SELECT run, round(regr_slope(y, x), 6) AS slope, round(avg(y) FILTER (WHERE i <= greatest(n // 4, 1)), 6) AS first_quarter, round(avg(y) FILTER (WHERE i > n - greatest(n // 4, 1)), 6) AS last_quarter, max(y) AS peak, arg_max(y, x) AS final FROM r GROUP BY run)
SELECT *, final = 0 AND coalesce(slope, 0) <= 2 AS stable FROM t"""
_RUNS = {"rate": "50 * (1 + user_id % 9)", "held": "NOT (user_id % 9 >= 6 AND event_id % 5 = 0)"}


def sustainable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.sustainable_rate(table(spark, sf_dir, "events").select(*(F.expr(e).alias(n) for n, e in _RUNS.items())))


RATE_SQL = "WITH v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RUNS.items()) + " FROM events), g AS (SELECT rate, count(*) AS runs FROM v GROUP BY rate HAVING bool_and(held)), t AS (SELECT max(rate) FILTER (WHERE runs >= 3) AS sustainable FROM g) SELECT sustainable, (SELECT max(rate) FROM g WHERE rate < sustainable) AS next_lower FROM t"
TAIL_SQL = """WITH v AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT user_id, x, CASE WHEN i <= n // 4 THEN 'early' WHEN i > n - n // 4 THEN 'late' END AS part FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY user_id, part) AS m FROM p WHERE part IS NOT NULL AND x IS NOT NULL),
w AS (SELECT user_id, max(x) FILTER (WHERE part = 'early' AND k = CAST(round_even((m - 1) * 0.95, 0) AS BIGINT)) AS early_p95, max(x) FILTER (WHERE part = 'late' AND k = CAST(round_even((m - 1) * 0.95, 0) AS BIGINT)) AS late_p95 FROM r GROUP BY user_id),
s AS (SELECT user_id, count(*) AS samples FROM events GROUP BY user_id)
SELECT user_id, samples, early_p95, late_p95, coalesce(samples < 8 OR late_p95 <= 2 * early_p95 + 250, true) AS stable FROM s LEFT JOIN w USING (user_id)"""
_REPEAT = {"keys": "user_id % 6", "lane": "event_type", "rate": "round(value * 3, 2)", "memory": "CAST(event_id % 977 AS DOUBLE)"}


def repeat_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.repeat_medians(table(spark, sf_dir, "events").select(*(F.expr(e).alias(n) for n, e in _REPEAT.items())), ("keys", "lane"))


REPEAT_SQL = "WITH v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _REPEAT.items()) + " FROM events) SELECT keys, lane, count(*) AS repeats, round(median(rate), 6) AS median_rate, min(rate) AS min_rate, max(rate) AS max_rate, round(median(memory), 6) AS median_memory FROM v GROUP BY keys, lane"
_FLAGS = {"QUEUE_SATURATED": "user_id % 5 = 0", "CAPACITY_REACHED": "value > 90", "ERRORS": "event_type = 'error'"}
STATUS_SQL = "SELECT event_id, CASE WHEN len(f) = 0 THEN 'CLEAN' ELSE array_to_string(f, ',') END AS status FROM (SELECT event_id, list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in _FLAGS.items()) + "], lambda x: x IS NOT NULL) AS f FROM events)"


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", measures.run_status({n: F.coalesce(F.expr(e), F.lit(False)) for n, e in _FLAGS.items()}).alias("status"))


def sequence_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.sequence_complete(table(spark, sf_dir, "events").where("event_id % 613 <> 0").select(F.expr("event_id DIV 100").alias("trace"), "event_id"), "trace", "event_id")


SEQUENCE_SQL = "WITH v AS (SELECT event_id // 100 AS trace, event_id FROM events WHERE event_id % 613 <> 0), s AS (SELECT *, event_id - lag(event_id) OVER (PARTITION BY trace ORDER BY event_id) AS step FROM v), t AS (SELECT trace, min(event_id) AS first, max(event_id) AS last, count(*) AS numbers, count(*) FILTER (WHERE step <> 1) AS breaks FROM s GROUP BY trace) SELECT *, breaks = 0 AND numbers = last - first + 1 AS complete FROM t"


def latest_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase', 'error', 'click')").select("user_id", F.expr("event_id % 3").alias("lane"), F.col("event_type").alias("kind"), F.col("event_id").alias("sequence"))
    return measures.latest_of(rows, ("user_id", "lane"), "sequence", "kind")


READINESS_SQL = "SELECT user_id, event_id % 3 AS lane, arg_max(event_type, event_id) AS kind, max(event_id) AS sequence FROM events WHERE event_type IN ('signup', 'purchase', 'error', 'click') GROUP BY 1, 2"
_GAP = {"gap_id": "concat('gap-', CAST(event_id AS STRING))", "lane_id": "event_type"}


def gap_flagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 250th event declares a gap on its lane; every fourth of those stays open."""
    rows = table(spark, sf_dir, "events")
    events = rows.select(F.expr("concat('e-', CAST(event_id AS STRING))").alias("obs_id"), F.col("event_type").alias("lane_id"), micros("ts").alias("us"))
    gaps = rows.where("event_id % 250 = 0").select(*(F.expr(e).alias(n) for n, e in _GAP.items()), micros("ts").alias("opened_us"), F.when(F.col("event_id") % 1000 != 0, micros("ts") + DAY * (1 + F.col("event_id") % 3)).alias("closed_us"))
    out = measures.gaps_at(events, gaps)
    return out.select("obs_id", "lane_id", "gap_count", F.when(F.col("gap_count") > 0, "QUALITY_DEGRADED").otherwise("REVIEW_FINDING").alias("result_type"))


GAP_SQL = f"""WITH g AS (SELECT event_id, event_type AS lane_id, CAST(epoch_us(ts) AS BIGINT) AS o, CASE WHEN event_id % 1000 <> 0 THEN CAST(epoch_us(ts) AS BIGINT) + {DAY} * (1 + event_id % 3) END AS c FROM events WHERE event_id % 250 = 0),
e AS (SELECT 'e-' || CAST(event_id AS VARCHAR) AS obs_id, event_type AS lane_id, CAST(epoch_us(ts) AS BIGINT) AS us FROM events)
SELECT obs_id, e.lane_id, count(g.event_id) AS gap_count, CASE WHEN count(g.event_id) > 0 THEN 'QUALITY_DEGRADED' ELSE 'REVIEW_FINDING' END AS result_type FROM e LEFT JOIN g ON e.lane_id = g.lane_id AND us >= o AND (c IS NULL OR us <= c) GROUP BY obs_id, e.lane_id"""

QUERIES = {
    "dns_canonical": dns_canonical, "dns_structure": lambda s, d: flowlanes.dns_structure(names(s, d)), "transfer_magnitude": lambda s, d: flowlanes.transfer_magnitude(transfers(s, d))[0],
    "transfer_rejects": lambda s, d: flowlanes.transfer_magnitude(transfers(s, d))[1], "tls_context": tls_context, "registrable_domain": registrable_domain,
    "representation_audit": lambda s, d: flowlanes.representation_audit(names(s, d), _suffixes(s, SUFFIXES), _suffixes(s, NEW_SUFFIXES)), "ngram_score": ngram_score,
    "binary_metrics": lambda s, d: lexical.binary_metrics(scored(s, d)), "auroc": lambda s, d: lexical.auroc(scored(s, d)), "average_precision": lambda s, d: lexical.average_precision(scored(s, d)),
    "score_quantiles": lambda s, d: lexical.score_quantiles(scored(s, d), "split"), "model_delta": model_delta,
    "latency_percentiles": lambda s, d: measures.nearest_rank(_latency(s, d), ("event_type",), "latency_ms", QS), "backlog_trend": backlog_trend, "sustainable_rate": sustainable_rate,
    "early_late_tail": lambda s, d: measures.early_late_tail(_latency(s, d), "user_id", "event_id", "latency_ms"), "repeat_medians": repeat_medians, "run_status": run_status,
    "sequence_complete": sequence_complete, "latest_readiness": latest_readiness, "gap_flagging": gap_flagging,
}
SQL = {
    "dns_canonical": CANONICAL_SQL, "dns_structure": STRUCTURE_SQL, "transfer_magnitude": TRANSFER_RESULT_SQL, "transfer_rejects": TRANSFER_REJECT_SQL, "tls_context": TLS_SQL, "registrable_domain": DOMAIN_SQL,
    "representation_audit": AUDIT_SQL, "ngram_score": NGRAM_SQL, "binary_metrics": METRICS_SQL, "auroc": AUROC_SQL, "average_precision": AP_SQL, "score_quantiles": QUANTILES_SQL, "model_delta": DELTA_SQL,
    "latency_percentiles": LATENCY_SQL, "backlog_trend": BACKLOG_SQL, "sustainable_rate": RATE_SQL, "early_late_tail": TAIL_SQL, "repeat_medians": REPEAT_SQL, "run_status": STATUS_SQL,
    "sequence_complete": SEQUENCE_SQL, "latest_readiness": READINESS_SQL, "gap_flagging": GAP_SQL,
}
