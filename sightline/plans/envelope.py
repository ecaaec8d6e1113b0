"""Queries over record envelopes: routing, admission, validation, conforming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.core import resolve_role
from sightline.operators import conform, routing
from sightline.plans.views import PACKET, PACKET_SQL, SECOND, duck, packets, table

#: What the record view adds to packets. Lists are comma-separated text, split where they are used.
RECORD = {
    "observation_type": "CASE l_linenumber WHEN 5 THEN 'FLOW' WHEN 6 THEN 'DNS' WHEN 7 THEN 'TLS' ELSE 'PACKET' END",
    "present": "CASE l_linenumber WHEN 5 THEN 'start_time,end_time,supplied_directional_counters,protocol' WHEN 6 THEN CASE WHEN l_tax = 0.02 THEN 'qname' WHEN l_tax = 0.01 THEN 'qname,labels,qname_canonical' ELSE 'qname,labels,qname_canonical,representation_version' END "
    "WHEN 7 THEN CASE WHEN l_tax = 0.03 THEN 'prefix_time' ELSE 'parsed_handshake_metadata' END "
    "ELSE CASE WHEN l_tax = 0.02 THEN 'protocol,src_address' WHEN l_tax = 0.03 THEN 'protocol,src_address,dst_address,src_port,dst_port,flags,qname' ELSE 'protocol,src_address,dst_address,src_port,dst_port,flags,observed_l4_facts,fragmentation' END END",
    "capability": "CASE WHEN l_discount = 0.05 THEN '' ELSE 'PACKET_FACTS,FLOW_FACTS,FORWARD_FACTS,CLEAR_DNS_FIELDS,TLS_HANDSHAKE_METADATA' END",
    "lacking": "CASE WHEN l_tax = 0.05 THEN 'REVERSE_FACTS' WHEN l_tax = 0.06 THEN 'FORWARD_FACTS' ELSE '' END",
    "contract": "CASE WHEN l_partkey % 101 = 0 THEN 'v0' ELSE 'v1' END",
    "record_finality": "CASE WHEN l_linenumber = 5 AND l_suppkey % 2 = 0 THEN 'FLOW_END_ONLY' ELSE 'IMMEDIATE' END",
    "direction_basis": "CASE WHEN l_tax = 0.04 THEN 'UNKNOWN' ELSE 'SOURCE_DECLARED' END",
    "quality_ref": "CASE WHEN l_discount = 0.01 THEN NULL ELSE 'quality-report' END",
    "parser_quality": "CASE WHEN l_tax = 0.07 THEN 'DEGRADED' ELSE 'CLEAR' END",
    "flag_text": "CASE l_partkey % 9 WHEN 0 THEN 'SYN' WHEN 1 THEN 'ACK,SYN' WHEN 2 THEN 'SYN,ACK' WHEN 3 THEN 'RST,ACK' WHEN 4 THEN 'syn' WHEN 5 THEN 'SYN,ECE' WHEN 6 THEN 'ACK,PSH' WHEN 7 THEN 'RST,SYN' ELSE 'FIN,ACK' END",
    "wire_src": f"CASE l_returnflag WHEN 'N' THEN {PACKET['src']} ELSE {PACKET['target']} END",
    "wire_dst": f"CASE WHEN l_suppkey % 13 = 0 THEN 'elsewhere' WHEN l_returnflag = 'N' THEN {PACKET['target']} ELSE {PACKET['src']} END",
    "forward_state": "CASE WHEN l_tax = 0.06 THEN 'UNAVAILABLE' WHEN l_tax = 0.07 THEN 'DEGRADED' ELSE 'AVAILABLE' END",
    "counter_names": "CASE l_partkey % 4 WHEN 0 THEN 'bytes_s2c' WHEN 1 THEN 'packets_c2s,packets_s2c' ELSE 'bytes_c2s,bytes_s2c' END",
    "early": "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END",
    "availability_basis": "CASE WHEN l_partkey % 89 = 0 THEN 'UNDECLARED' WHEN l_linenumber = 5 AND l_suppkey % 2 = 0 THEN 'FLOW_END_ONLY' ELSE 'IMMEDIATE' END",
    "payload_type": "CASE WHEN l_suppkey % 71 = 0 THEN 'QUIC' WHEN l_linenumber = 5 THEN 'FLOW' WHEN l_linenumber = 6 THEN 'DNS' WHEN l_linenumber = 7 THEN 'TLS' ELSE 'PACKET' END",
    "null_names": "CASE WHEN l_discount = 0.02 THEN 'src_port,rcode' WHEN l_discount = 0.03 THEN 'qname,lengths' ELSE '' END",
    "late": "CASE WHEN l_partkey % 89 = 0 THEN 1 ELSE 0 END",
}
_EXTRA = {"initiator": PACKET["src"]}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    from sightline.functions.core import micros

    out = rows.select((micros("o_orderdate") + F.col("l_linenumber") * SECOND).alias("us"), *(F.expr(e).alias(n) for n, e in (PACKET | _EXTRA | RECORD).items()))
    words = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return (
        out.withColumn("availability_us", F.col("us") - F.col("late") * SECOND).withColumn("present_fields", words("present"))
        .withColumn("available", words("capability")).withColumn("unavailable", words("lacking")).withColumn("null_fields", words("null_names")).withColumn("flags", F.split("flag_text", ","))
        .withColumn("counters", F.split("counter_names", ",")).withColumn("start_us", F.col("us") - F.col("early") * SECOND)
    )


RECORD_SQL = (
    f"SELECT CAST(epoch_us(o_orderdate) AS BIGINT) + l_linenumber * {SECOND} AS us, "
    + ", ".join(f"{duck(e)} AS {n}" for n, e in (PACKET | _EXTRA | RECORD).items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
_RECORDS = (
    f"v AS (SELECT *, row_number() OVER () AS rid, us - late * {SECOND} AS availability_us, list_filter(string_split(present, ','), lambda x: x <> '') AS present_fields, "
    f"list_filter(string_split(capability, ','), lambda x: x <> '') AS available, list_filter(string_split(lacking, ','), lambda x: x <> '') AS unavailable, list_filter(string_split(null_names, ','), lambda x: x <> '') AS null_fields FROM ({RECORD_SQL}))"
)
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
_LANES = "lanes AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{x.lane_id}', '{x.observation_type}', {_list(x.fields)}, {_list(x.capabilities)}, {_list(x.finality)}, {_list(x.quality)}, {str(x.ingest).lower()})" for x in routing.LANES
) + ") AS l(lane_id, observation_type, fields, capabilities, finality, quality_facts, ingest))"
#: The lanes' rules once more, written for lists of DuckDB and not taken from the operators.
_UP = "string_split(upper(flag_text), ',')"
_HERE = "direction IN ('FORWARD', 'REVERSE') AND target IS NOT NULL AND service IS NOT NULL"
_MATCHED = "CASE direction WHEN 'FORWARD' THEN initiator = wire_src AND target = wire_dst WHEN 'REVERSE' THEN initiator = wire_dst AND target = wire_src ELSE false END"
_TRY = f"list_contains({_UP}, 'SYN') AND NOT list_contains({_UP}, 'ACK')"
_RULES = {
    "ddos.syn_state": f"protocol = 6 AND {_HERE} AND regexp_full_match(flag_text, '(SYN|ACK|RST)(,(SYN|ACK|RST))*')",
    "ddos.udp_demand": f"protocol = 17 AND {_HERE}",
    "ddos.reflection_victim": f"protocol = 17 AND direction = 'FORWARD' AND response_like AND length(trim(protocol_context)) > 0 AND {_HERE}",
    "ddos.source_diversity": f"src <> '' AND protocol >= 0 AND protocol <= 255 AND {_HERE}",
    "ddos.icmp_demand": f"protocol = 1 AND {_HERE}",
    "ddos.fragment_demand": f"is_fragment AND {_HERE}",
    "ddos.connection_churn": f"protocol = 6 AND direction = 'FORWARD' AND regexp_matches(flag_text, '(^|,)SYN(,|$)') AND NOT regexp_matches(flag_text, '(^|,)(ACK|RST)(,|$)') AND {_HERE}",
    **dict.fromkeys(("recon.h", "recon.v", "recon.2d"), f"protocol = 6 AND direction = 'FORWARD' AND {_MATCHED} AND {_TRY}"),
    "recon.tcp": f"protocol = 6 AND {_MATCHED} AND CASE direction WHEN 'FORWARD' THEN ({_TRY}) OR (list_contains({_UP}, 'ACK') AND NOT list_contains({_UP}, 'SYN') AND NOT list_contains({_UP}, 'RST')) "
    f"ELSE (list_contains({_UP}, 'SYN') AND list_contains({_UP}, 'ACK')) OR list_contains({_UP}, 'RST') END",
    "c2.r1": "early = 0 AND initiator IS NOT NULL AND target IS NOT NULL AND dport IS NOT NULL",
    "unusual_transfer.m1": "forward_state <> 'UNAVAILABLE' AND contains(counter_names, 'c2s')",
    **dict.fromkeys(("dga.m1", "dns_tunnelling.t1", "encrypted_session.enc_a"), "true"),
}
_PREDICATE = "CASE lane_id " + " ".join(f"WHEN '{k}' THEN coalesce({v}, false)" for k, v in _RULES.items()) + " END"
_WHY = (
    "list_filter([CASE WHEN contract <> 'v1' THEN 'CONTRACT_MISMATCH' END, CASE WHEN len(list_filter(fields, lambda f: NOT list_contains(present_fields, f))) > 0 THEN 'REQUIRED_FIELD_MISSING' END, "
    "CASE WHEN len(list_filter(capabilities, lambda c: NOT list_contains(available, c))) > 0 THEN 'REQUIRED_CAPABILITY_UNAVAILABLE' END, "
    "CASE WHEN NOT list_contains(finality, record_finality) THEN 'FINALITY_UNSUPPORTED' END, CASE WHEN availability_basis = 'UNDECLARED' THEN 'AVAILABILITY_UNSUPPORTED' END], lambda x: x IS NOT NULL)"
)
_PLAN = f"p AS (SELECT v.*, lane_id, {_WHY} AS why, {_PREDICATE} AS ok, fields, capabilities, finality, quality_facts, ingest FROM v JOIN lanes USING (observation_type))"

ROUTE_SQL = f"""WITH {_RECORDS}, {_LANES}, {_PLAN}
SELECT obs_id, lane_id, len(why) = 0 AND ok AS selected, CASE WHEN len(why) > 0 THEN array_to_string(why, ',') WHEN ok THEN 'SELECTED' ELSE 'PREDICATE_FALSE' END AS reasons FROM p"""
ADMIT_SQL = f"""WITH {_RECORDS}, {_LANES}, {_PLAN},
r AS (SELECT obs_id, lane_id, flatten([CASE WHEN NOT ingest THEN ['INGEST_NOT_PERMITTED'] ELSE []::VARCHAR[] END,
  list_transform(list_filter(fields, lambda f: NOT list_contains(present_fields, f)), lambda f: 'REQUIRED_FIELD_MISSING:' || f),
  list_filter([CASE WHEN contract <> 'v1' THEN 'CONTRACT_MISMATCH' END, CASE WHEN NOT list_contains(finality, record_finality) THEN 'FINALITY_UNSUPPORTED' END, CASE WHEN availability_basis = 'UNDECLARED' THEN 'AVAILABILITY_UNSUPPORTED' END], lambda x: x IS NOT NULL),
  list_transform(list_filter(capabilities, lambda c: NOT list_contains(available, c)), lambda c: 'REQUIRED_CAPABILITY_UNAVAILABLE:' || c),
  CASE WHEN parser_quality = 'DEGRADED' THEN list_transform(quality_facts, lambda q: 'QUALITY_INSUFFICIENT:' || q) ELSE []::VARCHAR[] END]) AS reasons FROM p)
SELECT obs_id, lane_id, len(reasons) = 0 AS admitted, array_to_string(reasons, ',') AS reasons FROM r"""
FAN_OUT_SQL = f"""WITH {_RECORDS}, {_LANES}, {_PLAN},
s AS (SELECT rid, count(*) AS n FROM p WHERE len(why) = 0 AND ok GROUP BY rid)
SELECT observation_type, count(*) AS records, CAST(sum(coalesce(n, 0)) AS BIGINT) AS routes, count(*) FILTER (WHERE n IS NULL) AS zero_route FROM v LEFT JOIN s USING (rid) GROUP BY observation_type"""
PREDICATES_SQL = f"WITH {_RECORDS}, {_LANES}, {_PLAN} SELECT lane_id, count(*) AS records, count(*) FILTER (WHERE ok) AS true_count, count(*) FILTER (WHERE ok AND len(why) = 0) AS selected FROM p GROUP BY lane_id"


def fan_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("routes")
    return routing.fan_out(records(spark, sf_dir)).groupBy("observation_type").agg(F.count("*").alias("records"), F.sum(n).alias("routes"), F.count_if(n == 0).alias("zero_route"))


def lane_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.for_each_lane(records(spark, sf_dir), lambda x: [routing.matches(x).alias("ok"), (routing.structural_reasons(x) == "").alias("free")])
    return rows.groupBy("lane_id").agg(F.count("*").alias("records"), F.count_if("ok").alias("true_count"), F.count_if(F.col("ok") & F.col("free")).alias("selected"))


def envelope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.envelope_errors(records(spark, sf_dir)).select("obs_id", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


_ALLOWED = "CASE observation_type " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in routing.PAYLOAD_FIELDS.items()) + " END"
ENVELOPE_SQL = f"""WITH {_RECORDS},
e AS (SELECT obs_id, list_filter([CASE WHEN availability_us < us THEN 'CAUSAL_TIME_BEFORE_EVENT_TIME' END, CASE WHEN direction <> 'UNKNOWN' AND direction_basis = 'UNKNOWN' THEN 'DIRECTION_WITHOUT_BASIS' END,
  CASE WHEN (direction = 'FORWARD' AND list_contains(unavailable, 'FORWARD_FACTS')) OR (direction = 'REVERSE' AND list_contains(unavailable, 'REVERSE_FACTS')) THEN 'DIRECTION_CONTRADICTS_VISIBILITY' END,
  CASE WHEN quality = 'DEGRADED' AND quality_ref IS NULL THEN 'DEGRADED_QUALITY_WITHOUT_REFERENCE' END,
  CASE WHEN payload_type <> observation_type THEN 'WRONG_PAYLOAD_TYPE' END, CASE WHEN len(list_filter(present_fields, lambda f: NOT list_contains({_ALLOWED}, f))) > 0 THEN 'IMPOSSIBLE_PRESENT_FIELD' END,
  CASE WHEN list_has_any(present_fields, null_fields) THEN 'NULL_FIELD_PRESENT' END], lambda x: x IS NOT NULL) AS errors FROM v)
SELECT obs_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS valid FROM e"""


def bundle_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are bundles, events their records; the declared count is made wrong for every seventh day."""
    rows = table(spark, sf_dir, "events").select(F.expr("concat('bundle-', CAST(event_id % 50 AS STRING))").alias("source_id"), F.col("event_id").alias("position"), F.expr("unix_micros(cast(ts as timestamp)) - CASE WHEN event_id % 997 = 0 THEN 86400000000 * 400 ELSE 0 END").alias("us"), F.expr("value IS NOT NULL AND event_type <> 'error'").alias("valid"))
    declared = table(spark, sf_dir, "events").groupBy(F.expr("concat('bundle-', CAST(event_id % 50 AS STRING))").alias("source_id")).agg((F.count("*") + F.when(F.min(F.col("event_id") % 50) % 7 == 0, 1).otherwise(0)).alias("declared"))
    return conform.validate_bundle(rows, declared)


BUNDLE_SQL = """
WITH v AS (SELECT 'bundle-' || CAST(event_id % 50 AS VARCHAR) AS source_id, event_id AS position, CAST(epoch_us(ts) AS BIGINT) - CASE WHEN event_id % 997 = 0 THEN 86400000000 * 400 ELSE 0 END AS us, value IS NOT NULL AND event_type <> 'error' AS valid FROM events),
o AS (SELECT *, coalesce(us < lag(us) OVER (PARTITION BY source_id ORDER BY position), false) AS decreasing FROM v),
d AS (SELECT 'bundle-' || CAST(event_id % 50 AS VARCHAR) AS source_id, count(*) + CASE WHEN min(event_id % 50) % 7 = 0 THEN 1 ELSE 0 END AS declared FROM events GROUP BY 1)
SELECT source_id, count(*) AS records_read, any_value(declared) AS declared, count(*) = any_value(declared) AS count_ok, count(*) FILTER (WHERE decreasing) AS decreasing, count(*) FILTER (WHERE NOT valid) AS invalid,
  min(position) FILTER (WHERE decreasing OR NOT valid) AS first_bad FROM o JOIN d USING (source_id) GROUP BY source_id"""

CONFORM = {
    "position": "CAST(event_id AS STRING)", "record_direction": "CASE WHEN event_id % 3 = 0 THEN 'FORWARD' END", "manifest_direction": "CASE WHEN user_id % 5 = 0 THEN 'REVERSE' WHEN user_id % 5 = 1 THEN 'FORWARD' ELSE 'UNKNOWN' END",
    "record_loss": "CASE WHEN event_id % 11 = 0 THEN 'DEGRADED' ELSE 'UNKNOWN' END", "manifest_loss": "CASE WHEN user_id % 7 = 0 THEN 'CLEAR' ELSE 'UNKNOWN' END", "source_id": "concat('u', CAST(user_id AS STRING))",
    "terminal": "event_type = 'purchase'", "export_lag": "CASE WHEN event_id % 4 = 0 THEN 2500000 ELSE -1 END",
}


def conform_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.functions.core import micros

    rows = table(spark, sf_dir, "events").select(micros("ts").alias("us"), *(F.expr(e).alias(n) for n, e in CONFORM.items()))
    return conform.conform_flow(rows.withColumn("export_us", F.when(F.col("export_lag") >= 0, F.col("us") + F.col("export_lag"))))


CONFORM_SQL = "WITH v AS (SELECT CAST(epoch_us(ts) AS BIGINT) AS us, " + ", ".join(f"{duck(e)} AS {n}" for n, e in CONFORM.items()) + """ FROM events),
w AS (SELECT *, CASE WHEN export_lag >= 0 THEN us + export_lag END AS export_us FROM v)
SELECT 'flow:' || source_id || ':' || position AS observation_id, 'prov:' || source_id || ':' || position AS provenance_id, us AS event_us, greatest(us, coalesce(export_us, us)) AS available_us,
  CASE WHEN terminal THEN 'FLOW_END_ONLY' ELSE 'IMMEDIATE' END AS finality, coalesce(record_direction, manifest_direction) AS direction,
  CASE WHEN record_loss = 'UNKNOWN' THEN manifest_loss ELSE record_loss END AS packet_loss,
  CASE WHEN record_direction <> manifest_direction AND manifest_direction <> 'UNKNOWN' THEN 'DIRECTION_CONTRADICTION' WHEN record_loss <> manifest_loss AND record_loss <> 'UNKNOWN' AND manifest_loss <> 'UNKNOWN' THEN 'QUALITY_CONTRADICTION' END AS reject FROM w"""

ARRIVED = {
    "observation_type": "CASE event_id % 5 WHEN 0 THEN 'PACKET' WHEN 1 THEN 'FLOW' WHEN 2 THEN 'DNS' WHEN 3 THEN 'TLS' ELSE 'QUIC' END",
    "declared": "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'protocol,flags' WHEN event_id % 5 = 1 THEN 'start_time' WHEN event_id % 5 = 2 THEN 'qname' WHEN event_id % 7 < 4 THEN 'parsed_handshake_metadata' ELSE 'parsed_record_metadata' END",
    "claimed": "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 5 = 2 THEN 'clear_dns_fields' WHEN event_id % 5 = 3 THEN CASE WHEN event_id % 3 = 0 THEN 'record_metadata' ELSE 'handshake_metadata' END WHEN event_id % 5 = 4 THEN 'outer_metadata' ELSE '' END",
    "qname": "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'a..b' ELSE concat(event_type, '.example.') END",
}


def conform_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of all five types; users are sources, and every ninth has no manifest."""
    from sightline.functions.core import micros

    words = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us"), *(F.expr(e).alias(n) for n, e in (CONFORM | ARRIVED).items()))
    manifests = rows.where("user_id % 9 <> 0").select("source_id", "manifest_direction", "manifest_loss").distinct()
    records = rows.drop("manifest_direction", "manifest_loss").withColumns({
        "export_us": F.when(F.col("export_lag") >= 0, F.col("us") + F.col("export_lag")), "declared_fields": words("declared"), "claims": words("claimed")})
    out = conform.conform_records(records, manifests)
    return out.withColumns({c: F.array_join(c, ",") for c in ("present_fields", "available", "unavailable")})


RECORDS_SQL = "WITH v AS (SELECT user_id, user_id % 9 <> 0 AS known, CAST(epoch_us(ts) AS BIGINT) AS us, " + ", ".join(f"{duck(e)} AS {n}" for n, e in (CONFORM | ARRIVED).items()) + """ FROM events),
w AS (SELECT * REPLACE (CASE WHEN known THEN manifest_direction END AS manifest_direction, CASE WHEN known THEN manifest_loss END AS manifest_loss), CASE WHEN declared = 'qname' AND qname IS NULL THEN '' ELSE declared END AS seen FROM v),
x AS (SELECT *, CASE WHEN observation_type = 'DNS' AND claimed = 'clear_dns_fields' AND seen = 'qname' THEN CASE WHEN contains(qname, '..') THEN 'bad' ELSE 'good' END ELSE 'none' END AS name_state FROM w)
SELECT lower(observation_type) || ':' || source_id || ':' || position AS observation_id, 'prov:' || source_id || ':' || position AS provenance_id, observation_type, us AS event_us,
  CASE WHEN observation_type = 'FLOW' AND export_lag > 0 THEN us + export_lag ELSE us END AS available_us, CASE WHEN observation_type = 'FLOW' AND terminal THEN 'FLOW_END_ONLY' ELSE 'IMMEDIATE' END AS finality,
  coalesce(record_direction, manifest_direction, 'UNKNOWN') AS direction, CASE WHEN record_loss <> 'UNKNOWN' THEN record_loss ELSE coalesce(manifest_loss, 'UNKNOWN') END AS packet_loss,
  CASE name_state WHEN 'good' THEN 'labels,qname,qname_canonical,qname_rendered,representation_version' WHEN 'bad' THEN 'canonicalization_failure_reason,qname,qname_rendered' ELSE array_to_string(list_sort(string_split(seen, ',')), ',') END AS present_fields,
  CASE WHEN observation_type IN ('PACKET', 'FLOW') THEN observation_type || '_FACTS' WHEN name_state <> 'none' THEN 'CLEAR_DNS_FIELDS' WHEN observation_type = 'TLS' AND claimed <> '' AND 'parsed_' || claimed = seen THEN 'TLS_' || upper(claimed)
    WHEN observation_type = 'QUIC' AND claimed <> '' AND seen <> '' THEN 'QUIC_OUTER_METADATA' ELSE '' END AS available,
  CASE manifest_direction WHEN 'FORWARD' THEN 'REVERSE_FACTS' WHEN 'REVERSE' THEN 'FORWARD_FACTS' ELSE '' END AS unavailable,
  CASE WHEN NOT known THEN 'MANIFEST_MISSING' WHEN record_direction <> manifest_direction AND manifest_direction <> 'UNKNOWN' THEN 'DIRECTION_CONTRADICTION'
    WHEN record_loss <> manifest_loss AND record_loss <> 'UNKNOWN' AND manifest_loss <> 'UNKNOWN' THEN 'QUALITY_CONTRADICTION' WHEN observation_type = 'PACKET' AND seen = '' THEN 'PACKET_WITHOUT_DECLARED_FIELDS'
    WHEN claimed = '' THEN NULL WHEN observation_type = 'DNS' AND seen <> 'qname' THEN 'CLEAR_DNS_FIELDS_WITHOUT_FIELD' WHEN observation_type = 'TLS' AND 'parsed_' || claimed <> seen THEN upper(claimed) || '_WITHOUT_FIELD'
    WHEN observation_type = 'QUIC' AND seen = '' THEN 'OUTER_METADATA_WITHOUT_FIELD' END AS reject FROM x"""

_ROLES = {
    "r1": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('h', CAST(o_custkey AS STRING)) END", "r2": "concat('s', CAST(o_custkey % 9 AS STRING))", "two": "o_orderkey % 6 = 0",
}


def role_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(F.expr(e).alias(n) for n, e in _ROLES.items()))
    pair = lambda i, r: F.struct(i.alias("identifier"), F.lit(r).alias("role"))
    roles = F.array_compact(F.array(pair(F.col("r1"), "target_id"), pair(F.col("r2"), "service_id"), F.when(F.col("two"), pair(F.col("r2"), "target_id"))))
    rows = rows.withColumn("roles", roles)
    return rows.select("o_orderkey", resolve_role("roles", "target_id").alias("target"), resolve_role("roles", "service_id").alias("service"), resolve_role("roles", "client_id").alias("client"))


ROLES_SQL = "WITH v AS (SELECT o_orderkey, " + ", ".join(f"{duck(e)} AS {n}" for n, e in _ROLES.items()) + """ FROM orders)
SELECT o_orderkey, CASE WHEN two AND r1 = '' THEN r2 WHEN NOT two AND r1 <> '' THEN r1 END AS target, r2 AS service, CAST(NULL AS VARCHAR) AS client FROM v"""


def cidr_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.classify_direction(packets(spark, sf_dir).select("obs_id", "src", F.col("target").alias("dst")), A_NETS, B_NETS).select("obs_id", "direction")


A_NETS, B_NETS = ("10.0.0.0/10", "192.168.0.0/21"), ("192.168.4.0/22", "192.168.8.0/21", "10.128.0.0/9")
_number = lambda a: " + ".join(f"CAST(string_split({a}, '.')[{i}] AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4))
_within = lambda a, nets: "(" + " OR ".join(f"{a} BETWEEN {lo} AND {hi}" for lo, hi in map(conform.network_range, nets)) + ")"
CIDR_SQL = f"""WITH v AS ({PACKET_SQL}), n AS (SELECT obs_id, {_number('src')} AS s, {_number('target')} AS d FROM v),
f AS (SELECT obs_id, {_within('s', A_NETS)} AS sa, {_within('s', B_NETS)} AS sb, {_within('d', A_NETS)} AS da, {_within('d', B_NETS)} AS db FROM n)
SELECT obs_id, CASE WHEN sa AND NOT sb AND db AND NOT da THEN 'FORWARD' WHEN sb AND NOT sa AND da AND NOT db THEN 'REVERSE' ELSE 'UNKNOWN' END AS direction FROM f"""


def service_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = table(spark, sf_dir, "supplier").select(F.expr("concat('192.168.', CAST(s_suppkey % 16 AS STRING), '.', CAST(s_suppkey % 100 AS STRING))").alias("address"), F.lit(6).alias("protocol"), F.expr("CAST(20 + s_suppkey % 50 AS BIGINT)").alias("port")).distinct()
    services = services.withColumn("service_id", F.expr("concat('service-', address, '-', CAST(port AS STRING))"))
    return conform.attach_services(packets(spark, sf_dir).select("obs_id", "src", "sport", F.col("target").alias("dst"), "dport", "protocol"), services).select("obs_id", "service_id", "side")


SERVICES_SQL = f"""WITH v AS ({PACKET_SQL}),
s AS (SELECT DISTINCT '192.168.' || CAST(s_suppkey % 16 AS VARCHAR) || '.' || CAST(s_suppkey % 100 AS VARCHAR) AS address, 6 AS protocol, CAST(20 + s_suppkey % 50 AS BIGINT) AS port FROM supplier),
n AS (SELECT *, 'service-' || address || '-' || CAST(port AS VARCHAR) AS service_id FROM s)
SELECT obs_id, coalesce(d.service_id, c.service_id) AS service_id, CASE WHEN d.service_id IS NOT NULL THEN 'DESTINATION' WHEN c.service_id IS NOT NULL THEN 'SOURCE' END AS side
FROM v LEFT JOIN n d ON v.target = d.address AND v.protocol = d.protocol AND v.dport = d.port LEFT JOIN n c ON v.src = c.address AND v.protocol = c.protocol AND v.sport = c.port"""

QUERIES = {
    "route_plan": lambda s, d: routing.route_plan(records(s, d)), "admission": lambda s, d: routing.admit(records(s, d)), "fan_out_counts": fan_out_counts, "lane_predicates": lane_predicates,
    "envelope_validation": envelope_validation, "bundle_validation": bundle_validation, "conform_flow": conform_flow, "conform_records": conform_records, "role_resolution": role_resolution, "cidr_direction": cidr_direction, "service_roles": service_roles,
}
SQL = {
    "route_plan": ROUTE_SQL, "admission": ADMIT_SQL, "fan_out_counts": FAN_OUT_SQL, "lane_predicates": PREDICATES_SQL, "envelope_validation": ENVELOPE_SQL, "bundle_validation": BUNDLE_SQL,
    "conform_flow": CONFORM_SQL, "conform_records": RECORDS_SQL, "role_resolution": ROLES_SQL, "cidr_direction": CIDR_SQL, "service_roles": SERVICES_SQL,
}
