"""Lanes, their predicates, structural routing, admission and envelope checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.core import listed


@dataclass(frozen=True)
class Lane:
    """A mechanism's declared needs. predicate is an SQL condition over the record's columns."""

    lane_id: str
    observation_type: str
    fields: tuple[str, ...]
    capabilities: tuple[str, ...]
    predicate: str
    finality: tuple[str, ...] = ("IMMEDIATE",)
    contract: str = "v1"
    quality: tuple[str, ...] = ()
    quality_states: tuple[str, ...] = ("CLEAR", "UNKNOWN")
    ingest: bool = True
    availability: tuple[str, ...] = ("IMMEDIATE", "WINDOW_DERIVED", "REVERSE_DEPENDENT", "FLOW_END_ONLY", "OTHER")
    result_types: tuple[str, ...] = ("REVIEW_FINDING", "QUALITY_DEGRADED", "INSUFFICIENT_EVIDENCE")


_BASE = "direction IN ('FORWARD', 'REVERSE') AND target IS NOT NULL AND service IS NOT NULL"
_ADDRESSES = ("protocol", "src_address", "dst_address")
_TUPLE = (*_ADDRESSES, "src_port", "dst_port", "flags")
#: Flags are sets: their order never matters, and what a rule does not name is free. Scan lanes read them in any case.
#: (prepared() makes the upper-case set, once a record.)
_ANY_CASE = "_any_case"
_ATTEMPT = f"array_contains({_ANY_CASE}, 'SYN') AND NOT array_contains({_ANY_CASE}, 'ACK')"
_ROLES = "((direction = 'FORWARD' AND initiator = wire_src AND target = wire_dst) OR (direction = 'REVERSE' AND initiator = wire_dst AND target = wire_src))"
_SCAN = f"protocol = 6 AND direction = 'FORWARD' AND {_ROLES} AND {_ATTEMPT}"
_EXCHANGE = (
    f"protocol = 6 AND {_ROLES} AND ((direction = 'FORWARD' AND (({_ATTEMPT}) OR (array_contains({_ANY_CASE}, 'ACK') AND NOT arrays_overlap({_ANY_CASE}, array('SYN', 'RST'))))) "
    f"OR (direction = 'REVERSE' AND ((array_contains({_ANY_CASE}, 'SYN') AND array_contains({_ANY_CASE}, 'ACK')) OR array_contains({_ANY_CASE}, 'RST'))))"
)
#: The 16 lanes; conditions differ in small ways that matter (which flags, which directions).
LANES = (
    Lane("ddos.syn_state", "PACKET", _TUPLE, ("PACKET_FACTS",), f"protocol = 6 AND {_BASE} AND size(flags) > 0 AND size(array_except(flags, array('SYN', 'ACK', 'RST'))) = 0"),
    Lane("ddos.udp_demand", "PACKET", ("protocol",), ("PACKET_FACTS",), f"protocol = 17 AND {_BASE}"),
    Lane("ddos.reflection_victim", "PACKET", ("protocol", "src_address", "observed_l4_facts"), ("PACKET_FACTS",), f"protocol = 17 AND direction = 'FORWARD' AND response_like AND trim(protocol_context) <> '' AND {_BASE}"),
    Lane("ddos.source_diversity", "PACKET", ("protocol", "src_address"), ("PACKET_FACTS",), f"length(src) > 0 AND protocol BETWEEN 0 AND 255 AND {_BASE}"),
    Lane("ddos.icmp_demand", "PACKET", ("protocol",), ("PACKET_FACTS",), f"protocol = 1 AND {_BASE}"),
    Lane("ddos.fragment_demand", "PACKET", ("protocol", "fragmentation"), ("PACKET_FACTS",), f"is_fragment AND {_BASE}"),
    Lane("ddos.connection_churn", "PACKET", _TUPLE, ("PACKET_FACTS",), f"protocol = 6 AND direction = 'FORWARD' AND array_contains(flags, 'SYN') AND NOT arrays_overlap(flags, array('ACK', 'RST')) AND {_BASE}"),
    Lane("recon.h", "PACKET", _TUPLE, ("PACKET_FACTS",), _SCAN),
    Lane("recon.v", "PACKET", _TUPLE, ("PACKET_FACTS",), _SCAN),
    Lane("recon.2d", "PACKET", _TUPLE, ("PACKET_FACTS",), _SCAN),
    Lane("recon.tcp", "PACKET", _TUPLE, ("PACKET_FACTS",), _EXCHANGE),
    Lane("c2.r1", "FLOW", ("start_time", "protocol"), ("FLOW_FACTS",), "start_us = us AND initiator IS NOT NULL AND target IS NOT NULL AND dport IS NOT NULL", ("IMMEDIATE", "FLOW_END_ONLY")),
    Lane("unusual_transfer.m1", "FLOW", ("supplied_directional_counters", "start_time", "end_time"), (), "forward_state IN ('AVAILABLE', 'DEGRADED') AND arrays_overlap(counters, array('bytes_c2s', 'packets_c2s'))", ("FLOW_END_ONLY",), result_types=("REVIEW_FINDING",)),
    Lane("dga.m1", "DNS", ("qname",), ("CLEAR_DNS_FIELDS",), "1 = 1", result_types=("REVIEW_FINDING", "ANALYTIC_UNAVAILABLE")),
    Lane("dns_tunnelling.t1", "DNS", ("qname", "labels", "qname_canonical", "representation_version"), ("CLEAR_DNS_FIELDS",), "1 = 1", result_types=("REVIEW_FINDING",)),
    Lane("encrypted_session.enc_a", "TLS", ("parsed_handshake_metadata",), ("TLS_HANDSHAKE_METADATA",), "1 = 1", quality=("parser",), result_types=("REVIEW_FINDING",)),
)
LANE_SCHEMA = "lane_id string, observation_type string, fields array<string>, capabilities array<string>, finality array<string>, quality_facts array<string>, ingest boolean, result_types array<string>, lane_contract string"


def lane_table(spark: SparkSession, lanes: tuple[Lane, ...] = LANES) -> DataFrame:
    ids = [x.lane_id for x in lanes]
    if len(set(ids)) < len(ids):
        raise ValueError("lane ids must be distinct")
    return spark.createDataFrame([(x.lane_id, x.observation_type, list(x.fields), list(x.capabilities), list(x.finality), list(x.quality), x.ingest, list(x.result_types), x.contract) for x in lanes], LANE_SCHEMA)


#: Contracts that stand for none. A lane that names one accepts records of every contract.
PLACEHOLDERS = ("NOT_YET_GOVERNED", "NOT_APPLICABLE")


def _names(lanes: tuple[Lane, ...]) -> tuple[list[str], list[str]]:
    """Fields and capabilities that some lane needs, in the order of their bits."""
    return sorted({f for x in lanes for f in x.fields}), sorted({c for x in lanes for c in x.capabilities})


def _mask(column: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.array_contains(column, n), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0)).cast("long")


def prepared(records: DataFrame, lanes: tuple[Lane, ...]) -> DataFrame:
    """records with what all lanes' tests read, made once a record: present fields and capabilities as bits, flags in one case."""
    fields, views = _names(lanes)
    if max(len(fields), len(views)) > 60:
        raise ValueError("more than 60 fields or capabilities")
    made = {"_fields": _mask("present_fields", fields), "_views": _mask("available", views)}
    if "flags" in records.columns:
        made["_any_case"] = F.split(F.upper(F.concat_ws(",", "flags")), ",")
    return records.withColumns(made)


def matches(lane: Lane) -> Column:
    """Does the record meet the lane's own condition? What it does not know is no match."""
    return F.coalesce(F.expr(lane.predicate), F.lit(False))


def _lacks(column: str, wanted: tuple[str, ...], names: list[str]) -> Column:
    """Is one of the wanted names missing?"""
    need = sum(1 << names.index(n) for n in set(wanted))
    return F.col(column).bitwiseAND(F.lit(need)) != need


def _refused(lane: Lane) -> dict[str, Column]:
    """What a lane holds against a record's contract, finality and basis of availability."""
    contract = F.lit(False) if lane.contract in PLACEHOLDERS else ~F.col("contract").eqNullSafe(lane.contract)
    return {
        "contract": contract, "finality": ~F.coalesce(F.col("record_finality").isin(*lane.finality), F.lit(False)),
        "availability": ~F.coalesce(F.col("availability_basis").isin(*lane.availability), F.lit(False)),
    }


def enters(lane: Lane, lanes: tuple[Lane, ...] = LANES) -> Column:
    """May the record enter the lane by its structure? Reads prepared() records."""
    (fields, views), refused = _names(lanes), _refused(lane)
    return ~(_lacks("_fields", lane.fields, fields) | _lacks("_views", lane.capabilities, views) | refused["contract"] | refused["finality"] | refused["availability"])


def structural_reasons(lane: Lane, lanes: tuple[Lane, ...] = LANES) -> Column:
    """Why a record cannot enter the lane, comma-separated in the order in which reasons are reported; empty if it can."""
    (fields, views), refused = _names(lanes), _refused(lane)
    return F.concat_ws(
        ",", F.when(refused["contract"], "CONTRACT_MISMATCH"), F.when(_lacks("_fields", lane.fields, fields), "REQUIRED_FIELD_MISSING"),
        F.when(_lacks("_views", lane.capabilities, views), "REQUIRED_CAPABILITY_UNAVAILABLE"),
        F.when(refused["finality"], "FINALITY_UNSUPPORTED"), F.when(refused["availability"], "AVAILABILITY_UNSUPPORTED"),
    )


def admission_reasons(lane: Lane, lanes: tuple[Lane, ...] = LANES) -> Column:
    """Every reason against admission, once for each missing field, capability and quality fact, comma-separated.

    A required quality fact must be in one of the lane's states; one that is not known at all (NULL) is in none.
    """
    (names, views), refused = _names(lanes), _refused(lane)
    fields = [F.when(_lacks("_fields", (n,), names), f"REQUIRED_FIELD_MISSING:{n}") for n in lane.fields]
    seen = [F.when(_lacks("_views", (n,), views), f"REQUIRED_CAPABILITY_UNAVAILABLE:{n}") for n in lane.capabilities]
    quality = [F.when(~F.coalesce(F.col(f"{q}_quality").isin(*lane.quality_states), F.lit(False)), f"QUALITY_INSUFFICIENT:{q}") for q in lane.quality]
    return F.concat_ws(
        ",", F.lit(None if lane.ingest else "INGEST_NOT_PERMITTED"), *fields, F.when(refused["contract"], "CONTRACT_MISMATCH"),
        F.when(refused["finality"], "FINALITY_UNSUPPORTED"), F.when(refused["availability"], "AVAILABILITY_UNSUPPORTED"), *seen, *quality,
    )


def for_each_lane(records: DataFrame, columns: Callable[[Lane], list[Column]], lanes: tuple[Lane, ...] = LANES) -> DataFrame:
    """obs_id, lane_id and the lane's columns for each record and each lane that accepts its type.

    A record's decisions are one array built by generated code and unfolded: no join with the lanes and no shuffle.
    """
    kinds: dict[str, list[Column]] = {}
    for x in lanes:
        kinds.setdefault(x.observation_type, []).append(F.struct(F.lit(x.lane_id).alias("lane_id"), *columns(x)))
    made = None
    for kind, structs in kinds.items():
        here = F.col("observation_type") == kind
        made = F.when(here, F.array(*structs)) if made is None else made.when(here, F.array(*structs))
    return prepared(records, lanes).select("obs_id", F.inline(made))


def route_plan(records: DataFrame, lanes: tuple[Lane, ...] = LANES) -> DataFrame:
    """One decision for each record and candidate lane: structural reasons, else SELECTED or PREDICATE_FALSE."""
    # The text of reasons is made for refused records only.
    reasons = lambda x: F.when(enters(x, lanes), F.when(matches(x), "SELECTED").otherwise("PREDICATE_FALSE")).otherwise(structural_reasons(x, lanes))
    rows = for_each_lane(records, lambda x: [reasons(x).alias("reasons")], lanes)
    return rows.select("obs_id", "lane_id", (F.col("reasons") == "SELECTED").alias("selected"), "reasons")


def fan_out(records: DataFrame, lanes: tuple[Lane, ...] = LANES) -> DataFrame:
    """Each record once for every lane that selects it, in one pass and independently of the others."""
    flags = [F.when((F.col("observation_type") == x.observation_type) & enters(x, lanes) & matches(x), x.lane_id) for x in lanes]
    return prepared(records, lanes).withColumn("routes", listed(*flags)).select(*records.columns, "routes")


def admit(records: DataFrame, lanes: tuple[Lane, ...] = LANES) -> DataFrame:
    """Admission of each record to each candidate lane, with every reason against it."""
    rows = for_each_lane(records, lambda x: [admission_reasons(x, lanes).alias("reasons")], lanes)
    return rows.select("obs_id", "lane_id", (F.col("reasons") == "").alias("admitted"), "reasons")


#: Payload fields that a record of each type may declare as present.
PAYLOAD_FIELDS = {
    "PACKET": ("protocol", "src_address", "dst_address", "src_port", "dst_port", "flags", "observed_l4_facts", "fragmentation", "lengths"),
    "FLOW": ("start_time", "end_time", "export_time", "supplied_directional_counters", "endpoints", "protocol"),
    "DNS": ("qname", "qtype", "labels", "qname_canonical", "representation_version", "rcode"),
    "TLS": ("parsed_handshake_metadata", "parsed_record_metadata", "prefix_time"),
    "QUIC": ("outer_header", "version", "connection_id_length"),
}


def envelope_errors(records: DataFrame) -> DataFrame:
    """records with the list of what is wrong with each envelope; empty means valid.

    payload_type is the type of the payload that came with the record, null_fields the payload's fields without a value.
    """
    allowed = F.lit(None).cast("array<string>")
    for kind, fields in PAYLOAD_FIELDS.items():
        allowed = F.when(F.col("observation_type") == kind, F.array(*map(F.lit, fields))).otherwise(allowed)
    known = F.col("direction") != "UNKNOWN"
    return records.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("availability_us") < F.col("us"), "CAUSAL_TIME_BEFORE_EVENT_TIME"),
        F.when(known & (F.col("direction_basis") == "UNKNOWN"), "DIRECTION_WITHOUT_BASIS"),
        F.when((F.col("direction") == "FORWARD") & F.array_contains("unavailable", "FORWARD_FACTS"), "DIRECTION_CONTRADICTS_VISIBILITY")
        .when((F.col("direction") == "REVERSE") & F.array_contains("unavailable", "REVERSE_FACTS"), "DIRECTION_CONTRADICTS_VISIBILITY"),
        F.when((F.col("quality") == "DEGRADED") & F.col("quality_ref").isNull(), "DEGRADED_QUALITY_WITHOUT_REFERENCE"),
        F.when(F.col("payload_type") != F.col("observation_type"), "WRONG_PAYLOAD_TYPE"),
        F.when(F.size(F.array_except("present_fields", F.coalesce(allowed, F.array().cast("array<string>")))) > 0, "IMPOSSIBLE_PRESENT_FIELD"),
        F.when(F.arrays_overlap("present_fields", "null_fields"), "NULL_FIELD_PRESENT"),
    )))
