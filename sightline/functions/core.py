"""Column functions shared by the operators: order, identity, names, references."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp (or a zone-less one, read as UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def causal_order(time: str = "us", position: str | None = None, identity: str = "obs_id") -> list[Column]:
    """Event time, then source position (whole numbers first and by value, else by text), then id."""
    keys = [F.col(time)]
    if position:
        p = F.col(position)
        keys += [F.when(p.rlike("^[0-9]+$"), 0).otherwise(1), p.try_cast("decimal(38,0)"), p]
    return [*keys, F.col(identity)]


def resolve_role(roles: Column | str, label: str) -> Column:
    """The one non-empty identifier with this role; NULL if there is none or more than one."""
    found = F.filter(roles, lambda r: (r["role"] == label) & (F.trim(r["identifier"]) != ""))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))["identifier"])


def listed(*texts: Column) -> Column:
    """Those of these texts that are not NULL; none is empty. array_compact() would have all that is inside interpreted for each row; this is generated code."""
    return F.array_remove(F.split(F.concat_ws("\u0001", *texts), "\u0001"), "")


def named_roles(roles: Column | str) -> Column:
    """The roles whose identifier is not empty: what sole_identifier() reads, made once a row for all labels."""
    return F.filter(roles, lambda r: F.trim(r["identifier"]) != "")


def sole_identifier(named: str, label: str) -> Column:
    """resolve_role() over a column of named_roles()."""
    labels = F.col(named)["role"]
    once = F.size(labels) - F.size(F.array_remove(labels, label)) == 1
    return F.when(once, F.get(F.col(named)["identifier"], (F.array_position(labels, label) - 1).cast("int")))


def endpoint_pair(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """Both endpoints in a fixed order, so that either direction gives the same key."""
    return F.array_sort(F.array(F.struct(src.alias("address"), sport.alias("port")), F.struct(dst.alias("address"), dport.alias("port"))))


def content_id(prefix: str, *columns: str) -> Column:
    """prefix:SHA-256 over the named values as canonical JSON (names sorted, NULLs kept)."""
    body = F.to_json(F.struct(*(F.col(c).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}:"), F.sha2(body, 256))


def config_hash(parameters: dict) -> str:
    """SHA-256 over the canonical JSON of a lane's executable parameters."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def canonical_name(name: str) -> Column:
    """Lower case and without one trailing dot; NULL where name_problem says why not."""
    n = F.col(name)
    plain = F.regexp_replace(F.lower(n), r"\.$", "")
    return F.when(name_problem(name).isNull(), plain)


#: Why a name has no canonical form, in the order in which they are tested.
def name_problem(name: str) -> Column:
    n = F.col(name)
    return (
        F.when(n.isNull() | (n == ""), "EMPTY_NAME")
        .when(n == ".", "ROOT_NAME_NOT_APPLICABLE")
        .when(n.rlike(r"(?U)[\s\x1c-\x1f]"), "WHITESPACE_IN_NAME")
        .when(n.startswith(".") | n.contains("..") | F.regexp_replace(n, r"\.$", "").endswith("."), "EMPTY_LABEL")
    )


def labels(name: str) -> Column:
    return F.split(canonical_name(name), r"\.")


def public_refs(refs: Column | str) -> Column:
    """References without private locators and file-system paths."""
    private = lambda r: r.startswith("drive:") | F.lower(r).contains("drive.google.com") | F.lower(r).rlike(r"[a-z]:\\|/users/|/home/")
    return F.filter(refs, lambda r: ~private(r))


def encode_cursor(time: Column, identity: Column) -> Column:
    """URL-safe base64 of time, NUL, id."""
    return F.translate(F.base64(F.encode(F.concat(time, F.lit("\u0000"), identity), "UTF-8")), "+/", "-_")


def decode_cursor(cursor: Column) -> Column:
    parts = F.split(F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8"), "\u0000")
    return F.struct(F.get(parts, F.lit(0)).alias("time"), F.get(parts, F.lit(1)).alias("identity"))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def ipv4(address: Column) -> Column:
    """An IPv4 address as a number; NULL if it is none."""
    p = F.split(address, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("long")
    value = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    good = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(p, lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return F.when(good, value)
