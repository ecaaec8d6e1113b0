"""Packet captures: classic capture files (Ethernet, IPv4) as a packet table, and their sidecar manifests.

Python only cuts a file into frames (24-byte file header, 16-byte record headers); every header
field is a column expression over the frame's bytes. Files are read in parallel; a frame keeps at most `snap` bytes.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.deploy import ship

FRAMES = "path string, position long, us long, original_length long, frame binary, error string"
#: Magic numbers of capture files as (byte order, microseconds for each fraction unit's divisor).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
SIDECAR = (
    "source_id string, capture_file string, visibility string, quality struct<packet_loss:string,sampling:string,parser:string,capture_gap:string>, direction_policy struct<a_networks:array<string>,b_networks:array<string>>, "
    "endpoint_roles map<string,array<string>>, services array<struct<target_address:string,protocol:int,port:int,service_id:string,basis:string>>, "
    "reflection_facts map<string,struct<fact_contract:string,response_like:boolean,protocol_context:string>>, packet_count bigint, capture_start timestamp, capture_end timestamp"
)


def frames_of(data: bytes):
    """(position, microseconds, original length, frame, error) of one file; a cut-off end is one last row with an error."""
    order, unit = MAGIC.get(data[:4], (None, 0))
    if order is None or len(data) < 24:
        yield 0, None, None, None, "NOT_A_CAPTURE_FILE"
        return
    if struct.unpack_from(order + "I", data, 20)[0] & 0x0FFFFFFF != 1:
        yield 0, None, None, None, "NOT_ETHERNET"
        return
    at, position = 24, 0
    while at < len(data):
        position += 1
        if at + 16 > len(data):
            yield position, None, None, None, "TRUNCATED_RECORD_HEADER"
            return
        seconds, fraction, size, original = struct.unpack_from(order + "IIII", data, at)
        at += 16
        if at + size > len(data):
            yield position, None, original, None, "TRUNCATED_RECORD"
            return
        yield position, seconds * 1_000_000 + fraction // unit, original, data[at : at + size], None
        at += size


def read_frames(spark: SparkSession, glob: str, snap: int = 256) -> DataFrame:
    ship(spark)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows = [(path, p, us, n, f if f is None else f[:snap], e) for p, us, n, f, e in frames_of(data.as_py() or b"")]
                for i in range(0, len(rows), 8192):
                    columns = list(zip(*rows[i : i + 8192]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["path", "position", "us", "original_length", "frame", "error"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, FRAMES)


def number(frame: str, at: Column | int, size: int) -> Column:
    """Big-endian unsigned number of `size` bytes at a zero-based place; NULL beyond the frame's end."""
    at = F.lit(at) if isinstance(at, int) else at
    whole = F.octet_length(frame) >= at + size
    return F.when(whole, F.conv(F.hex(F.substr(F.col(frame), at + 1, F.lit(size))), 16, 10).cast("long"))


def decode(frames: DataFrame) -> DataFrame:
    """Packets from frames: addresses, ports and flags only for IPv4 and, for fragments, only at offset 0."""
    ip = 14
    part = lambda at: F.concat_ws(".", *(number("frame", at + i, 1).cast("string") for i in range(4)))
    header = (number("frame", ip, 1) % 16) * 4
    fragment = number("frame", ip + 6, 2)
    offset, more = fragment % 8192, (fragment.bitwiseAND(0x2000)) != 0
    rows = frames.withColumn("_v4", (number("frame", 12, 2) == 0x0800) & (F.floor(number("frame", ip, 1) / 16) == 4) & (header >= 20))
    rows = rows.withColumn("_l4", F.lit(ip) + header).withColumn("protocol", F.when(F.col("_v4"), number("frame", ip + 9, 1))).withColumn("fragment_offset", F.when(F.col("_v4"), offset)).withColumn("more_fragments", F.when(F.col("_v4"), more))
    first = F.col("_v4") & (F.col("fragment_offset") == 0)
    ports = first & F.col("protocol").isin(6, 17)
    tcp = first & (F.col("protocol") == 6)
    bits = number("frame", F.col("_l4") + 13, 1)
    flags = F.array_compact(F.array(*(F.when(bits.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(TCP_FLAGS))))
    return rows.select(
        "path", F.col("position").cast("string").alias("position"), "us", "original_length", F.coalesce("error", F.when(~F.coalesce("_v4", F.lit(False)), "NOT_IPV4")).alias("error"),
        F.when(F.col("_v4"), part(ip + 12)).alias("src"), F.when(F.col("_v4"), part(ip + 16)).alias("dst"), "protocol",
        F.when(ports, number("frame", F.col("_l4"), 2)).alias("sport"), F.when(ports, number("frame", F.col("_l4") + 2, 2)).alias("dport"),
        F.when(tcp & bits.isNotNull(), flags).alias("flags"), F.when(tcp, number("frame", F.col("_l4") + 4, 4)).alias("seq"), F.when(tcp, number("frame", F.col("_l4") + 8, 4)).alias("ack"),
        F.when(first & (F.col("protocol") == 1), number("frame", F.col("_l4"), 1)).alias("icmp_type"),
        ((F.col("fragment_offset") > 0) | F.col("more_fragments")).alias("is_fragment"), "fragment_offset", "more_fragments", F.when(F.col("_v4"), number("frame", ip + 2, 2)).alias("ip_length"),
    )


def read_captures(spark: SparkSession, glob: str) -> DataFrame:
    """The packet table of all capture files that match glob."""
    return decode(read_frames(spark, glob))


def read_capture_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sidecars below path as four tables: sources, endpoint roles, services, reflection facts."""
    m = spark.read.schema(SIDECAR).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return {
        "sources": m.select("source_id", "capture_file", "visibility", "quality", "direction_policy", "packet_count", "capture_start", "capture_end"),
        "roles": m.select("source_id", F.explode("endpoint_roles").alias("address", "roles")),
        "services": m.select("source_id", F.inline("services")),
        "reflection": m.select("source_id", F.explode("reflection_facts").alias("position", "f")).select("source_id", "position", "f.*"),
    }
