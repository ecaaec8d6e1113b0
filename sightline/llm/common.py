"""Helpers shared by the text operators: tables, shared folders, worker code, label folds."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
ASCII_SPACE = " \t\n\r\x0b\f"
#: Rows and bytes of the texts that a Python worker takes at once: bound its memory, on long texts too.
BATCH_ROWS, BATCH_BYTES = 512, 8_000_000

#: Bits of the bitmap that tells which texts may be needed: 2 MB at most, whatever the number of texts.
WANTED_BITS = 2**24

_shipped: set[str] = set()
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that tasks can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "sightline_code.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
    if not found and not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="sightline-"))
    return found or _own_dir[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._sightline_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_sightline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text with null texts as empty, plus the named columns; other columns never reach the operator."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)


def bounded(batches: Iterable) -> Iterable:
    """The Arrow batches of a task, cut so that each has at most BATCH_ROWS rows, and one row or at most BATCH_BYTES."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            todo = [b.slice(at, BATCH_ROWS)]
            while todo:
                some = todo.pop()
                if some.num_rows > 1 and some.nbytes > BATCH_BYTES:
                    half = some.num_rows // 2
                    todo += [some.slice(half), some.slice(0, half)]
                else:
                    yield some


def fold_of(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod `mod`: which rows labels may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, allowed: Column | None = None) -> DataFrame:
    """Texts of at most `limit` labelled rows (the bound of the sample that classifiers here are fitted on).

    Rows are taken in the order of a hash of their id, so the sample is the same at every run and
    does not depend on how the tables are split. Only ids pass through the limit; the texts are
    fetched by a broadcast semi-join of these `limit` ids.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        picked = picked.where(allowed)
    picked = (
        picked.groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return text_rows(docs).join(F.broadcast(picked), "doc_id")


def bitmap_of(ids: DataFrame) -> tuple[DataFrame, Column]:
    """A bitmap over hashed doc_ids, of at most WANTED_BITS bits in rows (word, bits), and its word for a row's doc_id."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(WANTED_BITS))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("_sightline_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_sightline_bits"))
    return words, place


def unwanted_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids. What the broadcast bitmap of ids rules out stays where it is; only the rest meets the ids in a join."""
    words, place = bitmap_of(ids)
    rows = docs.withColumn("_sightline_place", place).join(F.broadcast(words), F.floor(F.col("_sightline_place") / 64) == F.col("_sightline_word"), "left")
    hit = F.coalesce(F.expr("bit_get(_sightline_bits, cast(_sightline_place % 64 as int)) = 1"), F.lit(False))
    maybe = rows.where(hit).select(docs.columns).join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    return rows.where(~hit).select(docs.columns).union(maybe)


def wanted_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids. A bitmap over hashed ids, of at most WANTED_BITS bits, is broadcast and stops
    most other rows before the shuffle; a join with the distinct ids then settles the rest (a semi-join would be moved below the bitmap)."""
    words, place = bitmap_of(ids)
    rows = docs.withColumn("_sightline_place", place).join(F.broadcast(words), F.floor(F.col("_sightline_place") / 64) == F.col("_sightline_word")).where(F.expr("bit_get(_sightline_bits, cast(_sightline_place % 64 as int)) = 1"))
    return rows.select(docs.columns).join(ids.select("doc_id").distinct(), "doc_id").select(docs.columns)


def chunks(items: list, size: int) -> Iterable[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs, with all their columns, for which judge(texts) says True; null texts are judged as empty.

    Rows pass through the tasks that judge them, so nothing is joined back by id.
    """
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for b in bounded(batches):
            yield b.filter(pa.array(judge([t or "" for t in b.column("text").to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
