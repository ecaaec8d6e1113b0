"""Document fingerprints: exact digests of canonical text, with byte comparison inside equal buckets.

Canonical form: NFKC, case folding, NFKC again (folding may undo it), runs of white space as one space, none at the ends. The digest is 128 bits wide:
two xxhash64 values, the second over a constant and the text. Documents with equal digests are then
compared with the bucket's smallest id byte by byte; one that differs (a clash of digests) gets a fingerprint of its own.
DataFrame and SQL functions only; NFKC comes from the Unicode library that ships with Spark.

Defined cases: a null text counts as empty; equal canonical texts have equal fingerprints, whatever
the ids; rows with the same doc_id count as one neighbour (the smallest of their texts gives the head);
the last document's neighbour is the first, also when there is only one; a row without doc_id has no
neighbour and keeps its text; an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common

SPACE = r"[\s\u0085   -     　]+"
SECOND = "second half"
#: Members of a bucket that compare with one copy of its representative; larger buckets get more copies.
BUCKET_SHARE = 4096
NO_ID = -(2**63)


def canonical(text: str) -> Column:
    """The canonical form of a non-null text column. Only for projections: Spark takes java_method as not repeatable."""
    nfkc = lambda x: f"java_method('com.ibm.icu.text.Normalizer', 'compose', {x}, true)"
    folded = nfkc(f"java_method('com.ibm.icu.lang.UCharacter', 'foldCase', {nfkc(text)}, true)")
    form = F.expr(f"CASE WHEN {text} RLIKE '[^\\\\x00-\\\\x7f]' THEN {folded} ELSE lower({text}) END")
    return F.trim(F.regexp_replace(form, SPACE, " "))


def digest(form: Column | str) -> Column:
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit(SECOND), form)))


def clashes(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc_id, own) for documents whose canonical bytes differ from those of their bucket's representative.

    digests: doc_id, digest for each row. Only buckets of two or more are read again. A large bucket is
    spread over copies of its representative, so its members never meet in one task.
    """
    ids = digests.where("doc_id is not null").distinct()
    buckets = ids.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    buckets = buckets.withColumn("copies", (1 + F.col("size") / BUCKET_SHARE).cast("int"))
    members = ids.join(buckets, "digest").select("doc_id", "digest", "rep", "copies")
    wanted = common.wanted_rows(common.text_rows(docs), members.select("doc_id"))
    forms = wanted.join(members, "doc_id").select("doc_id", "digest", (F.col("doc_id") == F.col("rep")).alias("head"), "copies", canonical("text").alias("form"))
    # The representative goes to every copy of its bucket, each member to one: one shuffle, and what comes first in a copy is the representative.
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    dealt = forms.select("doc_id", "digest", "head", "form", F.explode(F.when(F.col("head"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(own)).alias("copy"))
    first = F.first("form").over(Window.partitionBy("digest", "copy").orderBy(F.desc("head"), "form"))
    return dealt.withColumn("first", first).where(~F.col("head") & (F.col("form") != F.col("first"))).groupBy("doc_id").agg(F.min(F.sha2("form", 256)).alias("own"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row of docs."""
    rows = common.text_rows(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), canonical("text").alias("form"))
    found = common.materialize(rows.select("doc_id", "n_chars", digest("form").alias("digest")))
    own = clashes(docs, found.select("doc_id", "digest"))
    return found.join(own, "doc_id", "left").select("doc_id", "n_chars", _named("digest", "own").alias("fingerprint"))


def _named(value: str, own: str) -> Column:
    return F.when(F.col(own).isNull(), F.col(value)).otherwise(F.concat_ws("-", value, F.substring(own, 1, 16)))


def previous_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_chars): each id with the one before it in ascending order; the first with the last.

    Ids are range-partitioned; only one row for each partition meets in a single task.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("n_chars").alias("n_chars"))
    parts = common.materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("doc_id")
    over = Window.orderBy("part")
    ends = parts.groupBy("part").agg(F.max(F.struct("doc_id", "n_chars")).alias("last"))
    ends = ends.select("part", F.coalesce(F.lag("last").over(over), F.max("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    rows = parts.withColumn("prev", F.lag(F.struct("doc_id", "n_chars")).over(inside)).join(F.broadcast(ends), "part")
    return rows.select("doc_id", F.coalesce("prev", "before").alias("p")).select("doc_id", F.col("p.doc_id").alias("prev_id"), F.col("p.n_chars").alias("prev_chars"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its text with the second half replaced from the next document."""
    rows = common.text_rows(docs)
    links = common.materialize(previous_ids(rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))))
    # Lengths are taken after the join, so that both uses of it share one shuffle of the texts.
    linked = rows.join(links.hint("shuffle_hash"), "doc_id", "left").withColumn("n_chars", F.char_length("text").cast("long"))
    # A filter for NULL here would part the two uses; a row without a neighbour goes to an id that no document has.
    heads = linked.select(F.coalesce("prev_id", F.lit(NO_ID)).alias("id"), F.expr("substring(text, 1, cast(prev_chars div 2 as int))").alias("head"))
    if not rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        heads = heads.groupBy("id").agg(F.min("head").alias("head"))
    pairs = linked.join(heads, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_chars", "prev_id", "text",
        F.expr("CASE WHEN id IS NULL THEN text ELSE concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), head) END").alias("edited"),
    )
    forms = pairs.select("doc_id", "n_chars", "prev_id", F.sha2("edited", 256).alias("edited_sha256"), canonical("text").alias("form"), canonical("edited").alias("edited_form"))
    found = common.materialize(forms.select(
        "doc_id", "n_chars", "prev_id", "edited_sha256", digest("form").alias("digest"), digest("edited_form").alias("edited_digest"),
        (F.col("form") == F.col("edited_form")).alias("same"), F.sha2("edited_form", 256).alias("edited_own"),
    ))
    named = found.join(clashes(docs, found.select("doc_id", "digest")), "doc_id", "left").withColumn("fingerprint", _named("digest", "own"))
    # An edited text with its document's digest but other bytes is a clash as well.
    clash = F.when((F.col("digest") == F.col("edited_digest")) & ~F.col("same"), F.col("edited_own"))
    named = named.withColumn("clash", clash).withColumn("edited_fingerprint", F.when(F.col("same"), F.col("fingerprint")).otherwise(_named("edited_digest", "clash")))
    following = named.where("prev_id is not null").groupBy(F.col("prev_id").alias("id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    return named.join(following, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        F.coalesce(F.col("fingerprint") == F.col("next_fingerprint"), F.lit(False)).cast("double").alias("near_next"),
    )
