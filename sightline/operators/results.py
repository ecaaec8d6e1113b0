"""Result rows: finalizing, validating, appending, filtering, paging, projecting."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.core import content_id, encode_cursor, uuid5
from sightline.operators.relate import dropped, stored

#: Status kinds and priorities of the result types that are shown as status.
STATUS = {
    "QUALITY_DEGRADED": ("QUALITY_NOTIFICATION", "ATTENTION"), "PREREQUISITE_MISSING": ("CAPABILITY_NOTIFICATION", "ATTENTION"), "INSUFFICIENT_EVIDENCE": ("EVIDENCE_STATUS", "INFO"),
    "ANALYTIC_UNAVAILABLE": ("SYSTEM_CAPABILITY_STATUS", "ATTENTION"), "PLUGIN_STATUS": ("PLUGIN_STATUS", "INFO"),
}
#: Threat class and confidence basis by lane prefix.
CLASSES = {
    "ddos.": ("DDOS", "STATISTICAL_SUPPORT"), "c2.": ("BOTNET_C2_BEACONING", "STATISTICAL_SUPPORT"), "dga.m1": ("DGA", "MODEL_SCORE"), "dns_tunnelling.": ("DNS_TUNNELLING", "OBSERVED_EVIDENCE"),
    "encrypted_session.": ("MALWARE_IN_ENCRYPTED_SESSION", "OBSERVED_EVIDENCE"), "recon.": ("RECONNAISSANCE", "STATISTICAL_SUPPORT"), "unusual_transfer.": ("DATA_EXFILTRATION", "OBSERVED_EVIDENCE"),
}
#: The name space of URLs for name-based UUIDs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def all_results(*drafts: DataFrame) -> DataFrame:
    """Bag union of the lanes' drafts; lanes are never fused or deduplicated against each other."""
    out = drafts[0]
    for d in drafts[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def finalize(drafts: DataFrame, lanes: DataFrame, evidence: tuple[str, ...]) -> DataFrame:
    """Drafts with lane metadata, ordered-unique source ids (the trigger first) and a content id."""
    rows = drafts.join(F.broadcast(lanes), "lane_id").withColumn("source_ids", F.array_distinct(F.concat(F.array("trigger_id"), F.coalesce("support", F.array().cast("array<string>")))))
    return rows.withColumn("result_id", content_id("result", "lane_id", "result_type", "source_ids", "lane_version", *evidence))


def rule_errors(results: DataFrame) -> Column:
    """What the result rules object to, in order; results has the lane's allowed types and its evidence_only flag."""
    alert = F.col("result_type") == "THREAT_ALERT"
    return F.array_compact(F.array(
        F.when(F.size("taxonomy") != 3, "TAXONOMY"), F.when(F.coalesce(F.trim("lane_version"), F.lit("")) == "", "MISSING_VERSION"), F.when(F.coalesce(F.col("mechanism_id"), F.lit("")) == "", "MISSING_MECHANISM"),
        F.when(~F.array_contains("allowed_types", F.col("result_type")), "TYPE_NOT_GOVERNED"), F.when(alert & F.col("evidence_only"), "ALERT_FROM_EVIDENCE_LANE"),
        F.when(alert & F.col("confidence").isNull(), "ALERT_WITHOUT_CONFIDENCE"), F.when(~alert & F.col("confidence").isNotNull(), "CONFIDENCE_ON_NON_ALERT"),
    ))


def only_new(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose id is not stored yet, each id once. Rows with one id and several contents are conflicts()."""
    return batch.groupBy("result_id").agg(F.min("content_hash").alias("content_hash")).join(existing, "result_id", "left_anti")


def conflicts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids that come with another content than the stored one, or with several in one batch."""
    stored = batch.join(existing.select("result_id", F.col("content_hash").alias("stored")), "result_id").where("content_hash <> stored").select("result_id")
    twice = batch.groupBy("result_id").agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b")).where("a <> b").select("result_id")
    return stored.union(twice).distinct()


def append_results(batch: DataFrame, path: str) -> int:
    """Append the batch's new rows to the table at path; returns their number. A second run adds nothing; a conflict is an error.

    One writer at a time: two that append at once may both find an id missing.
    """
    spark = batch.sparkSession
    try:
        existing = spark.read.parquet(path).select("result_id", "content_hash")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        existing = spark.createDataFrame([], "result_id string, content_hash string")
    if not conflicts(batch.select("result_id", "content_hash"), existing).isEmpty():
        raise ValueError("a stored result id comes with other content")
    fresh = stored(batch.dropDuplicates(["result_id"]).join(existing, "result_id", "left_anti"))
    fresh.write.mode("append").partitionBy(*[c for c in ("lane_id", "created_date") if c in batch.columns]).parquet(path)
    added = fresh.count()
    dropped(fresh)
    return added


def explode_children(results: DataFrame, field: str) -> DataFrame:
    """(result_id, position, value) of a multi-value field, in order."""
    return results.select("result_id", F.posexplode(field).alias("position", "value"))


def filter_results(results: DataFrame, lane: str | None = None, mechanism: str | None = None, result_type: str | None = None, source: str | None = None, after_us: int | None = None, before_us: int | None = None) -> DataFrame:
    """Results by lane, mechanism, type, one of their sources, and creation strictly after or before."""
    out = results
    for column, value in (("lane_id", lane), ("mechanism_id", mechanism), ("result_type", result_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if after_us is not None:
        out = out.where(F.col("created_us") > after_us)
    if before_us is not None:
        out = out.where(F.col("created_us") < before_us)
    return out if source is None else out.where(F.array_contains("source_ids", source))


def get_result(results: DataFrame, result_id: str) -> DataFrame:
    return results.where(F.col("result_id") == result_id)


def page_results(results: DataFrame, cursor: tuple[int, str] | None, limit: int, direction: str) -> DataFrame:
    """A keyset page on (created_us, result_id): 'before' the cursor descending, 'after' it ascending, with cursors.

    One row more than the limit is looked up to tell whether a next page exists.
    """
    out, key = results, F.struct("created_us", "result_id")
    if cursor:
        at = F.struct(F.lit(cursor[0]).cast("long").alias("created_us"), F.lit(cursor[1]).alias("result_id"))
        out = out.where(key < at if direction == "before" else key > at)
    order = [F.desc("created_us"), F.desc("result_id")] if direction == "before" else [F.asc("created_us"), F.asc("result_id")]
    from pyspark.sql import Window

    rows = out.orderBy(*order).limit(limit + 1)
    rows = rows.withColumn("row", F.row_number().over(Window.orderBy(*order))).withColumn("has_next", F.max("row").over(Window.partitionBy()) > limit)
    return rows.where(F.col("row") <= limit).withColumn("cursor", encode_cursor(F.col("created_us").cast("string"), F.col("result_id")))


def latest_n(results: DataFrame, n: int = 500) -> DataFrame:
    return results.orderBy(F.desc("created_us"), F.desc("result_id")).limit(n)


def project_alerts(results: DataFrame, policy: str = "v1") -> DataFrame:
    """Review findings as alerts; only the model lane has a numeric score."""
    lane, kind, basis = F.col("lane_id"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, (k, b) in CLASSES.items():
        kind, basis = F.when(lane.startswith(prefix), k).otherwise(kind), F.when(lane.startswith(prefix), b).otherwise(basis)
    return results.where("result_type = 'REVIEW_FINDING'").select(
        uuid5(URL_SPACE, F.concat(F.lit(f"urn:sightline:{policy}:alert:"), "result_id")).alias("alert_id"), "result_id", "lane_id", kind.alias("threat_class"), F.lit("REVIEW").alias("severity"),
        basis.alias("confidence_basis"), F.when(lane == "dga.m1", F.col("score")).alias("confidence_score"),
    )


def project_status(results: DataFrame) -> DataFrame:
    """Kind and priority of the result types that are status; the others have no row."""
    rows = results.sparkSession.createDataFrame([(t, k, p) for t, (k, p) in STATUS.items()], "result_type string, status_kind string, priority string")
    return results.join(F.broadcast(rows), "result_type").select("result_id", "lane_id", "result_type", "status_kind", "priority")


def search_results(results: DataFrame, text: str, result_type: str | None = None, quality: str | None = None, capability: str | None = None, threat_class: str | None = None, basis: str | None = None) -> DataFrame:
    """Substring search over id, lane, mechanism and title, with filters on type, overall quality, a visible capability, and the lane's threat class and confidence basis."""
    hay = F.lower(F.concat_ws(" ", "result_id", "lane_id", "mechanism_id", "title"))
    out = results.where(hay.contains(text.lower()))
    if result_type:
        out = out.where(F.col("result_type") == result_type)
    if quality:
        out = out.where(F.col("quality") == quality)
    for place, value in enumerate((threat_class, basis)):
        if value is not None:
            prefixes = [p for p, said in CLASSES.items() if said[place] == value]
            out = out.where(reduce(or_, (F.col("lane_id").startswith(p) for p in prefixes), F.lit(False)))
    return out if capability is None else out.where(F.exists("capabilities", lambda c: c == capability))


def mechanism_summary(results: DataFrame) -> DataFrame:
    """Counts for each lane and type, with a subtotal for each lane and the total (rollup)."""
    return results.rollup("lane_id", "result_type").agg(F.count("*").alias("results"), F.sum(F.size("source_ids")).alias("sources"))


def attribute_to_run(results: DataFrame, observations: DataFrame) -> DataFrame:
    """Results that belong to a run: stored during it with any source in it, or stored before it with all sources in it."""
    run = observations.select(F.col("source_id").alias("s")).distinct()
    sources = results.select("result_id", "sequence", "in_run", F.size("source_ids").alias("n"), F.explode("source_ids").alias("s"))
    # What is not in the run is left behind here; only sources that are come together again by result.
    held = sources.join(run, "s", "left_semi").groupBy("result_id", "sequence", "in_run", "n").agg(F.count("*").alias("here"))
    return held.where(F.col("in_run") | (~F.col("in_run") & (F.col("here") == F.col("n")))).select("result_id", "sequence", F.when(F.col("in_run"), "PERSISTED").otherwise("PRE_EXISTING").alias("attribution"))


def limitations(results: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences for the claim tokens of each result, once each, by token position. sentences: token, sentence."""
    # Claims meet by result before they are unfolded into tokens, which then stay where they are.
    tokens = results.select("result_id", "claim").repartition("result_id").select("result_id", F.posexplode(F.split("claim", ";")).alias("position", "token")).withColumn("token", F.trim("token"))
    return tokens.join(F.broadcast(sentences), "token").groupBy("result_id", "sentence").agg(F.min("position").alias("position"))


def display_quality(states: Column) -> Column:
    """Degraded if any state is, else Unknown if any is, else Clear."""
    return F.when(F.exists(states, lambda s: s == "DEGRADED"), "Degraded").when(F.exists(states, lambda s: s == "UNKNOWN"), "Unknown").otherwise("Clear")


def lane_versions(spark: SparkSession, versions: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(versions.items()), "lane_id string, lane_version string")
