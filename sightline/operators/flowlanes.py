"""Stateless lanes: DNS name structure, transfer magnitude, TLS handshake context, registrable domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.core import canonical_name, labels, name_problem

COUNTERS = ("bytes_c2s", "packets_c2s", "bytes_s2c", "packets_s2c")


def dns_structure(rows: DataFrame, name: str = "qname") -> DataFrame:
    """Lengths, label counts and character classes of canonical names; fractions are over the characters between dots."""
    rows = rows.withColumn("canonical", canonical_name(name)).withColumn("problem", name_problem(name)).withColumn("parts", labels(name))
    count = lambda pattern: F.regexp_count("canonical", F.lit(pattern))
    plain = F.char_length(F.replace("canonical", F.lit("."), F.lit("")))
    left = F.get("parts", F.lit(0))
    return rows.select(
        "obs_id", "problem", "canonical", F.char_length("canonical").alias("name_length"), F.size("parts").alias("label_count"),
        F.array_max(F.transform("parts", F.char_length)).alias("max_label_length"), F.char_length(left).alias("left_label_length"),
        (F.when(F.col("parts").isNotNull(), F.size("parts") - 1)).alias("boundaries"),
        count("[a-z]").alias("letters"), count("[0-9]").alias("digits"), count("-").alias("hyphens"), count("[^a-z0-9.-]").alias("others"),
        F.round(count("[0-9]") / plain, 6).alias("digit_fraction"), F.round(count("-") / plain, 6).alias("hyphen_fraction"),
        left.rlike("^[a-z2-7]+$").alias("base32_like"), left.rlike("^[A-Za-z0-9+/_-]+$").alias("base64_like"),
    )


def transfer_problem() -> Column:
    """Why a flow has no transfer result."""
    return (
        F.when(F.coalesce(*(F.col(c) for c in COUNTERS)).isNull(), "NO_COUNTER").when(F.trim("semantics") == "", "EMPTY_COUNTER_SEMANTICS")
        .when(F.col("end_us") < F.col("start_us"), "END_BEFORE_START")
        .when(F.least(*(F.coalesce(F.col(c), F.lit(0)) for c in COUNTERS)) < 0, "NEGATIVE_COUNTER")
    )


def transfer_magnitude(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects). Counters show only where their direction is visible; rates only with a duration."""
    seen = lambda c: F.col(c).isin("AVAILABLE", "DEGRADED")
    rows = flows.withColumn("problem", transfer_problem()).where(seen("forward"))
    duration = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    shown = {c: F.when(seen("forward" if c.endswith("c2s") else "backward"), F.col(c)) for c in COUNTERS}
    results = rows.where("problem IS NULL").select(
        "obs_id", duration.alias("duration_s"), *(v.alias(c) for c, v in shown.items()),
        F.when(seen("backward"), "BOTH").otherwise("FORWARD_ONLY").alias("direction_scope"),
        *(F.when(duration > 0, F.round(v / duration, 6)).alias(f"{c}_per_second") for c, v in shown.items()),
    )
    return results, rows.where("problem IS NOT NULL").select("obs_id", "problem")


def tls_context(rows: DataFrame, optional: tuple[str, ...]) -> DataFrame:
    """Visible handshake metadata as evidence; an optional field is there only if it is present."""
    return rows.select("obs_id", *(F.when(F.array_contains("present_fields", c), F.col(c)).alias(c) for c in optional))


def registrable_domain(rows: DataFrame, suffixes: DataFrame, name: str = "qname") -> DataFrame:
    """The label before the longest known suffix, with that suffix. suffixes: suffix.

    Every ending of a name is a candidate; an equi-join with the suffix table keeps the known ones and the
    longest wins.
    """
    rows = rows.withColumn("canonical", canonical_name(name)).withColumn("parts", labels(name)).withColumn("problem", name_problem(name))
    good = rows.where("problem IS NULL")
    ends = good.select("obs_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")).withColumn("suffix", F.array_join(F.slice("parts", -F.col("n"), F.col("n")), "."))
    best = ends.join(suffixes, "suffix").groupBy("obs_id").agg(F.max("n").alias("n"))
    out = rows.join(best, "obs_id", "left")
    reason = (
        F.coalesce("problem", F.when(F.col("canonical").rlike("[^\\x00-\\x7f]"), "UNICODE_IDNA_POLICY_UNRESOLVED"),
                   F.when(F.col("n").isNull(), "UNKNOWN_OR_INTERNAL_SUFFIX"), F.when(F.size("parts") <= F.col("n"), "NO_REGISTRABLE_DOMAIN"))
    )
    whole = F.array_join(F.slice("parts", -(F.col("n") + 1), F.col("n") + 1), ".")
    return out.withColumn("reason", reason).select("obs_id", "canonical", F.when(F.col("reason").isNull(), whole).alias("registrable"), "reason")


def representation_audit(rows: DataFrame, old: DataFrame, new: DataFrame, examples: int = 10) -> DataFrame:
    """Names whose registrable domain is the same, changed or unavailable under another suffix table, with the first examples."""
    from pyspark.sql import Window

    a = registrable_domain(rows, old).select("obs_id", F.col("registrable").alias("old"))
    b = registrable_domain(rows, new).select("obs_id", F.col("registrable").alias("new"))
    both = a.join(b, "obs_id").withColumn("category", F.when(F.col("old").isNull() | F.col("new").isNull(), "UNAVAILABLE").when(F.col("old") == F.col("new"), "EXACT").otherwise("CHANGED"))
    names = both.groupBy("category").agg(F.count("*").alias("names"))
    # Only the first few of each category leave their partitions.
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("obs_id"))).where(F.col("_n") <= examples)
    return names.join(first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("obs_id")), ",").alias("examples")), "category")
