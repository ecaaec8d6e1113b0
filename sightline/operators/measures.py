"""Operating measures: percentiles, trends, rates, tails, conformance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: tuple[str, ...], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The element at round((n - 1) q), halves to even, of each group's sorted values: no interpolation.

    Groups are reduced to counts of distinct values first, so a large group of few values stays small.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(value)
    counts = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda q: F.bround((F.col("_n") - 1) * F.lit(q)).cast("long")
    picks = [F.min(F.when(F.col("_end") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()]
    return counts.groupBy(*by).agg(F.sum("_c").alias("samples"), *picks)


def backlog_trend(rows: DataFrame, by: str, x: str, y: str, most: float = 2.0) -> DataFrame:
    """Least-squares slope, first- and last-quarter means, peak and final value of a series; stable if it ends empty and rises slowly."""
    order = Window.partitionBy(by).orderBy(x)
    t = rows.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    quarter = F.greatest(F.floor(F.col("_n") / 4), F.lit(1))
    t = t.groupBy(by).agg(
        F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.avg(F.when(F.col("_i") <= quarter, F.col(y))), 6).alias("first_quarter"),
        F.round(F.avg(F.when(F.col("_i") > F.col("_n") - quarter, F.col(y))), 6).alias("last_quarter"), F.max(y).alias("peak"), F.max_by(y, x).alias("final"),
    )
    return t.withColumn("stable", (F.col("final") == 0) & (F.coalesce("slope", F.lit(0.0)) <= most))


def sustainable_rate(runs: DataFrame, least_runs: int = 3) -> DataFrame:
    """The highest rate with enough runs that all held, and the next lower one. runs: rate, held."""
    good = runs.groupBy("rate").agg(F.count("*").alias("runs"), F.bool_and("held").alias("all_held")).where("all_held")
    top = good.where(F.col("runs") >= least_runs).agg(F.max("rate").alias("sustainable"))
    return good.join(top, F.col("rate") < F.col("sustainable"), "right").groupBy("sustainable").agg(F.max("rate").alias("next_lower"))


def early_late_tail(rows: DataFrame, by: str, order: str, value: str, factor: float = 2.0, slack: float = 250.0, least: int = 8) -> DataFrame:
    """p95 of the first against the last quarter; stable if the late one is at most factor times the early one plus slack."""
    w = Window.partitionBy(by)
    t = rows.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    cut = F.floor(F.col("_n") / 4)
    part = F.when(F.col("_i") <= cut, "early").when(F.col("_i") > F.col("_n") - cut, "late")
    tails = nearest_rank(t.withColumn("part", part).where("part IS NOT NULL"), (by, "part"), value, {"p95": 0.95})
    wide = tails.groupBy(by).agg(F.max(F.when(F.col("part") == "early", F.col("p95"))).alias("early_p95"), F.max(F.when(F.col("part") == "late", F.col("p95"))).alias("late_p95"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("samples"))
    steady = (F.col("samples") < least) | (F.col("late_p95") <= factor * F.col("early_p95") + slack)
    return sizes.join(wide, by, "left").select(by, "samples", "early_p95", "late_p95", F.coalesce(steady, F.lit(True)).alias("stable"))


def repeat_medians(runs: DataFrame, config: tuple[str, ...]) -> DataFrame:
    """Median, least and greatest rate and median memory over runs that differ only in repetition."""
    return runs.groupBy(*config).agg(
        F.count("*").alias("repeats"), F.round(F.median("rate"), 6).alias("median_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
        F.round(F.median("memory"), 6).alias("median_memory"),
    )


def run_status(flags: dict[str, Column]) -> Column:
    """CLEAN, or the names of the flags that hold, in order."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
    return F.when(F.size(found) == 0, "CLEAN").otherwise(F.array_join(found, ","))


def sequence_complete(rows: DataFrame, by: str, sequence: str, start: Column | None = None) -> DataFrame:
    """Is each group's number range free of gaps and repeats? start: which rows mark a beginning; only numbers from a group's last one on count,
    and a group without one has no row."""
    if start is not None:
        begins = rows.where(start).groupBy(F.col(by).alias("_by")).agg(F.max(sequence).alias("_from"))
        rows = rows.join(begins, F.col(by).eqNullSafe(F.col("_by"))).where(F.col(sequence) >= F.col("_from")).drop("_by", "_from")
    order = Window.partitionBy(by).orderBy(sequence)
    t = rows.withColumn("_step", F.col(sequence) - F.lag(sequence).over(order))
    return t.groupBy(by).agg(
        F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count("*").alias("numbers"), F.count_if(F.col("_step") != 1).alias("breaks"),
    ).withColumn("complete", (F.col("breaks") == 0) & (F.col("numbers") == F.col("last") - F.col("first") + 1))


def latest_of(rows: DataFrame, by: tuple[str, ...], sequence: str, *values: str) -> DataFrame:
    """The values of each group's last row by sequence; a partial aggregation, no sort."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values, sequence), sequence).alias("_last")).select(*by, *(F.col(f"_last.{v}").alias(v) for v in (*values, sequence)))


def gaps_at(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """events with gap_count: declared gaps of their lane that are open at their time, both ends included.

    A gap adds one where it opens and takes one after it closes, so a count is a running sum over range partitions: no event
    meets a gap, however many are open.
    """
    from sightline.operators.ranges import running

    whole = gaps.where("lane_id IS NOT NULL AND opened_us IS NOT NULL AND (closed_us IS NULL OR closed_us >= opened_us)")
    # At one time: what opens, then events, then what closes.
    ends = whole.select("lane_id", F.inline(F.array(F.struct(F.col("opened_us").alias("us"), F.lit(0).alias("_turn"), F.lit(1).alias("_step")), F.struct(F.col("closed_us").alias("us"), F.lit(2).alias("_turn"), F.lit(-1).alias("_step")))))
    ends = ends.where("us IS NOT NULL").groupBy("lane_id", "us", "_turn").agg(F.sum("_step").alias("_step"))
    rows = events.withColumns({"_turn": F.lit(1), "_step": F.lit(0).cast("long")}).unionByName(ends, allowMissingColumns=True)
    return running(rows, ("lane_id",), [F.col("us"), F.col("_turn")], gap_count="_step").where("_turn = 1").select(*events.columns, "gap_count")


def run_conformance(actual: tuple[DataFrame, ...], declared: DataFrame) -> DataFrame:
    """One row for each declared count with what was found and, where they differ, a reason.

    actual: tables of one row each, with a column for each count; declared: one row with the same columns.
    """
    names = declared.columns
    found = reduce(DataFrame.crossJoin, actual).select(*(F.col(n).cast("long").alias(n) for n in names))
    both = found.select(F.struct(*names).alias("a")).crossJoin(declared.select(F.struct(*(F.col(n).cast("long").alias(n) for n in names)).alias("d")))
    rows = both.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"a.{n}").alias("actual"), F.col(f"d.{n}").alias("expected")) for n in names))))
    return rows.withColumn("reason", F.when(~F.col("actual").eqNullSafe(F.col("expected")), F.concat(F.upper("name"), F.lit("_DIFFER"))))
