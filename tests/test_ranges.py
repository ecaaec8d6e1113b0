"""Running totals and previous rows over range partitions against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import conform, history, lexical, ranges


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    made = [(r.choice(["hot", "hot", "hot", "a", None]), r.randrange(10_000), f"e{i:04d}", r.randrange(5)) for i in range(1500)]
    return spark.createDataFrame(made, "k string, us long, obs_id string, v long").cache()


def test_running_and_previous_equal_windows(rows):
    order = Window.partitionBy("k").orderBy("us", "obs_id")
    want = rows.select("obs_id", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lag("us").over(order))
    sums = ranges.running(rows, ("k",), [F.col("us"), F.col("obs_id")], total="v").select("obs_id", "total")
    both = sums.join(ranges.previous(rows, ("k",), ["us", "obs_id"], "us", "prior").select("obs_id", "prior"), "obs_id")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))
    parts = ranges.spread(rows, ("k",), [F.col("us"), F.col("obs_id")])
    assert parts.where("k = 'hot'").select("_part").distinct().count() > 2


def test_sessions_of_a_hot_key_are_split_by_time(rows):
    named = rows.where("k IS NOT NULL")
    plain = lambda df: sorted((r["obs_id"], r["session_no"]) for r in df.collect())
    assert plain(history.spread_sessions(named, ("k",), 30)) == plain(history.ttl_sessions(named, ("k",), 30))


def test_a_source_without_a_declared_count_is_reported(spark):
    records = spark.createDataFrame([("s", 1, 5, True), ("s", 2, 4, True), ("t", 1, 1, False)], "source_id string, position long, us long, valid boolean")
    got = {r["source_id"]: tuple(r)[1:] for r in conform.validate_bundle(records, spark.createDataFrame([("s", 2)], "source_id string, declared long")).collect()}
    assert got == {"s": (2, 2, True, 1, 0, 2), "t": (1, None, None, 0, 1, 1)}


def test_quantiles_equal_interpolation(spark):
    r = random.Random(5)
    made = [(r.choice("ab"), r.choice([0.1, 0.25, r.random(), r.random()]), r.randrange(2)) for _ in range(999)] + [("one", 0.3, 1), ("none", None, 0)]
    df = spark.createDataFrame(made, "split string, score double, label int")
    q = F.percentile("score", F.array(*map(F.lit, lexical.QUANTILES.values())))
    want = {r["split"]: None if r["q"] is None else [round(x, 9) for x in r["q"]] for r in df.groupBy("split").agg(q.alias("q")).collect()}
    got = {r["split"]: [r[n] for n in lexical.QUANTILES] for r in lexical.score_quantiles(df, "split").collect()}
    assert {k: None if v[0] is None else v for k, v in got.items()} == want
