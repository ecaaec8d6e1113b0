"""Mechanisms with hooks and gap policies: the built-in lane once more, and plain folds, in batch and in streams."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import extend, history, hooks, routing
from sightline.streaming import stateful, steps
from tests.test_keyed_streams import SECOND, run, same

TTL = 60 * SECOND


def recurrence_hooks(ttl_us, keys):
    step = steps.recurrence_step(ttl_us)
    return hooks.Hooks(keys, (), steps.RECURRENCE_OUT, lambda s, r, c: step(s, r), lambda s: s["times"][-1] + ttl_us)


def counting(warm=3):
    """Counts a key's rows since it was last forgotten; speaks at boundaries, gaps and ends too."""
    return hooks.Hooks(
        {"k": "string"}, ("v",), "what string, us long, n long", lambda s, r, c: ({"n": (s["n"] if s else 0) + r["v"], "last": r["us"]}, [("row", r["us"], (s["n"] if s else 0) + r["v"])]),
        lambda s: s["last"] + TTL, lambda s, us: (s, [("moved", us, s["n"])] if s["n"] % 4 == 0 else []), lambda s: [("ended", s["last"] + TTL, s["n"])],
        lambda s, g: (s, [("opened" if g["open"] else "closed", g["us"], s["n"] if s else 0)]), lambda s: s["n"] >= warm,
    )


def plain_fold(rows, gaps, policy, end=None):
    """The rules of the policies once more, key by key, without the operator's code."""
    out, warm = [], 3
    first = min((g[1] for g in gaps), default=None)
    events = [(us, 1, i, k, v, None) for k, us, i, v in rows] + [(at, 0, f"{kind}:{g}", k, kind, g) for g, a, b, k in gaps if k for kind, at in (("GAP_OPEN", a), ("GAP_CLOSE", b)) if at is not None]
    if policy == "DISABLE":
        events = [e for e in events if e[0] < first]
    for key in sorted({e[3] for e in events}):
        n = last = None
        held, warming, silent = set(), False, False
        for us, turn, _, k, v, gap in sorted(e for e in events if e[3] == key):
            mark = policy != "DISABLE" and any(a <= us and (b is None or us <= b) for _, a, b, _ in gaps)
            early, late = [], []
            if n is not None:
                early += [("moved", us, n)] if n % 4 == 0 else []
                if last + TTL <= us:
                    early.append(("ended", last + TTL, n))
                    n = None
            if turn:
                n, last = (n or 0) + v, us
                late.append(("row", us, n))
                warming = warming and n < warm
            else:
                late.append(("opened" if v == "GAP_OPEN" else "closed", us, n or 0))
                if v == "GAP_OPEN" and policy in ("RESET", "REENTER_WARMUP"):
                    warming = warming or (policy == "REENTER_WARMUP" and n is not None)
                    n = None
                elif v == "GAP_OPEN" and policy == "ABSTAIN":
                    held.add(gap)
                elif v == "GAP_CLOSE":
                    held.discard(gap)
            now = bool(held) or warming
            out += [(key, *x, mark) for x in ([] if silent else early) + ([] if now else late)]
            silent = now
        if n is not None and not silent and (end is None or last + TTL <= end):
            out += [(key, *x, False) for x in ([("moved", last + TTL, n)] if n % 4 == 0 else []) + [("ended", last + TTL, n)]]
    return sorted(map(str, out))


def made(seed):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(4)}", r.randrange(600) * SECOND // 2, f"e{i:03d}", r.randrange(1, 3)) for i in range(160)]
    gaps = [("g1", 20 * SECOND, 60 * SECOND, "k0"), ("g2", 50 * SECOND, 90 * SECOND, "k0"), ("g3", 100 * SECOND, None, "k1"), ("g4", 150 * SECOND, 180 * SECOND, None), ("g5", 200 * SECOND, 200 * SECOND, "k2"), ("g6", 30 * SECOND, 31 * SECOND, "nobody")]
    return rows, gaps


ROWS, GAPS = "k string, us long, obs_id string, v int", "gap_id string, opened_us long, closed_us long, k string"


@pytest.mark.parametrize("policy", hooks.POLICIES)
def test_policies_equal_a_plain_fold(spark, policy):
    rows, gaps = made(5)
    df, g = spark.createDataFrame(rows, ROWS), spark.createDataFrame(gaps, GAPS)
    for end in (None, 290 * SECOND):
        got = sorted(str(tuple(x)) for x in hooks.run_hooks(df, counting(), policy, g, end).collect())
        assert got == plain_fold(rows, gaps, policy, end)
    assert hooks.run_hooks(df.limit(0), counting(), policy, g.limit(0)).count() == 0


@pytest.mark.parametrize("policy", hooks.POLICIES)
def test_policies_in_a_stream(spark, tmp_path, policy):
    rows, gaps = made(9)
    mechanism, g = counting(), spark.createDataFrame(gaps, GAPS)
    flat = [tuple(x) for x in hooks.with_gaps(spark.createDataFrame(rows, ROWS), mechanism, g).select("k", "us", "obs_id", "v", "position", "kind", "gap_id", "turn").collect()]
    schema = "k string, us long, obs_id string, v int, position string, kind string, gap_id string, turn int"
    # The far row that ends the stream belongs to a key of its own.
    flat.insert(0, ("zz", 0, "e", 1, None, "ROW", None, 1))
    last = 300 * SECOND
    got = run(spark, tmp_path, flat, schema, lambda s: stateful.hooks_stream(s, mechanism, policy, g, "2 seconds", last), "hooks_" + policy.lower())
    want = hooks.run_hooks(spark.createDataFrame(rows, ROWS), mechanism, policy, g)
    same(got.where("k <> 'zz'"), want)


def test_a_registered_mechanism_equals_the_built_in_lane(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"c{r.randrange(3)}", r.choice([0, 5_000 * SECOND]) + r.randrange(200 * SECOND), f"f{i:03d}") for i in range(150)]
    schema, own = "client string, us long, obs_id string", recurrence_hooks(3_600 * SECOND, {"client": "string"})
    df = spark.createDataFrame(rows, schema)
    want = history.recurrence(df, ("client",), 3_600 * SECOND).drop("lane_id").withColumn("quality_degraded", F.lit(False))
    same(hooks.run_hooks(df, own), want)
    lane = routing.Lane("own.recurrence", "FLOW", (), (), "client <> 'c2'", contract="NOT_APPLICABLE")
    records = df.select("*", F.lit("FLOW").alias("observation_type"), F.lit("x").alias("contract"), F.array().cast("array<string>").alias("present_fields"), F.array().cast("array<string>").alias("available"), F.lit("IMMEDIATE").alias("record_finality"), F.lit("IMMEDIATE").alias("availability_basis"))
    registry = extend.Registry()
    registry.register(extend.Mechanism(lane, parameters={"ttl": 1}, hooks=own))
    same(registry.run(records).drop("lane_id", "config_hash"), want.where("client <> 'c2'"))
    with pytest.raises(ValueError):
        registry.register(extend.Mechanism(lane, parameters={"ttl": 1}, hooks=own))
    with pytest.raises(ValueError):
        registry.register(extend.Mechanism(routing.Lane("x", "FLOW", (), (), "true")))
    flat = [(*x, None, "ROW", None, 1) for x in rows]
    flat.insert(0, ("zz", 0, "f", None, "ROW", None, 1))
    stream = run(spark, tmp_path, flat, schema + ", position string, kind string, gap_id string, turn int", lambda s: stateful.hooks_stream(s, own, delay="2 seconds"), "own_rows")
    same(stream.where("client <> 'zz'"), want)


def test_positions_order_rows_of_one_time(spark):
    rows = [("k", 0, f"e{i}", str(p), v) for i, (p, v) in enumerate([(10, 1), (9, 2), ("x", 3)])]
    df = spark.createDataFrame(rows, "k string, us long, obs_id string, position string, v int")
    own = hooks.Hooks({"k": "string"}, ("v",), "v int, n int", lambda s, r, c: ((s or 0) + 1, [(r["v"], (s or 0) + 1)]))
    assert {r["v"]: r["n"] for r in hooks.run_hooks(df, own).collect()} == {2: 1, 1: 2, 3: 3}
