"""What the findings of round 3 were about: steps that grew faster than their input."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@tables
def test_a_filter_on_rejects_is_not_written_out_in_terms_of_the_line(spark):
    from sightline.operators import adapt
    from sightline.plans import replay

    text = plan(adapt.envelopes(replay.source_records(spark, DATA)).where(F.size("rejects") == 0))
    below = text[text.index("Generate"):]
    assert "size(rejects" not in below and "rejects" in text


def test_a_line_is_parsed_once_for_each_step(spark):
    from sightline.sources import bundles

    lines = spark.createDataFrame([("b", 1, '{"payload": {"a": 1}}')], "bundle string, line long, value string").repartition(1)
    assert plan(bundles.parse_records(lines)).count("get_json_object(") <= 1


@tables
def test_views_hold_no_lists_of_ids(spark):
    from sightline.plans import relations

    for name in ("family_views", "finding_groups"):
        text = plan(relations.QUERIES[name](spark, DATA))
        assert "collect_set(result_id" not in text and "collect_list(source_ids" not in text, name


def test_open_gaps_are_counted_at_both_ends(spark):
    from sightline.operators import measures

    gaps = [("a", f"g{i}", i, None if i % 4 == 0 else i + i % 7) for i in range(0, 90, 3)] + [("a", "odd", 50, 40), ("b", "h", 10, 10)]
    events = [(f"e{i}", "a" if i % 3 else "b", i % 100) for i in range(300)]
    g = spark.createDataFrame(gaps, "lane_id string, gap_id string, opened_us long, closed_us long")
    e = spark.createDataFrame(events, "obs_id string, lane_id string, us long")
    want = sorted((o, x, u, sum(y == x and a <= u and (b is None or u <= b) for y, _, a, b in gaps)) for o, x, u in events)
    out = measures.gaps_at(e, g)
    assert sorted(map(tuple, out.collect())) == want and "Join Inner" not in plan(out)


@tables
def test_finalized_results_join_records_once(spark):
    from sightline.plans import relations

    text = plan(relations.QUERIES["finalized_results"](spark, DATA))
    assert "o_orderkey" not in text and "l_orderkey" not in text


def test_pairs_are_made_once_and_not_shuffled(spark):
    from sightline.operators import relate

    schema = "result_id string, family string, start_us long, end_us long, source_ids array<string>"
    rows = [("a", "X", 0, 5, ["s", "t", "s"]), ("b", "Y", 4, 9, ["t", "s", "u"]), ("c", "Y", 9, 9, ["u"]), ("d", "X", 9, 9, ["u", "t"])]
    out = relate.exact_pairs(spark.createDataFrame(rows, schema))
    text = plan(out)
    assert "Aggregate" not in text[: text.index("Join")]
    assert sorted((r[0], r[1], r[4], r[5]) for r in out.collect()) == [("a", "b", "OVERLAPPING", ["s", "t"]), ("b", "d", "OVERLAPPING", ["t", "u"]), ("c", "d", "OVERLAPPING", ["u"])]
    twice = relate.exact_pairs(spark.createDataFrame([*rows, ("a", "X", 1, 6, ["u"])], schema)).collect()
    assert sorted((r[0], r[1], r[4], r[5]) for r in twice)[:2] == [("a", "b", "OVERLAPPING", ["s", "t", "u"]), ("a", "c", "NON_OVERLAPPING", ["u"])]


def test_chronology_sorts_no_family(spark):
    from sightline.operators import relate

    rows = [("X", t, 1) for t in (5, 5, 4, 3, 2, 1, None)] + [("Y", 7, 2), ("Y", None, 1), (None, 3, 1)]
    out = relate.chronology(spark.createDataFrame(rows, "family string, created_us long, findings long"))
    assert "Window" not in plan(out)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [("X", 1, 5, 5, 2, 7), ("Y", 7, 7, 2, 0, 3), (None, 3, 3, 1, 0, 1)]))


def test_tokens_of_claims_are_not_shuffled(spark):
    from sightline.operators import results

    made = spark.createDataFrame([("r", "a; b;a"), ("r", "b"), ("q", "c")], "result_id string, claim string")
    out = results.limitations(made, spark.createDataFrame([("a", "A."), ("b", "B.")], "token string, sentence string"))
    assert sorted(map(tuple, out.collect())) == [("r", "A.", 0), ("r", "B.", 0)]
    assert "strategy=broadcast" in plan(out)
