"""Evenly spaced rows are numbered inside range partitions."""

from sightline.operators import lexical


def test_model_delta_numbers_rows_inside_partitions(spark, capsys):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS key", "id * 0.5D AS old", "id * 1.0D AS new").repartition(5)
    got = lexical.model_delta(rows, 10)
    assert sorted(r["key"] for r in got.collect()) == list(range(0, 1000, 100))
    got.explain("formatted")
    windows = capsys.readouterr().out.split("Window\n")
    assert any("_part" in w and "row_number" in w for w in windows) and not any("row_number() windowspecdefinition(key" in w for w in windows)
