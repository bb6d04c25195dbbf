"""Ranks and positions against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from auditweave.functions import ranking as R


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(f"e{i:04d}", "hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", rng.randrange(50)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id string, g string, v long").repartition(6)
    return rows, df.withColumn("cell", R.time_cell(F.col("v"), 4))


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_positions_are_dense_and_ordered(table):
    rows, df = table
    got = R.positions(df, ["g"], "cell", [F.col("v"), F.col("event_id")], "pos")
    found = {(r["g"], r["event_id"]): r["pos"] for r in got.collect()}
    want = {(g, r[0]): i for g, rs in groups(rows).items() for i, r in enumerate(sorted(rs, key=lambda r: (r[2], r[0])))}
    assert found == want


@pytest.mark.parametrize("skip,take", [(0, 3), (7, 20), (100, 5), (10_000, 5)])
def test_rank_band(table, skip, take):
    rows, df = table
    got = R.rank_band(df, ["g"], "cell", [F.col("v"), F.col("event_id")], F.lit(skip), F.lit(take))
    want = {(g, r[0]) for g, rs in groups(rows).items() for r in sorted(rs, key=lambda r: (r[2], r[0]))[skip:skip + take]}
    assert {(r["g"], r["event_id"]) for r in got.collect()} == want


def test_large_limits_are_salted_and_exact(spark, table):
    rows, df = table
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = R.top_n(df, ["g"], [F.col("v").desc(), F.col("event_id")], 37)
        want = {(g, r[0]) for g, rs in groups(rows).items() for r in sorted(rs, key=lambda r: (-r[2], r[0]))[:37]}
        assert {(r["g"], r["event_id"]) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_group_limit_runs_before_the_shuffle(table):
    _, df = table
    plan = R.top_n(df, ["g"], [F.col("v").desc(), F.col("event_id")], 5)._jdf.queryExecution().toString()
    assert "row_number(), 5, Partial" in plan


def test_offsets_over_bands_of_cells(table):
    rows, df = table
    for band in (1, 2, 5, 4096):
        got = R.cell_offsets(df, ["g"], "cell", band).collect()
        for g, rs in groups(rows).items():
            cells = sorted(r[2] // 4 for r in rs)
            mine = {r["cell"]: (r["_before"], r["_in_cell"], r["_n"]) for r in got if r["g"] == g}
            assert mine == {c: (cells.index(c), cells.count(c), len(cells)) for c in set(cells)}
