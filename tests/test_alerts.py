"""Alert rules and the greedy throttle."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditweave.operators import alerts as A
from auditweave.streaming import jobs
from tests.event_rows import at, event, make_events


def test_only_warn_and_above_alert(spark):
    ev = make_events(spark, [event(1, "s", 0), event(2, "s", 1, "warn"), event(3, "s", 2, "critical")])
    got = {(r["severity"], r["rule_id"], r["ref"]["event_id"]) for r in A.alerts_from_events(ev).collect()}
    assert got == {("warn", "ingest.severity_warn_or_above", "e00002"), ("critical", "ingest.severity_warn_or_above", "e00003")}


def test_digest_thresholds(spark):
    d = spark.createDataFrame(
        [(1, 0.1, 0.9, 20, at(0)), (2, 0.22, 0.38, 20, at(1)), (4, 0.9, 0.1, 5, at(2)), (4, 0.9, 0.9, 6, at(3)), (4, 0.9, 0.9, 0, at(4))],
        "strategy int, freshness double, diversity double, selected_n long, window_end timestamp")
    got = sorted((r["rule_id"], r["body"]) for r in A.alerts_from_digests(d, 20).collect())
    assert got == [
        ("digest.low_diversity", "diversity=0.100 strategy=4 k=20 selected=5"),
        ("digest.low_freshness", "freshness=0.100 strategy=1 k=20 selected=20"),
        ("digest.sparse_selection", "requested k=20 but only 5 events matched filters/strategy"),
    ]
    assert A.alerts_from_digests(d.where("selected_n = 5"), 4).where("rule_id = 'digest.sparse_selection'").count() == 0


def test_override_is_a_warning(spark):
    a = spark.createDataFrame([("e1", "op", "override", at(0)), ("e2", "op", "accept", at(1))],
                              "event_id string, operator_id string, action string, acted_at timestamp")
    assert {(r["title"], r["severity"]) for r in A.alerts_from_actions(a).collect()} == {
        ("Operator recorded override", "warn"), ("Operator recorded accept", "info")}


def test_audit_alert_only_on_the_edge(spark):
    c = spark.createDataFrame([("a", at(i), v) for i, v in enumerate([True, False, False, True, False])], "tenant string, checked_at timestamp, valid boolean")
    assert sorted(r["created_at"].second for r in A.alerts_from_audit(c).collect()) == [1, 4]


def alert_table(spark, rows):
    return spark.createDataFrame(
        [(f"a{i:05d}", "t", "b", "warn", rule, at(s), ref) for i, (rule, s, ref) in enumerate(rows)],
        "id string, title string, body string, severity string, rule_id string, created_at timestamp, ref map<string,string>")


def greedy(times, gap):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("few", [1000, 1])
def test_throttle_is_greedy_not_a_lag(spark, few):
    df = alert_table(spark, [("r", s, {}) for s in (0, 30, 50, 60, 100, 146)])
    got = sorted((r["created_at"] - at(0).replace(tzinfo=None)).seconds for r in A.throttle_alerts(df, 45, few=few).collect())
    assert got == [0, 50, 100, 146]


def test_event_alerts_have_their_own_key(spark):
    df = alert_table(spark, [("r", 0, {"event_id": "x"}), ("r", 1, {"event_id": "y"}), ("r", 2, {"event_id": "x"}), ("r", 3, {}), ("r", 4, {"event_id": ""})])
    assert sorted(r["id"] for r in A.throttle_alerts(df).collect()) == ["a00000", "a00001", "a00003"]


@pytest.mark.parametrize("case", range(4))
def test_block_throttle_equals_the_serial_walk(spark, case):
    rng = random.Random(case)
    gap = [5, 45, 7.5, 45][case]
    rows = []
    for rule, n, span in (("hot", 900, 4000), ("gaps", 60, 20000), ("dense", 400, 90)):
        rows += [(rule, round(rng.uniform(0, span), rng.choice([0, 3])), {}) for _ in range(n)]
    df = alert_table(spark, rows)
    block = [7, 45, 100, 600][case]
    want = sorted((rule, round(t, 3)) for rule in ("hot", "gaps", "dense") for t in greedy({s for r, s, _ in rows if r == rule}, gap))
    for few in (0, 100, 10_000):
        out = A.throttle_alerts(df, gap, few=few, block_rows=block).collect()
        got = sorted((r["rule_id"], round((r["created_at"] - at(0).replace(tzinfo=None)).total_seconds(), 3)) for r in out)
        assert got == want, few


def test_newest_first_keeps_the_last_three(spark):
    df = alert_table(spark, [(f"r{i}", i, {}) for i in range(1, 6)])
    assert [r["rule_id"] for r in A.alerts_newest_first(df, 3).collect()] == ["r5", "r4", "r3"]


def test_alerts_without_time_or_key_are_kept(spark):
    rows = [("r1", 0, {}), ("r1", 1, {}), ("r2", 0, {}), ("r3", 0, {})]
    a = alert_table(spark, rows).withColumn("created_at", F.when(F.col("id") != "a00002", F.col("created_at")))
    a = a.withColumn("rule_id", F.when(F.col("id") != "a00003", F.col("rule_id")))
    assert sorted(r["id"] for r in A.throttle_alerts(a, 45).collect()) == ["a00000", "a00002", "a00003"]


def test_blocks_go_on_over_batches():
    times = [0, 3, 7, 20, 21, 22, 40, 5, 6]
    rows = pd.DataFrame({"key": ["a"] * 7 + ["b"] * 2, "block": [0, 0, 0, 1, 1, 1, 2, 0, 0], "us": times})
    for size in (1, 2, 4, 100):
        batches = [rows.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(rows), size)]
        got = [(k, b, r["us"].tolist()) for blocks in A._by_block(iter(batches)) for k, b, r in blocks]
        assert got == [("a", 0, [0, 3, 7]), ("a", 1, [20, 21, 22]), ("a", 2, [40]), ("b", 0, [5, 6])], size


def test_small_blocks_cost_no_call_each(spark):
    times = alert_table(spark, [("r", s, {}) for s in range(300)]).select(F.col("rule_id").alias("key"), F.unix_micros("created_at").alias("us"))
    kept = A._throttle_many(times, 60_000_000, 2)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2 and "FlatMapCoGroups" not in plan  # the walk, and blocks that keep an alert
    assert sorted(r["us"] - int(at(0).timestamp()) * 1_000_000 for r in kept.collect()) == [s * 60_000_000 for s in range(5)]


def test_throttle_job_makes_its_alerts_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    df = alert_table(spark, [("r", s, {}) for s in range(50)])
    jobs.throttle_batch(str(tmp_path), 10, few=5, block_rows=4)(df.mapInPandas(count, df.schema), 0)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 5
    assert made.value == 50


def test_throttle_job_stores_what_earlier_batches_leave_open(spark, tmp_path):
    run = jobs.throttle_batch(str(tmp_path), 10)
    run(alert_table(spark, [("r", s, {}) for s in range(3)]), 0)
    run(alert_table(spark, [("r", s, {}) for s in (5, 10, 12)]), 1)
    at_of = lambda path: sorted(r["us"] - int(at(0).timestamp()) * 1_000_000 for r in spark.read.parquet(path).select(F.unix_micros("created_at").alias("us")).collect())
    assert at_of(f"{tmp_path}/raised/batch_id=1") == [10_000_000, 12_000_000]
    assert at_of(f"{tmp_path}/alerts/batch_id=1") == [10_000_000]
