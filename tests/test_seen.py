"""The memory of ids let through: equal to a walk over all deliveries, over segments, reruns and the retention."""

import random

import pytest
from pyspark.sql import functions as F

from auditweave.streaming import jobs, seen
from tests.event_rows import event, make_events

DAY = 86_400


def walk(batches, retain_days):
    """Deliveries let through, batch by batch: (id, arrival second) rows, one batch after the other."""
    taken, newest, out = [], None, []
    for rows in batches:
        from_day = None if newest is None else newest // DAY - retain_days
        known = {i for i, t in taken if from_day is None or t // DAY >= from_day}
        fresh = {}
        for i, t in sorted(rows, key=lambda r: r[1]):
            if i not in known and i not in fresh:
                fresh[i] = t
        taken += fresh.items()
        newest = max([t for _, t in rows] + ([] if newest is None else [newest]))
        out.append(sorted(fresh.items()))
    return out


def test_equal_to_a_walk(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(f"e{rng.randrange(60):03d}", rng.randrange(b * 2 * DAY, (b * 2 + 3) * DAY)) for _ in range(40)] for b in range(9)]
    out = str(tmp_path / "d")
    apply = seen.seen_batch(out, retain_days=5, segment_every=3)
    for b, rows in enumerate(batches):
        df = make_events(spark, [event(n, "s", t, event_id=i, ingested=t) for n, (i, t) in enumerate(rows)])
        apply(df, b)
        if b in (2, 5, 7):
            apply(df, b)  # run again after a failure
    wanted = walk(batches, 5)
    second = F.unix_timestamp("ingested_at") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    for b, rows in enumerate(wanted):
        got = spark.read.parquet(jobs.batch_dir(f"{out}/events", b)).select("event_id", second.alias("t")).collect()
        assert sorted((r[0], r[1]) for r in got) == rows, b
    assert len(jobs.written_batches(spark, f"{out}/marks")) == 3
    with pytest.raises(ValueError):
        apply(df, 4)


def test_only_named_buckets_are_read(spark, tmp_path):
    """Of ids never seen the filters let through next to none; of seen ones all."""
    out = str(tmp_path / "d")
    ids = spark.range(30_000).select(F.format_string("e%06d", "id").alias("event_id"), F.current_date().alias("day"))
    seen.write_segment(spark, out, ids, 0)
    blocks = spark.read.parquet(f"{out}/marks").first()["blocks"]
    assert blocks == 25
    others = spark.range(30_000).select(F.format_string("f%06d", "id").alias("event_id"))
    assert seen.ask_filters(spark, out, others, [(0, blocks)]).count() <= 10
    assert seen.ask_filters(spark, out, ids, [(0, blocks)]).count() == 30_000
    maybe = seen.ask_filters(spark, out, ids.limit(1).unionByName(ids.where("event_id = 'e012345'")), [(0, blocks)])
    hits = seen.stored_hits(spark, out, maybe, F.lit(None).cast("date"))
    assert 1 <= hits.count() <= 2
    scanned = [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert any("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scanned)


def test_rows_without_id_or_time(spark, tmp_path):
    out = str(tmp_path / "d")
    apply = seen.seen_batch(out, segment_every=2)
    row = lambda i, **none: make_events(spark, [event(1, "s", 5, event_id=i)]).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name in none else f.name for f in make_events(spark, []).schema])
    for b in range(4):
        unnamed = row("x", event_id=None)
        apply(unnamed.unionByName(unnamed).unionByName(row("t", ingested_at=None, timestamp=None)).unionByName(row("a")), b)
    counts = {r["event_id"]: r["count"] for r in spark.read.parquet(f"{out}/events").groupBy("event_id").count().collect()}
    assert counts == {None: 8, "t": 1, "a": 1}
    apply(make_events(spark, []), 4)
