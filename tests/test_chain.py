"""Append, verify, tamper, anchor and segment the audit chain."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditweave.operators import chain as H
from tests.event_rows import at

ROWS = "tenant string, timestamp timestamp, kind string, payload string, row_id string"


def rows(spark, n=10, tenants=("a", "b"), start=0):
    data = [(t, at(start + i + 0.25), "ingest", f'{{"i":{start + i}}}', f"r{start + i:05d}") for t in tenants for i in range(n)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, ROWS)


def serial(records):
    """Hashes of one tenant's ordered (timestamp text, payload) rows, computed one after the other."""
    prev, out = "", []
    for seq, (ts, payload) in enumerate(records):
        body = f'{{"sequence":{seq},"timestamp":"{ts}","kind":"ingest","payload":{payload},"prev_hash":"{prev}"}}'
        prev = hashlib.sha256(body.encode()).hexdigest()
        out.append(prev)
    return out


@pytest.fixture(scope="module")
def records(spark):
    return H.append_chain(rows(spark)).drop("row_id").cache()


def verdict(audit, *args):
    return {r["tenant"]: (r["valid"], r["first_bad"]) for r in H.verify_chain(audit, *args).collect()}


def test_hashes_equal_the_serial_chain(records):
    got = [r["hash"] for r in records.where("tenant = 'a'").orderBy("sequence").collect()]
    assert got == serial([(f"2024-01-01T00:00:{i:02d}.25Z", f'{{"i":{i}}}') for i in range(10)])


def test_intact_chain_verifies(records):
    assert verdict(records) == {"a": (True, None), "b": (True, None)}


def test_empty_chain_has_no_bad_records(records):
    assert H.bad_records(records.limit(0)).count() == 0


@pytest.mark.parametrize("change,bad", [
    (lambda r: r.withColumn("payload", F.when((F.col("sequence") == 2) & (F.col("tenant") == "a"), "{}").otherwise(F.col("payload"))), 2),
    (lambda r: r.withColumn("hash", F.when((F.col("sequence") == 1) & (F.col("tenant") == "a"), "00").otherwise(F.col("hash"))), 1),
    (lambda r: r.where("not (sequence = 2 and tenant = 'a')"), 3),
    (lambda r: r.where("not (sequence = 0 and tenant = 'a')"), 1),
    (lambda r: r.withColumn("kind", F.when((F.col("sequence") == 9) & (F.col("tenant") == "a"), "x").otherwise(F.col("kind"))), 9),
    (lambda r: r.unionByName(r.where("sequence = 4 and tenant = 'a'")), 4),
])
def test_tampering_is_found(records, change, bad):
    assert verdict(change(records)) == {"a": (False, bad), "b": (True, None)}


def test_recomputed_record_breaks_the_next_link(spark, records):
    """A record altered together with its own hash is caught at its successor."""
    from auditweave.functions.columns import record_hash
    hit = (F.col("sequence") == 4) & (F.col("tenant") == "b")
    forged = records.withColumn("payload", F.when(hit, "{}").otherwise(F.col("payload")))
    forged = forged.withColumn("hash", F.when(hit, record_hash(*[F.col(c) for c in ("sequence", "timestamp", "kind", "payload", "prev_hash")])).otherwise(F.col("hash")))
    assert verdict(forged) == {"a": (True, None), "b": (False, 5)}


def test_append_continues_from_heads(spark, records):
    more = H.append_chain(rows(spark, 5, ("b", "c"), start=10), H.chain_stats(records)).drop("row_id")
    both = records.unionByName(more)
    assert verdict(both) == {"a": (True, None), "b": (True, None), "c": (True, None)}
    assert {r["tenant"]: r["length"] for r in H.chain_stats(both).collect()} == {"a": 10, "b": 15, "c": 5}


def test_kind_is_required(spark):
    bad = spark.createDataFrame([("a", at(0), "", "{}", "r")], ROWS)
    assert H.check_rows(bad).first()["reason"] == "kind required"


def test_cut_tail_is_only_seen_by_anchors(records):
    anchors = H.anchor_heads(records, F.lit(at(100)))
    short = records.where("sequence < 8 or tenant = 'b'")
    assert verdict(short)["a"] == (True, None)
    assert {r["tenant"]: r["status"] for r in H.check_anchors(short, anchors).collect()} == {"a": "missing", "b": "present"}


def test_retention_keeps_a_verifiable_chain(records):
    kept, cut = H.audit_retention(records, F.lit(at(5 + 86400)), 1)
    assert {r["tenant"]: r["sequence"] for r in cut.collect()} == {"a": 4, "b": 4}
    assert {r["valid"] for r in H.verify_since(kept, cut).collect()} == {True}
    assert {r["valid"] for r in H.verify_chain(kept).collect()} == {False}


def test_retention_keeps_every_young_record(spark):
    data = [("a", at(86400 * 50 + i), "ingest", "{}", f"r{i}") for i in range(5)]
    log = H.append_chain(spark.createDataFrame(data, ROWS)).drop("row_id")
    late = H.append_chain(spark.createDataFrame([("a", at(0), "ingest", "{}", "late")], ROWS), H.chain_stats(log)).drop("row_id")
    both = log.unionByName(late)
    kept, cut = H.audit_retention(both, F.lit(at(86400 * 55)), 30)
    assert kept.count() == 6 and cut.count() == 0
    kept, cut = H.audit_retention(both, F.lit(at(86400 * 200)), 30)
    assert kept.count() == 0 and [r["sequence"] for r in cut.collect()] == [5]


def test_idle_tenants_stay_in_the_verdict(records):
    cp = records.where("sequence = 9").select("tenant", "sequence", "hash")
    got = {r["tenant"]: (r["valid"], r["length"], r["head_hash"]) for r in H.verify_since(records, cp).collect()}
    assert got == {r["tenant"]: (True, 0, r["hash"]) for r in cp.collect()}
    gone = {r["tenant"]: r["length"] for r in H.verify_since(records.where("tenant = 'b'"), cp.where("tenant = 'a'")).collect()}
    assert gone == {"a": 0, "b": 10}


def test_rows_without_a_kind_get_no_record(spark):
    data = [("a", at(i), kind, "{}", f"r{i}") for i, kind in enumerate(["x", "", None, "y"])]
    df = spark.createDataFrame(data, ROWS)
    assert [r["kind"] for r in H.append_chain(df).orderBy("sequence").collect()] == ["x", "y"]
    assert H.refused_rows(df).count() == 2 and verdict(H.append_chain(df)) == {"a": (True, None)}


def test_segments(spark):
    records, heads = H.segment_chain(rows(spark, 25), 10)
    records, heads = records.cache(), heads.cache()
    assert heads.count() == 6
    assert H.verify_segments(records, heads, 10).count() == 0
    changed = records.withColumn("payload", F.when((F.col("sequence") == 13) & (F.col("tenant") == "a"), "{}").otherwise(F.col("payload")))
    assert [(r["level"], r["at"]) for r in H.verify_segments(changed, heads, 10).collect()] == [("record", 13)]
    dropped = records.where("not (tenant = 'b' and segment = 1)")
    assert [(r["level"], r["at"]) for r in H.verify_segments(dropped, heads, 10).collect()] == [("segment", 1)]
    cut = heads.where("not (tenant = 'b' and sequence = 1)")
    assert ("head", 2) in [(r["level"], r["at"]) for r in H.verify_segments(records, cut, 10).collect()]


def test_hash_does_not_depend_on_the_session_zone(spark, records):
    want = verdict(records)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert verdict(records) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_without_tenant_or_time_are_refused_not_lost(spark):
    data = [(None, at(0), "note", "{}", "a"), ("t", None, "note", "{}", "b"), ("t", at(1), "note", None, None), ("", at(2), "note", "{}", "c"), ("t", at(1), None, "{}", "d")]
    df = spark.createDataFrame(data, ROWS)
    made = H.append_chain(df)
    assert {(r["row_id"], r["reason"]) for r in H.refused_rows(df).collect()} == {("a", "tenant required"), ("b", "timestamp required"), ("d", "kind required")}
    assert made.count() + H.refused_rows(df).count() == len(data) and verdict(made) == {"t": (True, None), "": (True, None)}
    empty = spark.createDataFrame([], H.SEGMENT_STATE)
    assert H.append_segments(df, empty, 2).count() == 2


def in_batches(spark, parts, segment_rows):
    """Records, heads and state after appending all parts."""
    state = spark.createDataFrame([], H.SEGMENT_STATE)
    records = heads = None
    for part in parts:
        new = H.append_segments(part, state, segment_rows)
        ends = H.segment_ends(new, state, segment_rows)
        closed = H.close_segments(ends)
        state = H.segment_state(ends, closed, state)
        new, closed, state = (spark.createDataFrame(df.collect(), df.schema) for df in (new, closed, state))
        records = new if records is None else records.unionByName(new)
        heads = closed if heads is None else heads.unionByName(closed)
    return records, heads, state


@pytest.mark.parametrize("sizes", [[23], [1, 1, 5, 9, 7], [4, 4, 4, 4, 4, 3], [11, 12]])
def test_segments_in_batches_equal_one_bulk_load(spark, sizes):
    whole, at_ = rows(spark, 23), 0
    parts = []
    for n in sizes:
        parts.append(whole.where(F.substring("row_id", 2, 5).cast("int").between(at_, at_ + n - 1)))
        at_ += n
    records, heads, state = in_batches(spark, parts, 4)
    want, want_heads = H.segment_chain(whole, 4)
    key = lambda df: sorted((r["tenant"], r["sequence"], r["prev_hash"], r["hash"]) for r in df.collect())
    assert key(records) == key(want)
    # The bulk load gives its last, open segment a head too.
    assert key(heads) == [r for r in key(want_heads) if r[1] < 5]
    assert sorted((r["tenant"], r["next_sequence"], r["open_time"]) for r in state.collect()) == [(t, 23, at(22.25).replace(tzinfo=None)) for t in "ab"]
    assert H.verify_segments(records, heads, 4).count() == 0
    empty = spark.createDataFrame([], "tenant string, sequence long, hash string")
    assert {(r["tenant"], r["valid"], r["length"]) for r in H.verify_since(records, empty, 4).collect()} == {("a", True, 23), ("b", True, 23)}


def test_tampering_with_segments_is_found(spark):
    records, heads, _ = in_batches(spark, [rows(spark, 10), rows(spark, 13, start=10)], 4)
    first = records.where("sequence <= 9").groupBy("tenant").agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"))
    assert {(r["tenant"], r["valid"], r["length"]) for r in H.verify_since(records, first, 4).collect()} == {("a", True, 13), ("b", True, 13)}
    changed = records.withColumn("payload", F.when((F.col("tenant") == "a") & (F.col("sequence") == 13), "{}").otherwise(F.col("payload")))
    assert {(r["tenant"], r["valid"], r["first_bad"]) for r in H.verify_since(changed, first, 4).collect()} == {("a", False, 13), ("b", True, None)}
    # A whole segment cut out leaves its head, and a head cut out leaves its segment.
    gone = H.verify_segments(records.where("not (tenant = 'a' and segment = 2)"), heads, 4).collect()
    assert {(r["tenant"], r["level"], r["at"]) for r in gone} == {("a", "segment", 2)}
    gone = H.verify_segments(records, heads.where("not (tenant = 'b' and sequence = 1)"), 4).collect()
    assert {(r["tenant"], r["level"], r["at"]) for r in gone} == {("b", "segment", 1), ("b", "head", 2)}


def test_sort_before_the_fold_holds_neither_bodies_nor_heads(spark):
    new = spark.createDataFrame([("t", at(i), "k", "{}", f"r{i:02d}") for i in range(40)], ROWS)
    heads = spark.createDataFrame([("t", 7, "f" * 64)], "tenant string, next_sequence long, head_hash string")
    assert [r["_head"] for r in H.assign_sequence(new, heads).orderBy("sequence").collect()] == ["f" * 64] + [None] * 39
    for out in (H.append_chain(new, heads), H.append_segments(new, spark.createDataFrame([("t", 7, "f" * 64, None, "")], H.SEGMENT_STATE), 16)):
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        sort = next(i for i, x in enumerate(plan) if "Sort [_chain" in x)
        assert any("_body" in x for x in plan[:sort]) and not any("_body" in x for x in plan[sort:])
        records = out.orderBy("sequence").collect()
        assert records[0]["prev_hash"] == "f" * 64 and [r["sequence"] for r in records] == list(range(7, 47))
    chained = H.append_chain(new, heads).orderBy("sequence").collect()
    assert [r["prev_hash"] for r in chained[1:]] == [r["hash"] for r in chained[:-1]]
