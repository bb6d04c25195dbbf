"""Streaming jobs over several batches, and reruns of a batch."""

import json
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.operators import alerts as A
from auditweave.operators import chain as H
from auditweave.operators import curate as C
from auditweave.operators import precedents as P
from auditweave.plans.streams import landed
from auditweave.sources import sinks
from auditweave.streaming import jobs
from tests.event_rows import at, event, ids, make_events


def test_curate_suppresses_what_was_shown(spark, tmp_path):
    out = str(tmp_path / "d")
    apply = jobs.curate_batch(out, strategy=C.LATEST, k=3)
    ev = make_events(spark, [event(i, f"s{i}", i) for i in range(6)])
    apply(ev, 0)
    apply(ev, 1)  # the same events delivered again
    apply(ev.limit(0), 2)
    d = {r["batch_id"]: r for r in spark.read.parquet(f"{out}/digests").collect()}
    assert [e["event_id"] for e in d[0]["selected_events"]] == ["e00005", "e00004", "e00003"]
    assert [e["event_id"] for e in d[1]["selected_events"]] == ["e00002", "e00001", "e00000"]
    assert (d[0]["redundancy"], d[1]["redundancy"], sorted(d)) == (0.0, 0.5, [0, 1])


def digests_of(spark, out):
    rows = spark.read.parquet(f"{out}/digests").collect()
    return sorted((r["window_end"].second, sorted(e["event_id"] for e in r["selected_events"])) for r in rows)


def test_windows_spread_over_batches_are_selected_once(spark, tmp_path):
    out, options = str(tmp_path / "d"), dict(strategy=C.LATEST, k=2, window="10 seconds", delay_seconds=5)
    apply = jobs.curate_batch(out, **options)
    part = lambda *seconds: make_events(spark, [event(i, "s", i) for i in seconds])
    apply(part(0, 4, 7), 0)
    apply(part(9, 11, 14), 1)  # the first window is still open
    apply(part(12, 16), 2)  # closes it
    apply(part(12, 16), 2)  # and runs again
    assert digests_of(spark, out) == [(10, ["e00007", "e00009"])]
    apply(part(3, 18), 3)  # too late for the first window
    jobs.flush_windows(spark, part(0), out, **options)
    assert digests_of(spark, out) == [(10, ["e00007", "e00009"]), (20, ["e00016", "e00018"])]
    late = spark.read.parquet(f"{out}/late")
    assert [(r["event_id"], r["reason"]) for r in late.collect()] == [("e00003", "late")]


def test_many_windows_with_one_delivery_again(spark, tmp_path):
    """More ids than any count could hold stay suppressed while their time lasts."""
    out, options = str(tmp_path / "d"), dict(strategy=C.LATEST, k=3, window="2 seconds", delay_seconds=100)
    apply = jobs.curate_batch(out, suppress_seconds=1000, **options)
    ev = make_events(spark, [event(i, "s", i) for i in range(40)])
    apply(ev, 0)
    jobs.flush_windows(spark, ev, out, suppress_seconds=1000, **options)
    shown = jobs.read_changes(spark, f"{out}/shown", "event_id string, shown_at timestamp", 2)
    assert shown.count() == 40
    later = jobs.still_shown(shown, F.lit(int(at(20).timestamp() * 1e6)))
    assert later.count() == 22  # those of the window that ends at 20, and later


def serial_windows(batches, k, size, delay, suppress):
    """The windowed digest job as a plain loop; (event number, second) rows, the last batch closes all."""
    waiting, shown, newest, made = [], {}, None, []
    for b, rows in enumerate(batches):
        before, newest = newest, max([t for _, t in rows] + ([] if newest is None else [newest]), default=newest)
        end = lambda r: r[1] // size * size + size
        waiting += [r for r in rows if before is None or end(r) > before - delay]
        closed = [r for r in waiting if b == len(batches) - 1 or end(r) <= newest - delay]
        waiting = [r for r in waiting if r not in closed]
        hidden = {i for i, t in shown.items() if t >= before - suppress - delay}
        for w in sorted({end(r) for r in closed}):
            picked = sorted((r for r in closed if end(r) == w and r[0] not in hidden), key=lambda r: (-r[1], r[0]))[:k]
            made.append((w, sorted(f"e{i:05d}" for i, _ in picked)))
            shown |= {i: max(w, shown.get(i, w)) for i, _ in picked}
    return sorted(made)


@pytest.mark.parametrize("every", [1, 2, 100])
def test_state_as_changes_equals_a_serial_loop(spark, tmp_path, every):
    """Whatever the compaction, and with reruns; ids come back in later windows; rows without a time are kept apart."""
    rng = random.Random(11)
    out, options = str(tmp_path / "d"), dict(strategy=C.LATEST, k=3, window="10 seconds", delay_seconds=15, suppress_seconds=25)
    apply = jobs.curate_batch(out, compact_every=every, **options)
    batches = [[(b * 6 + i, b * 12 + i * 2) for i in range(6)] for b in range(6)]
    for b, old in ((2, 0), (3, 1), (4, 17), (5, 3)):
        batches[b].append((old, b * 12 + 5))
    for b, rows in enumerate(batches):
        part = make_events(spark, [event(i, "s", t) for i, t in rows])
        for _ in range(1 + (rng.random() < 0.5)):
            apply(part, b)
    jobs.flush_windows(spark, part, out, **options)
    got = spark.read.parquet(f"{out}/digests").select("window_end", "selected_events.event_id").collect()
    start = at(0).replace(tzinfo=None)
    assert sorted((int((r[0] - start).total_seconds()), sorted(r[1])) for r in got) == serial_windows([*batches, []], 3, 10, 15, 25)
    if every == 100:
        assert jobs.written_batches(spark, f"{out}/waiting/whole") == [6] and len(jobs.written_batches(spark, f"{out}/shown/added")) == 7
    untimed = make_events(spark, [event(90, "s", 0)]).withColumn("timestamp", F.lit(None).cast("timestamp"))
    jobs.curate_batch(str(tmp_path / "n"), **options)(untimed, 0)
    assert [(r["event_id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "n/late")).collect()] == [("e00090", "no time")]


def test_throttle_over_batches_equals_the_serial_walk(spark, tmp_path):
    """One rule with nearly all alerts over four batches, a batch that runs twice, and alerts without a key or time."""
    rng = random.Random(8)
    times = sorted(rng.sample(range(20_000), 600))
    rule = lambda i: "busy" if i % 20 else "calm"
    out = str(tmp_path / "t")
    apply = jobs.throttle_batch(out, 45, F.col("rule_id"), few=10, block_rows=16)
    alerts = lambda part: A.alerts_from_events(make_events(spark, [event(i, "s", t, "error") for i, t in part])).withColumn(
        "rule_id", F.when(F.substring(F.element_at("ref", F.lit("event_id")), 2, 5).cast("int") % 20 > 0, "busy").otherwise("calm"))
    for b in (0, 1, 1, 2, 3):
        part = alerts(list(enumerate(times))[b * 150:(b + 1) * 150])
        if b == 3:
            bare = alerts([(1000, 0), (1001, 0)]).withColumn("created_at", F.lit(None).cast("timestamp"))
            part = part.unionByName(bare).unionByName(alerts([(1002, 0)]).withColumn("rule_id", F.lit(None).cast("string")))
        apply(part, b)
    want, last = [], {}
    for i, t in enumerate(times):
        if t - last.get(rule(i), -100) >= 45:
            want.append((rule(i), t))
            last[rule(i)] = t
    kept = spark.read.schema(S.ALERT).parquet(f"{out}/alerts").select("rule_id", F.unix_micros("created_at").alias("us")).collect()
    zero = int(at(0).timestamp())
    whole = sorted((r["rule_id"], r["us"] // 1_000_000 - zero) for r in kept if r["rule_id"] and r["us"] is not None)
    assert whole == sorted(want) and len(kept) - len(whole) == 3
    assert spark.read.parquet(f"{out}/throttle/batch_id=3").count() <= 2


def test_rows_are_retried_until_they_are_dead(spark, tmp_path):
    """Counts survive a restart; a row that becomes valid leaves; the last failure lands once; columns of any name."""
    out, tries = str(tmp_path / "r"), []

    def check(rows, batch_id):
        tries.append(sorted(r["id"] for r in rows.collect()))
        return rows.withColumn("reason", F.when(F.coalesce(F.col("good_at"), F.lit(99)) > batch_id, "not yet"))

    part = lambda rows: spark.createDataFrame(rows, "id long, good_at long, outcome string, attempts string, row string")
    first = part([(1, 0, "x", None, ""), (2, 1, "x", "y", ""), (3, None, None, None, None), (3, None, None, None, None)])
    for b, rows in ((0, first), (1, part([(4, 3, "", "", "")])), (1, part([(4, 3, "", "", "")])), (2, part([])), (4, part([]))):
        jobs.retry_batch(out, check, 3)(rows, b)  # a new function each time, as after a restart
    assert tries == [[1, 2, 3, 3], [2, 3, 3, 4], [2, 3, 3, 4], [3, 3, 4], [4]]
    got = sorted((r["row"]["id"], r["row"]["outcome"], r["outcome"], r["attempts"]) for r in jobs.read_tried(spark, out).where("row.id <> 3").collect())
    assert got == [(1, "x", "accepted", 1), (2, "x", "accepted", 2), (4, "", "accepted", 3)]
    dead = jobs.read_tried(spark, out).where("row.id = 3").select("outcome", "attempts", "reason").collect()
    assert [tuple(r) for r in dead] == [("dead", 3, "not yet")] * 2


@pytest.mark.parametrize("every", [2, 50])
def test_stored_precedents_equal_the_whole_log(spark, tmp_path, every):
    """Actions before, with and long after their decision; two actions on one; a batch run twice and an empty one."""
    rng = random.Random(4)
    log = []
    for i in range(60):
        body = {"event_id": f"e{i}", "event_type": "Tick" if i % 2 else "tick", "source_id": f"s{rng.randrange(2)}", "severity": "warn",
                "tenant": "t", "guardrails_status": "pass" if i % 5 else "rejected_output", "response": {"classification": "c", "suggestion": "x"}}
        log.append(("t", 3 * i, at(i), "decision", json.dumps(body), "", f"d{i}"))
        for j in range(rng.randrange(3)):
            act = {"decision_id": f"d{i}", "action": "accept", "annotation": "", "operator_id": "o"}
            log.append(("t", 3 * i + j + 1, at(i), "operator_action", json.dumps(act), "", f"a{i}-{j}"))
    rng.shuffle(log)
    frame = lambda rows: spark.createDataFrame(rows, S.AUDIT)
    out = str(tmp_path / "p")
    apply = jobs.precedents_batch(out, 4, every)
    for b in (0, 1, 1, 2, 3, 4):
        apply(frame(log[b * 40:(b + 1) * 40] if b < 4 else log[160:]), b)
    listed = lambda lists: sorted((tuple(r[c] for c in lists.columns[:-1]), [tuple(p) for p in r["precedents"]]) for r in lists.collect())
    want = listed(P.newest_precedents(frame(log), 4))
    assert listed(jobs.read_precedents(spark, out, 4)) == want and len(want) == 2


def test_precedents_are_listed_without_another_grouping(spark):
    """The rows ranked are the rows listed; of each precedent only the fields asked for."""
    row = lambda i, source, type_: ("t", f"d{i}", i, f"e{i}", type_, source, "warn", "t", "c", "s", "accept", "", f"a{i}", i)
    pairs = spark.createDataFrame([row(i, f"s{i % 2}", "Tick" if i % 4 < 2 else "tick") for i in range(9)], P.STORED)
    lists = P.as_lists(pairs, 3)
    assert "Aggregate" not in lists._jdf.queryExecution().executedPlan().toString()
    ids = lambda df: sorted((r["source_id"], [p["event_id"] for p in r["precedents"]]) for r in df.collect())
    assert ids(lists) == [("s0", ["e8", "e6", "e4"]), ("s1", ["e7", "e5", "e3"])]
    few = P.as_lists(pairs, 3, ["event_id"])
    assert ids(few) == ids(lists) and few.schema["precedents"].dataType.elementType.fieldNames() == ["event_id"]


def test_rows_land_once_in_their_batches(spark, tmp_path):
    """Rows are computed once for all batches; one without rows still lands, rows without a batch never do."""
    computed = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def batch(i):
        computed.add(1)
        return {0: 0, 1: 2, 2: None}[i % 3]

    rows = spark.range(0, 12, 1, 3).withColumn("_batch", batch("id"))
    seen = []
    for ids in landed(spark, rows, str(tmp_path / "in"), 3):
        note = lambda df, b: seen.append((b, sorted(r["id"] for r in df.collect()), df.columns))
        jobs.run(ids, note, str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, [0, 3, 6, 9], ["id"]), (1, [], ["id"]), (2, [1, 4, 7, 10], ["id"])]
    assert computed.value == 12


def test_states_that_do_not_fit_are_refused(spark, tmp_path):
    out = str(tmp_path / "a")
    apply = jobs.audit_batch(out)
    rows = lambda b: sinks.ingest_audit_rows(make_events(spark, [event(b * 10 + i, "s", b * 10 + i, tenant="t") for i in range(3)]))
    with pytest.raises(ValueError, match="no state"):
        apply(rows(0), 1)
    for b in (0, 1, 3):  # a batch id may be missing: the newest head is taken up
        apply(rows(b), b)
    with pytest.raises(ValueError, match="already holds"):
        apply(rows(0), 0)
    chain = jobs.read_chain(spark, out)
    assert [(r["valid"], r["length"]) for r in H.verify_chain(chain).collect()] == [(True, 9)]
    assert sorted(r["sequence"] for r in chain.collect()) == list(range(9))


def test_a_fresh_checkpoint_over_an_existing_log_is_refused(spark, tmp_path):
    make_events(spark, [event(i, "s", i, tenant="t") for i in range(3)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: sinks.ingest_audit_rows(spark.readStream.schema(S.EVENT).parquet(str(tmp_path / "in")))
    out = str(tmp_path / "log")
    jobs.stream_audit(stream(), out, str(tmp_path / "cp")).awaitTermination()
    jobs.stream_audit(stream(), out, str(tmp_path / "cp")).awaitTermination()  # nothing new
    with pytest.raises(StreamingQueryException, match="belongs to another query"):
        jobs.stream_audit(stream(), out, str(tmp_path / "cp2")).awaitTermination()
    assert jobs.read_chain(spark, out).count() == 3


def test_rows_without_a_kind_are_refused_and_tenants_have_their_own_files(spark, tmp_path):
    out = str(tmp_path / "a")
    rows = [("t", at(0), "note", "{}", "a"), ("t", at(1), "", "{}", "b"), ("u", at(2), None, "{}", "c"), ("u", at(3), "note", "{}", "d")]
    jobs.audit_batch(out)(spark.createDataFrame(rows, "tenant string, timestamp timestamp, kind string, payload string, row_id string"), 0)
    assert sorted(r["row_id"] for r in spark.read.parquet(f"{out}/refused").collect()) == ["b", "c"]
    assert (tmp_path / "a/records/batch_id=0/tenant=t").is_dir()
    assert {(r["tenant"], r["valid"], r["length"]) for r in H.verify_chain(jobs.read_chain(spark, out)).collect()} == {("t", True, 1), ("u", True, 1)}


def test_audit_stream_continues_its_chain(spark, tmp_path):
    out = str(tmp_path / "a")
    apply = jobs.audit_batch(out)
    parts = [make_events(spark, [event(b * 10 + i, "s", b * 10 + i, tenant=f"t{i % 2}") for i in range(10)]) for b in range(3)]
    for b in (0, 1, 1, 2):  # batch 1 runs twice
        apply(sinks.ingest_audit_rows(parts[b]), b)
    chain = jobs.read_chain(spark, out)
    assert {(r["tenant"], r["valid"], r["length"]) for r in H.verify_chain(chain).collect()} == {("t0", True, 15), ("t1", True, 15)}


def test_segments_of_a_hot_tenant_spread_and_stay_valid(spark, tmp_path):
    """One tenant with nine tenths of the rows; a rerun, rows without a time, and a batch of another query."""
    out = str(tmp_path / "s")
    apply = jobs.segmented_audit_batch(out, segment_rows=8)
    part = lambda b: spark.createDataFrame(
        [("hot" if i % 10 else "cold", None if i == 5 else at(b * 100 + i), "note", "{}", f"{b}-{i}") for i in range(50)],
        "tenant string, timestamp timestamp, kind string, payload string, row_id string")
    for b in (0, 1, 1, 2):
        apply(part(b), b)
    records, heads = jobs.read_segments(spark, out)
    assert {(r["tenant"], r["n"]) for r in records.groupBy("tenant").agg(F.count("*").alias("n")).collect()} == {("hot", 135), ("cold", 15)}
    assert spark.read.parquet(f"{out}/broken").count() == 0 and H.verify_segments(records, heads, 8).count() == 0
    assert {(r["tenant"], r["valid"], r["length"]) for r in H.verify_chain(heads).collect()} == {("hot", True, 16), ("cold", True, 1)}
    # No task folds more than one segment of a tenant's chain together.
    assert records.groupBy("tenant", "segment").count().agg(F.max("count")).first()[0] == 8
    with pytest.raises(ValueError, match="already holds"):
        apply(part(0), 0)


def test_a_rerun_hashes_the_same_times(spark, tmp_path):
    inputs = spark.createDataFrame([("note", '{"tenant":"t"}'), ("note", "{}")], "kind string, payload string")
    out = str(tmp_path / "a")
    hashes = []
    for _ in range(2):
        jobs.audit_batch(out)(jobs.audit_inputs(inputs), 0)
        hashes.append(sorted(r["hash"] for r in jobs.read_chain(spark, out).collect()))
    assert hashes[0] == hashes[1] and len(hashes[0]) == 2


@pytest.mark.parametrize("job", ["fan_out", "decide"])
def test_a_foreign_query_overwrites_nothing(spark, tmp_path, job):
    out = str(tmp_path / "o")
    make_events(spark, [event(0, "s", 0)]).write.parquet(f"{out}/events/batch_id=0")
    make_events(spark, [event(0, "s", 0)]).write.parquet(f"{out}/made/batch_id=0")
    spark.createDataFrame([("another",)], "id string").write.text(f"{out}/owner")
    spark.range(1).select(F.lit("x").alias("value")).write.text(str(tmp_path / "in"))
    lines = spark.readStream.text(str(tmp_path / "in"))
    apply = jobs.fan_out_batch(out) if job == "fan_out" else jobs.decide_batch(out, "x", None)
    with pytest.raises(StreamingQueryException, match="belongs to another query"):
        jobs.run(lines, apply, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/events/batch_id=0").count() == spark.read.parquet(f"{out}/made/batch_id=0").count() == 1


def test_throttle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [event(i, f"s{rng.randrange(3)}", t, "error") for i, t in enumerate(sorted(rng.uniform(0, 900) for _ in range(200)))]
    for b in range(4):  # four files, one batch each, in time order
        make_events(spark, rows[b * 50:(b + 1) * 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: F.element_at("ref", F.lit("source_id"))
    stream = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (jobs.throttle_stream(A.alerts_from_events(stream), 45, key=source()).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["key"], r["us"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = A.throttle_alerts(A.alerts_from_events(make_events(spark, rows)), 45, source())
    assert got == sorted((r[0], r[1]) for r in batch.select(source(), F.unix_micros("created_at")).collect())


def test_late_rows_go_to_their_own_output(spark, tmp_path):
    out = str(tmp_path / "l")
    apply = jobs.late_split_batch(out, 30)
    apply(make_events(spark, [event(1, "s", 100)]), 0)
    apply(make_events(spark, [event(2, "s", 69), event(3, "s", 70), event(4, "s", 500)]), 1)
    assert sorted(ids(spark.read.parquet(f"{out}/events"))) == ["e00001", "e00003", "e00004"]
    assert ids(spark.read.parquet(f"{out}/late")) == ["e00002"]


def test_dedup_stream_over_batches(spark, tmp_path):
    for b in range(2):
        make_events(spark, [event(i, "s", i) for i in range(b, b + 3)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (jobs.dedup_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(ids(spark.read.parquet(str(tmp_path / "out")))) == ["e00000", "e00001", "e00002", "e00003"]


def platform_alerts(spark, out):
    return sorted((r["batch_id"], r["rule_id"], r["body"]) for r in spark.read.parquet(f"{out}/alerts").collect())


def test_platform_watches_its_audit_log(spark, tmp_path, monkeypatch):
    """Event alerts are throttled over batches; a chain whose records are altered raises one alert."""
    out = str(tmp_path / "p")
    apply = jobs.platform_batch(out, strategy=C.LATEST, k=2, seconds=60)
    messages = lambda b: sinks.event_messages(make_events(spark, [
        event(b, "s", b * 20, "error", tenant="t", event_id=f"e{b}"), event(7, "s", b * 20 + 1, "error", tenant="u", event_id="same")]))
    apply(messages(0), 0)
    apply(messages(0), 0)  # a rerun
    append = H.append_chain
    forged = lambda rows, heads=None: append(rows, heads).withColumn("payload", F.when(F.col("tenant") == "t", "{}").otherwise(F.col("payload")))
    monkeypatch.setattr(jobs.chain, "append_chain", forged)
    apply(messages(1), 1)
    apply(messages(2), 2)
    monkeypatch.undo()
    got = platform_alerts(spark, out)
    assert [(b, body) for b, rule, body in got if rule == "platform.audit_chain_invalid"] == [(1, "t: first bad sequence 2")]
    events_ = [(b, body.split()[0]) for b, rule, body in got if rule == "ingest.severity_warn_or_above"]
    assert events_ == [(0, "event_id=e0"), (0, "event_id=same"), (1, "event_id=e1"), (2, "event_id=e2")]
    chain = jobs.read_chain(spark, f"{out}/audit")
    assert {r["tenant"]: (r["valid"], r["length"]) for r in H.verify_chain(chain).collect()} == {"t": (False, 6), "u": (True, 6)}
    live = spark.read.parquet(f"{out}/live").groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in live} == {"event": 6, "digest": 6, "alert": len(got)}


def test_a_silent_stream_reports_its_sources(spark, tmp_path):
    """Stalled though no event moves any watermark; alive again, with its count, after the next event."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *rows: make_events(spark, [event(i, s, i) for i, s in rows]).coalesce(1).write.mode("append").parquet(source)
    put((0, "a"), (1, "a"), (2, "b"), (3, None))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS_DB)
    q = (jobs.watch_sources(spark.readStream.schema(S.EVENT).parquet(source), 3).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

    def wait_for(n):
        end = time.time() + 120
        while time.time() < end and q.isActive:
            if q.lastProgress is not None:
                rows = sorted((str(r["source_id"]), r["status"], r["events"]) for r in spark.read.schema(jobs.LIVENESS).parquet(out).collect())
                if len(rows) >= n:
                    return rows
            q.awaitTermination(1)
        raise AssertionError(q.exception())

    first = [("None", "alive", 1), ("None", "stalled", 1), ("a", "alive", 2), ("a", "stalled", 2), ("b", "alive", 1), ("b", "stalled", 1)]
    try:
        assert wait_for(6) == first
        put((9, "a"))
        assert wait_for(8) == sorted([*first, ("a", "alive", 3), ("a", "stalled", 3)])
    finally:
        q.stop()


def test_folded_records_are_written_without_a_second_sort(spark, tmp_path, monkeypatch):
    """Also with more tenants in a task than files are open at once; the setting holds for this write only."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    rows = spark.range(600).selectExpr(
        "concat('t', id % 9) AS tenant", "timestamp_seconds(id) AS timestamp", "'k' AS kind", "'{}' AS payload", "format_string('r%03d', id) AS row_id")
    seen, write = [], jobs.write_batch
    monkeypatch.setattr(jobs, "write_batch", lambda df, path, *more: (seen.append((path, df.sparkSession.conf.get(name))), write(df, path, *more)))
    before = spark.conf.get(name)
    jobs.audit_batch(str(tmp_path))(rows, 0)
    assert [(p, n) for p, n in seen if n != before] == [(f"{tmp_path}/records", str(jobs.OPEN_FILES))] and spark.conf.get(name) == before
    records = jobs.read_chain(spark, str(tmp_path))
    assert records.count() == 600
    assert all(r["valid"] and r["length"] in (66, 67) for r in H.verify_chain(records).collect())
