"""Streaming jobs run to the end over the event file; results equal the batch operators."""

from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import micros
from auditweave.operators import alerts as A
from auditweave.operators import chain as H
from auditweave.operators import curate as C
from auditweave.operators import decide as D
from auditweave.operators import precedents
from auditweave.operators import validate as V
from auditweave.plans.auditing import CHAIN, NUMBERED, SEGMENT, SEGMENTS, greedy_sql, level
from auditweave.plans.base import EVENT_COLUMNS, map_events, query, rfc_sql, table, us, with_ev
from auditweave.plans.curation import fill_sql, latest_sql, seeds_sql, top_sql
from auditweave.plans.decisions import ACTS, CTX, DEC, RESOLVED, TOP5, stored_log
from auditweave.plans.ingest import BAD_EV, REASON, daily_digests, faulty_events, raw_messages
from auditweave.session import shared_folder
from auditweave.sources import sinks
from auditweave.sources.events import read_audit_inputs, read_decisions, read_digests, read_messages
from auditweave.streaming import jobs, seen


def event_stream(spark, sf):
    """The event file as a stream."""
    raw = (
        spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    return map_events(raw)


def landed(spark, rows, out, n, kind="parquet"):
    """``rows`` as a stream of ``n`` batches: for each the files of its rows (``_batch``) land, then the stream is given.

    Every run of the same query over it (until the input is drained) takes the files that are new as one batch. Rows are
    computed and written once, a folder per batch, which lands by being moved. A batch without rows is an empty file.
    """
    given, staged = rows.drop("_batch"), f"{out}-staged"
    with jobs.open_files(spark, n + 1):  # with as many open as may be, Spark begins to sort
        rows.write.partitionBy("_batch").format(kind).save(staged)
    for i in range(n):
        if not jobs.move_folder(spark, f"{staged}/_batch={i}", f"{out}/{i}"):
            given.limit(0).write.format(kind).save(f"{out}/{i}")
        yield spark.readStream.format(kind).schema(given.schema).option("recursiveFileLookup", True).load(out)


def batched_stream(spark, sf, out, batch, n):
    """The mapped events as a stream of ``n`` batches (``landed``); ``batch`` is the number of each row's batch."""
    return landed(spark, map_events(table(spark, sf, "events")).withColumn("_batch", batch), out, n)


def slices(column, n):
    """Number of the row's slice of January 2024 in ``n`` equal slices of time, whatever the days' borders."""
    slice_ = F.floor((micros(F.col(column)) - 1704067200000000) * n / (31 * 86_400_000_000)).cast("int")
    return F.greatest(F.lit(0), F.least(slice_, F.lit(n - 1)))


def finish(q):
    q.awaitTermination()


@query("stream_curate", with_ev(latest_sql(), seeds_sql(20, 80), fill_sql(20), "SELECT day, event_id, us, 1::BIGINT AS digests FROM picked"))
def _(spark, sf):
    """Batches that end within days: every day still gets one digest over all its events."""
    out = shared_folder(spark, "curate")
    options = dict(strategy=C.MIN_DIVERSITY, k=20, diversity=80, window="1 day", compact_every=3)
    for ev in batched_stream(spark, sf, f"{out}/in", slices("timestamp", 4), 4):
        finish(jobs.stream_curate(ev.select(*EVENT_COLUMNS), f"{out}/data", f"{out}/checkpoint", **options))
    jobs.flush_windows(spark, map_events(table(spark, sf, "events")).select(*EVENT_COLUMNS), f"{out}/data", **options)
    digests = spark.read.parquet(f"{out}/data/digests")
    once = digests.groupBy("window_end").agg(F.count(F.lit(1)).alias("digests"))
    rows = digests.select("window_end", F.inline("selected_events")).join(once, "window_end")
    day = F.date_sub(F.to_date("window_end"), 1).cast("string").alias("day")
    return rows.select(day, "event_id", us("timestamp"), "digests")


@query("stream_dedup", with_ev("SELECT event_id, us FROM ev"))
def _(spark, sf):
    """Every event delivered twice within the watermark comes out once."""
    out = shared_folder(spark, "dedup")
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    q = (
        jobs.dedup_stream(twice).select("event_id", us("timestamp")).writeStream.format("parquet")
        .option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    finish(q)
    return spark.read.parquet(f"{out}/data")


AGAIN = """part AS (SELECT *, greatest(0, least(3, CAST(floor((us - 1704067200000000) * 4 / (31 * 86400000000.0)) AS INTEGER))) AS b FROM ev),
    edge AS (SELECT CAST(make_timestamp(max(ingested_us)) AS DATE) - 10 AS from_day FROM part WHERE b < 3)"""


@query("stream_first_deliveries", with_ev(AGAIN, """SELECT event_id,
    CASE WHEN b < 3 AND CAST(make_timestamp(ingested_us) AS DATE) < from_day THEN 2 ELSE 1 END AS deliveries FROM part, edge"""))
def _(spark, sf):
    """Four batches of a week each; the last also delivers every event again. Those of the ten days before are known."""
    out = shared_folder(spark, "first")
    rows = map_events(table(spark, sf, "events")).withColumn("_batch", slices("timestamp", 4))
    rows = rows.unionByName(rows.withColumn("_batch", F.lit(3)))
    for ev in landed(spark, rows, f"{out}/in", 4):
        finish(seen.stream_first_deliveries(ev.select(*EVENT_COLUMNS), f"{out}/data", f"{out}/checkpoint", retain_days=10, segment_every=2))
    let_through = spark.read.schema("event_id string").parquet(f"{out}/data/events")
    return let_through.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("deliveries"))


@query("stream_alerts", with_ev(
    "a AS MATERIALIZED (SELECT source_id AS key, ingested_us AS us FROM ev WHERE severity <> 'info')",
    greedy_sql(172_800_000_000), "SELECT key, us FROM kept", recursive=True))
def _(spark, sf):
    """Event alerts throttled per source with state."""
    out = shared_folder(spark, "alerts")
    source = F.element_at("ref", F.lit("source_id"))
    kept = jobs.throttle_stream(A.alerts_from_events(event_stream(spark, sf)), 172800, key=source)
    q = (
        kept.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    finish(q)
    return spark.read.parquet(f"{out}/data").select("key", "us")


@query("stream_alerts_busy_rule", with_ev(
    "a AS MATERIALIZED (SELECT 'ingest.severity_warn_or_above' AS key, ingested_us AS us FROM ev WHERE severity <> 'info')",
    greedy_sql(3_600_000_000), "SELECT key AS rule_id, us FROM kept", recursive=True))
def _(spark, sf):
    """One rule holds every alert of four batches: blocks within a batch, its last kept time between batches."""
    out = shared_folder(spark, "busy")
    for ev in batched_stream(spark, sf, f"{out}/in", slices("ingested_at", 4), 4):
        finish(jobs.stream_throttled(A.alerts_from_events(ev), f"{out}/data", f"{out}/checkpoint", seconds=3600, key=F.col("rule_id"),
                                     few=100, block_rows=64))
    return spark.read.schema(S.ALERT).parquet(f"{out}/data/alerts").select("rule_id", us("created_at"))


TRIES = """tried AS (SELECT event_id, greatest(0, least(3, CAST(floor((us - 1704067200000000) * 4 / (31 * 86400000000.0)) AS INTEGER))) AS b,
    CAST(substr(source_id, 6) AS BIGINT) % 6 AS known FROM ev)"""


@query("stream_retry", with_ev(TRIES, """SELECT event_id, CASE WHEN known <= least(b + 1, 3) THEN 'accepted' WHEN b < 3 THEN 'dead' ELSE 'retry' END AS outcome,
    CASE WHEN known <= b OR b = 3 THEN 1 ELSE 2 END AS attempts FROM tried"""))
def _(spark, sf):
    """Events of sources that get known batch by batch, each event tried with at most two batches."""
    out = shared_folder(spark, "retry")
    sources = map_events(table(spark, sf, "events")).select("source_id").distinct()
    sources.withColumn("known", F.substring("source_id", 6, 20).cast("long") % 6).write.parquet(f"{out}/sources")

    def check(rows, batch_id):
        known = spark.read.parquet(f"{out}/sources").where(F.col("known") <= batch_id)
        return rows.join(known, "source_id", "left").withColumn("reason", F.when(F.col("known").isNull(), "unknown source")).drop("known")

    for ev in batched_stream(spark, sf, f"{out}/in", slices("timestamp", 4), 4):
        finish(jobs.stream_retry(ev.select(*EVENT_COLUMNS), f"{out}/data", f"{out}/checkpoint", check=check, attempts=2))
    return jobs.read_tried(spark, f"{out}/data").select("row.event_id", "outcome", "attempts")


@query("stream_precedents", with_ev(DEC, ACTS, RESOLVED, TOP5, """SELECT e.event_id, t.precedent_rank, t.decision_hash, t.operator_action
    FROM ev e JOIN top5 t ON e.event_type = t.event_type AND e.source_id = t.source_id AND e.severity = t.severity AND e.tenant = t.tenant"""))
def _(spark, sf):
    """Decisions and actions in four batches in no order: each finds its partner of an earlier batch; lists are kept up."""
    out = shared_folder(spark, "precedents")
    log = stored_log(spark, sf, write=False).withColumn("_batch", F.pmod(F.xxhash64("hash"), F.lit(4)))
    for audit in landed(spark, log, f"{out}/in", 4):
        finish(jobs.stream_precedents(audit, f"{out}/data", f"{out}/checkpoint", compact_every=3))
    ev = map_events(table(spark, sf, "events"))
    lists = jobs.read_precedents(spark, f"{out}/data", fields=["decision_hash", "operator_action"])
    rows = precedents.listed_rows(ev, lists)
    return rows.select("event_id", "precedent_rank", "precedent.decision_hash", "precedent.operator_action")


@query("stream_audit", with_ev(NUMBERED, CHAIN, "SELECT tenant, sequence, prev_hash, hash FROM chain", recursive=True))
def _(spark, sf):
    """Four batches in the order of time make the same chains as one."""
    out = shared_folder(spark, "audit")
    for ev in batched_stream(spark, sf, f"{out}/in", slices("ingested_at", 4), 4):
        finish(jobs.stream_audit(sinks.ingest_audit_rows(ev), f"{out}/data", f"{out}/checkpoint"))
    return jobs.read_chain(spark, f"{out}/data").select("tenant", "sequence", "prev_hash", "hash")


@query("stream_audit_segmented", with_ev(NUMBERED, *SEGMENTS, f"""SELECT 'record' AS level, tenant, sequence, prev_hash, hash FROM seg
    UNION ALL SELECT 'head', tenant, sequence, prev_hash, hash FROM heads WHERE n = {SEGMENT}""", recursive=True))
def _(spark, sf):
    """Segments that open in one batch and fill in a later one; what the two ways of verifying find broken would be added."""
    out = shared_folder(spark, "segments")
    for ev in batched_stream(spark, sf, f"{out}/in", slices("ingested_at", 4), 4):
        finish(jobs.stream_audit_segmented(sinks.ingest_audit_rows(ev), f"{out}/data", f"{out}/checkpoint", segment_rows=SEGMENT))
    records, heads = jobs.read_segments(spark, f"{out}/data")
    broken = spark.read.parquet(f"{out}/data/broken").select("tenant", "sequence").unionByName(
        H.verify_segments(records, heads, SEGMENT).select("tenant", F.col("at").alias("sequence")))
    none = F.lit(None).cast("string")
    return level("record", records).unionByName(level("head", heads)).unionByName(
        level("broken", broken.withColumn("prev_hash", none).withColumn("hash", none)))


@query("stream_audit_verified", with_ev("""SELECT CASE WHEN event_type = 'view' THEN 'default' ELSE tenant END AS tenant, TRUE AS valid,
    CAST(NULL AS BIGINT) AS first_bad, count(*) AS length FROM ev GROUP BY 1"""))
def _(spark, sf):
    """Audit input messages (kind and payload) landed as text files, appended by the stream, then verified."""
    out = shared_folder(spark, "inputs")
    ev = map_events(table(spark, sf, "events"))
    tenant = F.when(F.col("event_type") != "view", F.col("tenant"))
    body = F.to_json(F.struct(F.lit("note").alias("kind"), F.struct("event_id", tenant.alias("tenant")).alias("payload")))
    ev.select(body.alias("value")).write.text(f"{out}/in")
    inputs = read_audit_inputs(read_messages(spark, "text", stream=True, path=f"{out}/in"))
    finish(jobs.stream_audit(jobs.audit_inputs(inputs), f"{out}/data", f"{out}/checkpoint"))
    return H.verify_chain(jobs.read_chain(spark, f"{out}/data")).drop("head_hash")


@query("stream_decide", with_ev(top_sql(20), f"""SELECT event_id, CASE WHEN severity = 'critical' THEN 'rejected_output' ELSE 'pass' END AS guardrails,
    sha256({CTX} || chr(0) || 'Classify.') AS prompt_hash, TRUE AS chained FROM picked"""))
def _(spark, sf):
    """Digests landed as messages, decided by the stream, decisions read back from its messages."""
    out = shared_folder(spark, "decide")
    sinks.write_messages(sinks.digest_messages(daily_digests(spark, sf)).select("value"), "text", f"{out}/in")
    digests = read_digests(read_messages(spark, "text", stream=True, path=f"{out}/in"))
    conf = F.when(F.col("severity") == "critical", 0.4).otherwise(0.9)
    provider = D.ColumnProvider("expr", "expr-1", D.response(F.col("severity"), "act", conf, F.lit(False)))
    finish(jobs.stream_decide(digests, f"{out}/data", f"{out}/checkpoint", "Classify.", provider))
    made = read_decisions(spark.read.schema("key string, value string").parquet(f"{out}/data/decisions"))
    return made.select("event_id", "guardrails", "prompt_hash", (F.length("audit_chain_hash") == 64).alias("chained"))


@query("stream_fan_out", with_ev(BAD_EV, f"""SELECT output, count(*) AS n FROM (
    SELECT unnest(CASE WHEN f <> 8 AND ({REASON}) IS NULL THEN CASE WHEN severity = 'info' THEN ['events', 'audit', 'live'] ELSE ['events', 'audit', 'live', 'live', 'alerts'] END
                       ELSE ['rejects'] END) AS output FROM bad) GROUP BY output"""))
def _(spark, sf):
    """Raw messages, some broken, landed as text and fanned out to events, rejects, audit, alerts and live feed."""
    out = shared_folder(spark, "fanout")
    raw_messages(spark, sf).write.text(f"{out}/in")
    finish(jobs.fan_out(read_messages(spark, "text", stream=True, path=f"{out}/in"), f"{out}/data", f"{out}/checkpoint"))
    one = lambda name, path: spark.read.parquet(f"{out}/data/{path}").select(F.lit(name).alias("output"))
    rows = one("events", "events")
    for name, path in (("rejects", "rejects"), ("audit", "audit/records"), ("alerts", "alerts"), ("live", "live")):
        rows = rows.unionByName(one(name, path))
    return rows.groupBy("output").agg(F.count(F.lit(1)).alias("n"))


PLATFORM = f"""sl AS (SELECT *, greatest(0, least(2, CAST(floor((us - 1704067200000000) * 3 / (31 * 86400000000.0)) AS INTEGER))) AS b FROM ev),
  pr AS (SELECT tenant, b, ingested_us AS at_us, '0:ingest:' || event_id AS row_id, 'ingest' AS kind,
      '{{"event_id":"' || event_id || '","source_id":"' || source_id || '"}}' AS payload FROM sl
    UNION ALL SELECT tenant, b, max(ingested_us), '1:digest_selection:{{"tenant":"' || tenant || '"}}', 'digest_selection',
      '{{"diversity":80.0,"k":30,"selected_n":' || least(30, count(*)) || ',"strategy":1}}' FROM sl GROUP BY tenant, b),
  pnum AS MATERIALIZED (SELECT *, '{{"sequence":' || sequence || ',"timestamp":"' || {rfc_sql('at_us')} || '","kind":"' || kind || '","payload":' || payload || ',"prev_hash":"' AS pre
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY b, at_us, row_id) - 1 AS sequence FROM pr)),
  pchain AS (SELECT tenant, sequence, kind, sha256(pre || '"}}') AS hash FROM pnum WHERE sequence = 0
    UNION ALL SELECT n.tenant, n.sequence, n.kind, sha256(n.pre || c.hash || '"}}') FROM pchain c JOIN pnum n ON n.tenant = c.tenant AND n.sequence = c.sequence + 1)"""


def platform(spark, sf, **options):
    """The whole stream over three batches of messages; returns its folder."""
    out = shared_folder(spark, "platform")
    ev = map_events(table(spark, sf, "events"))
    for i in range(3):
        sinks.event_messages(ev.where(slices("timestamp", 3) == i)).select("value").write.mode("append").text(f"{out}/in")
        messages = read_messages(spark, "text", stream=True, path=f"{out}/in")
        finish(jobs.run_platform(messages, f"{out}/data", f"{out}/checkpoint", strategy=C.LATEST, k=30, **options))
    return f"{out}/data"


@query("stream_platform", with_ev(PLATFORM, "SELECT tenant, sequence, kind, hash FROM pchain", recursive=True))
def _(spark, sf):
    """Ingest to export: events and digests of all batches in one chain per tenant, exported and read back."""
    out = platform(spark, sf)
    records = jobs.read_chain(spark, f"{out}/audit")
    sinks.export_audit_bundle(records, H.verify_chain(records), f"{out}/bundle")
    exported = spark.read.schema("tenant string, sequence long, kind string, hash string").json(f"{out}/bundle/records")
    broken = spark.read.schema("tenant string, audit_verified boolean").json(f"{out}/bundle/manifest").where("NOT audit_verified")
    return exported.join(broken, "tenant", "left_anti").select("tenant", "sequence", "kind", "hash")


@query("stream_platform_live", with_ev("""sl AS (SELECT *, greatest(0, least(2, CAST(floor((us - 1704067200000000) * 3 / (31 * 86400000000.0)) AS INTEGER))) AS b FROM ev),
  pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant, b ORDER BY us DESC, event_id) AS r FROM sl) WHERE r <= 30)""",
    """SELECT 'event' AS type, event_id AS key FROM ev UNION ALL SELECT 'decision', event_id FROM pk
    UNION ALL SELECT 'digest', tenant || ' ' || string_agg(event_id, ',' ORDER BY us DESC, event_id) FROM pk GROUP BY tenant, b
    UNION ALL SELECT 'alert', event_id FROM ev WHERE severity <> 'info'"""))
def _(spark, sf):
    """Live messages of the stream, told apart by their content; alerts of events are throttled per event."""
    provider = D.ColumnProvider("expr", "expr-1", D.response(F.col("severity"), "act", 0.9, F.lit(False)))
    live = spark.read.parquet(f"{platform(spark, sf, instruction='Classify.', provider=provider)}/live")
    member = lambda path: F.get_json_object("data", path)
    ids = F.array_join(F.transform(F.from_json(member("$.selected_events"), "array<struct<event_id: string>>"), lambda e: e["event_id"]), ",")
    key = (
        F.when(F.col("type") == "digest", F.concat(member("$.tenant"), F.lit(" "), ids))
        .when(F.col("type") == "alert", member("$.ref.event_id")).otherwise(member("$.event_id"))
    )
    rules = F.col("type") != "alert"
    return live.where(rules | (member("$.rule_id") == "ingest.severity_warn_or_above")).select("type", key.alias("key"))


@query("source_liveness", with_ev("""last AS (SELECT source_id, max(us) AS last_us, count(*) AS events FROM ev GROUP BY source_id)""",
    """SELECT source_id, 'alive' AS status, last_us, events FROM last
    UNION ALL SELECT source_id, 'stalled', last_us, events FROM last WHERE last_us // 1000 + 43200000 <= ((SELECT max(us) FROM ev) - 30000000) // 1000"""))
def _(spark, sf):
    """Sources silent for more than half a day of event time at the end of the stream are reported once."""
    out = shared_folder(spark, "liveness")
    q = (
        jobs.source_liveness(event_stream(spark, sf), 43200).writeStream.format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    finish(q)
    return spark.read.parquet(f"{out}/data").select("source_id", "status", "last_us", "events")


@query("watch_sources", with_ev("last AS (SELECT source_id, max(us) AS last_us, count(*) AS events FROM ev GROUP BY source_id)",
    "SELECT source_id, unnest(['alive', 'stalled']) AS status, last_us, events FROM last"))
def _(spark, sf):
    """All events in one batch, then nothing: every source is alive, and stalled after two seconds by the clock."""
    out = shared_folder(spark, "watch")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS_DB)
    try:
        q = (jobs.watch_sources(event_stream(spark, sf), 2).writeStream.format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="1 second").start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    sources = table(spark, sf, "events").select("user_id").distinct().count()
    found = spark.read.schema(jobs.LIVENESS)
    while q.isActive and (q.lastProgress is None or found.parquet(f"{out}/data").where("status = 'stalled'").count() < sources):
        q.awaitTermination(1)
    if q.exception() is not None:
        raise q.exception()
    q.stop()
    return found.parquet(f"{out}/data")


@query("stream_late_split", with_ev("""SELECT event_id, CASE WHEN n % 7 = 0 AND us < (SELECT max(us) FROM ev WHERE n % 7 <> 0) - 30000000 THEN 'late'
    ELSE 'on time' END AS part FROM ev"""))
def _(spark, sf):
    """Two batches in the order of time, then one with every seventh event of the month."""
    out = shared_folder(spark, "late")
    batch = F.when(F.col("n") % 7 == 0, 2).otherwise(slices("timestamp", 2))
    for ev in batched_stream(spark, sf, f"{out}/in", batch, 3):
        finish(jobs.run(ev.select(*EVENT_COLUMNS), jobs.late_split_batch(f"{out}/data"), f"{out}/checkpoint"))
    part = lambda name, folder: spark.read.parquet(f"{out}/data/{folder}").select("event_id", F.lit(name).alias("part"))
    return part("on time", "events").unionByName(part("late", "late"))


@query("write_hot_events", with_ev("SELECT day, tenant, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1, 2"))
def _(spark, sf):
    """Events written as one-day partitions and scanned back."""
    out = shared_folder(spark, "hot")
    sinks.write_hot_events(map_events(table(spark, sf, "events")).select(*EVENT_COLUMNS), out)
    back = spark.read.parquet(out)
    return back.groupBy(F.col("event_date").cast("string").alias("day"), F.col("tenant_id").alias("tenant")).agg(
        F.count(F.lit(1)).alias("events"), F.min(micros(F.col("timestamp"))).alias("first_us"), F.max(micros(F.col("timestamp"))).alias("last_us"))


@query("export_audit_bundle", with_ev(NUMBERED, CHAIN, f"""SELECT '{S.EXPORT_SLICE}' AS slice, tenant, TRUE AS audit_verified, '' AS verify_err,
    arg_max(hash, sequence) AS chain_head_hash, count(*) AS records FROM chain GROUP BY tenant""", recursive=True))
def _(spark, sf):
    """Chain written per tenant, read back, verified and exported; the bundle is read again."""
    out = shared_folder(spark, "export")
    records = H.append_chain(sinks.ingest_audit_rows(map_events(table(spark, sf, "events")))).drop("row_id")
    sinks.write_audit(records, f"{out}/chain")
    stored = sinks.read_audit_table(spark, f"{out}/chain")
    sinks.export_audit_bundle(stored, H.verify_chain(stored), f"{out}/bundle")
    manifest = spark.read.schema("slice string, exported_at timestamp, tenant string, audit_verified boolean, verify_err string, chain_head_hash string").json(f"{out}/bundle/manifest")
    counts = spark.read.schema("tenant string, sequence long").json(f"{out}/bundle/records").groupBy("tenant").agg(F.count(F.lit(1)).alias("records"))
    return manifest.join(counts, "tenant").drop("exported_at")


@query("write_dead_letter", with_ev(BAD_EV, f"SELECT n, {REASON} AS reason FROM bad WHERE ({REASON}) IS NOT NULL"))
def _(spark, sf):
    out = shared_folder(spark, "rejects")
    _good, rejected = V.split_rejects(V.validate_events(faulty_events(spark, sf)))
    sinks.write_dead_letter(rejected, out)
    return spark.read.schema("n long, reason string").json(out)
