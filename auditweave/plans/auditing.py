"""Hash chain, alert and status queries."""

from pyspark.sql import functions as F

from auditweave.functions.columns import micros, record_hash
from auditweave.operators import alerts as A
from auditweave.operators import chain as H
from auditweave.operators import curate as C
from auditweave.operators import reports as R
from auditweave.plans.base import events, query, rfc_sql, stored, us, with_ev
from auditweave.plans.curation import fill_sql, latest_sql, seeds_sql, top_sql
from auditweave.plans.decisions import ACTS, DEC, LOG, decided, operator_acts, stored_log
from auditweave.session import shared_folder
from auditweave.sources import sinks
from auditweave.sources.events import read_messages

# --- Chains over the ingest records of all events -------------------------------------------

PRE = f"""'{{"sequence":' || sequence || ',"timestamp":"' || {rfc_sql('ingested_us')} || '","kind":"ingest","payload":{{"event_id":"' || event_id ||
    '","source_id":"' || source_id || '"}},"prev_hash":"'"""

NUMBERED = f"""numbered AS MATERIALIZED (SELECT *, {PRE} AS pre FROM (SELECT *,
    row_number() OVER (PARTITION BY tenant ORDER BY ingested_us, event_id) - 1 AS sequence FROM ev))"""

CHAIN = """chain AS (
  SELECT tenant, sequence, '' AS prev_hash, sha256(pre || '"}') AS hash FROM numbered WHERE sequence = 0
  UNION ALL
  SELECT n.tenant, n.sequence, c.hash, sha256(n.pre || c.hash || '"}') FROM chain c JOIN numbered n ON n.tenant = c.tenant AND n.sequence = c.sequence + 1)"""


def ingest_rows(spark, sf):
    return sinks.ingest_audit_rows(events(spark, sf))


@query("append_chain", with_ev(NUMBERED, CHAIN, "SELECT tenant, sequence, prev_hash, hash FROM chain", recursive=True))
def _(spark, sf):
    return H.append_chain(ingest_rows(spark, sf)).select("tenant", "sequence", "prev_hash", "hash")


@query("append_chain_continued", with_ev(NUMBERED, CHAIN, "SELECT tenant, sequence, hash FROM chain", recursive=True))
def _(spark, sf):
    """The first half of the month appended first, the rest continued from its heads."""
    rows = ingest_rows(spark, sf)
    cut = F.timestamp_seconds(F.lit(1705320000))
    first = H.append_chain(rows.where(F.col("timestamp") < cut))
    rest = H.append_chain(rows.where(F.col("timestamp") >= cut), H.chain_stats(first))
    return first.unionByName(rest).select("tenant", "sequence", "hash")


@query("record_hash", with_ev(DEC, ACTS, LOG, f"""SELECT tenant, sequence, sha256('{{"sequence":' || sequence || ',"timestamp":"' || {rfc_sql('us')} ||
    '","kind":"' || kind || '","payload":' || payload || ',"prev_hash":"' || hash || '"}}') AS record_hash FROM log"""))
def _(spark, sf):
    log = stored_log(spark, sf)
    h = record_hash(F.col("sequence"), F.col("timestamp"), F.col("kind"), F.col("payload"), F.col("hash"))
    return log.select("tenant", "sequence", h.alias("record_hash"))


def stored_chain(spark, sf):
    """The chained ingest records of all events, stored."""
    return stored(spark, sf, "ingest_chain", lambda: H.append_chain(ingest_rows(spark, sf)))


def tampered(spark, sf):
    """The ingest chain with the payloads of critical events changed and the records of warnings removed."""
    ev = events(spark, sf).select("event_id", F.col("severity").alias("_sev"))
    records = stored_chain(spark, sf).join(ev, F.col("row_id") == F.col("event_id")).drop("event_id")
    return records.where(F.col("_sev") != "warn").withColumn(
        "payload", F.when(F.col("_sev") == "critical", '{"event_id":"x"}').otherwise(F.col("payload")))


BROKEN = """broken AS (SELECT tenant, sequence, CASE WHEN severity = 'critical' THEN 'hash does not fit the record'
      WHEN before = 'warn' THEN 'predecessor missing' END AS reason, severity
    FROM (SELECT *, lag(severity) OVER (PARTITION BY tenant ORDER BY sequence) AS before FROM numbered) WHERE severity <> 'warn')"""


@query("verify_records", with_ev(NUMBERED, BROKEN, "SELECT tenant, sequence, reason FROM broken WHERE reason IS NOT NULL"))
def _(spark, sf):
    return H.bad_records(tampered(spark, sf))


@query("verify_chain", with_ev(NUMBERED, BROKEN, """SELECT tenant, count(*) FILTER (reason IS NOT NULL) = 0 AS valid,
    min(sequence) FILTER (reason IS NOT NULL) AS first_bad, count(*) AS length FROM broken GROUP BY tenant"""))
def _(spark, sf):
    return H.verify_chain(tampered(spark, sf)).drop("head_hash")


@query("verify_chain_intact", with_ev(NUMBERED, CHAIN, """SELECT c.tenant, TRUE AS valid, CAST(NULL AS BIGINT) AS first_bad, count(*) AS length,
    arg_max(c.hash, c.sequence) AS head_hash FROM chain c GROUP BY c.tenant""", recursive=True))
def _(spark, sf):
    return H.verify_chain(stored_chain(spark, sf))


@query("verify_since", with_ev(NUMBERED, BROKEN, """cut AS (SELECT tenant, CASE WHEN tenant = 'tenant-3' THEN max(sequence)
      ELSE max(sequence) FILTER (severity = 'critical') END AS s FROM numbered WHERE severity <> 'warn' GROUP BY tenant)""",
    """SELECT cut.tenant, count(reason) = 0 AS valid, min(b.sequence) FILTER (reason IS NOT NULL) AS first_bad, count(b.sequence) AS length
    FROM cut LEFT JOIN broken b ON b.tenant = cut.tenant AND b.sequence > cut.s GROUP BY cut.tenant"""))
def _(spark, sf):
    """Verified above each tenant's last critical record, whose stored hash is the checkpoint; one tenant has nothing new."""
    records = tampered(spark, sf)
    trusted = records.where((F.col("_sev") == "critical") | (F.col("tenant") == "tenant-3"))
    cp = trusted.groupBy("tenant").agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"))
    return H.verify_since(records, cp).drop("head_hash")


@query("chain_predecessor", with_ev(NUMBERED, CHAIN, """SELECT tenant, sequence, lag(hash) OVER (PARTITION BY tenant ORDER BY sequence) AS pred_hash,
    1::BIGINT AS copies, TRUE AS self_ok FROM chain""", recursive=True))
def _(spark, sf):
    linked = H.link_records(stored_chain(spark, sf))
    return linked.select("tenant", "sequence", "pred_hash", "copies", "self_ok")


@query("chain_stats", with_ev(DEC, ACTS, LOG, """SELECT tenant, count(*) AS length, arg_max(hash, sequence) AS head_hash,
    max(sequence) + 1 AS next_sequence FROM log GROUP BY tenant"""))
def _(spark, sf):
    return H.chain_stats(stored_log(spark, sf))


@query("check_anchors", with_ev(DEC, ACTS, LOG, "heads AS (SELECT tenant, count(*) AS length, max(sequence) AS sequence FROM log GROUP BY tenant)",
    """SELECT h.tenant, h.length, h.sequence, CASE WHEN h.tenant = 'tenant-1' THEN 'missing' WHEN h.tenant = 'tenant-2' THEN 'replaced' ELSE 'present' END AS status
    FROM heads h"""))
def _(spark, sf):
    """One tenant's records after 28 January cut off, another's hashes replaced."""
    log = stored_log(spark, sf)
    anchors = H.anchor_heads(log, F.timestamp_seconds(F.lit(1706659200)))
    later = log.where((F.col("tenant") != "tenant-1") | (F.col("timestamp") < F.timestamp_seconds(F.lit(1706400000))))
    later = later.withColumn("hash", F.when(F.col("tenant") == "tenant-2", F.sha2("hash", 256)).otherwise(F.col("hash")))
    return H.check_anchors(later, anchors).select("tenant", "length", "sequence", "status")


@query("retention_tiers", with_ev("""SELECT event_id, CASE WHEN (1768435200000000 - us) / 86400000000.0 < 720 THEN 'hot'
    WHEN (1768435200000000 - us) / 86400000000.0 < 735 THEN 'archive' ELSE 'purge' END AS tier FROM ev"""))
def _(spark, sf):
    at = F.timestamp_micros(F.lit(1768435200000000))
    return H.retention_tiers(events(spark, sf), at, 720, 735).select("event_id", "tier")


LATE_US = "CASE WHEN n % 97 = 0 THEN ingested_us - 25 * 86400000000 ELSE ingested_us END"


@query("audit_retention", with_ev(NUMBERED, f"""aged AS (SELECT *, 1706659200000000 - ({LATE_US}) < 10 * 86400000000 AS young FROM numbered)""",
    """cut AS (SELECT tenant, coalesce(min(sequence) FILTER (young) - 1, max(sequence)) AS s FROM aged GROUP BY tenant)""",
    """SELECT a.tenant, count(*) FILTER (young) AS young, min(a.sequence) AS first_kept, count(*) AS length
    FROM aged a JOIN cut ON a.tenant = cut.tenant AND a.sequence > cut.s GROUP BY a.tenant"""))
def _(spark, sf):
    """Times out of order: some late records are stamped 25 days back. No young record goes with them."""
    records = stored_chain(spark, sf)
    stamp = F.timestamp_micros(micros(F.col("timestamp")) - F.when(F.col("row_id").cast("long") % 97 == 0, 25 * 86_400_000_000).otherwise(0))
    as_of = F.timestamp_micros(F.lit(1706659200000000))
    kept, _cut = H.audit_retention(records.withColumn("timestamp", stamp), as_of, 10)
    young = micros(as_of) - micros(F.col("timestamp")) < 10 * 86_400_000_000
    return kept.groupBy("tenant").agg(F.count_if(young).alias("young"), F.min("sequence").alias("first_kept"), F.count(F.lit(1)).alias("length"))


@query("audit_retention_verified", with_ev(NUMBERED, """kept AS (SELECT * FROM numbered n WHERE sequence >
      (SELECT max(sequence) FROM numbered o WHERE o.tenant = n.tenant AND 1706659200000000 - o.ingested_us >= 10 * 86400000000))""",
    "SELECT tenant, TRUE AS valid, CAST(NULL AS BIGINT) AS first_bad, count(*) AS length FROM kept GROUP BY tenant"))
def _(spark, sf):
    """Chains without the records older than ten days still verify from the cut."""
    records = stored_chain(spark, sf)
    kept, cut = H.audit_retention(records, F.timestamp_micros(F.lit(1706659200000000)), 10)
    return H.verify_since(kept, cut).drop("head_hash")


SEGMENT = 250


SEGMENTS = [f"""seg AS (
  SELECT tenant, sequence, sequence // {SEGMENT} AS segment, '' AS prev_hash, sha256(pre || '"}}') AS hash FROM numbered WHERE sequence % {SEGMENT} = 0
  UNION ALL
  SELECT n.tenant, n.sequence, c.segment, c.hash, sha256(n.pre || c.hash || '"}}') FROM seg c JOIN numbered n
    ON n.tenant = c.tenant AND n.sequence = c.sequence + 1 AND n.sequence % {SEGMENT} <> 0)""",
    f"""lasts AS (SELECT tenant, segment, max(ingested_us) AS ingested_us, arg_max(hash, sequence) AS last, count(*) AS n FROM (SELECT seg.*, n.ingested_us FROM seg
      JOIN numbered n ON n.tenant = seg.tenant AND n.sequence = seg.sequence) GROUP BY tenant, segment)""",
    f"""head_pre AS (SELECT tenant, n, segment AS sequence, '{{"sequence":' || segment || ',"timestamp":"' || {rfc_sql('ingested_us')} ||
      '","kind":"segment","payload":{{"segment":' || segment || ',"segment_head":"' || last || '"}},"prev_hash":"' AS pre FROM lasts)""",
    """heads AS (SELECT tenant, sequence, n, '' AS prev_hash, sha256(pre || '"}') AS hash FROM head_pre WHERE sequence = 0
      UNION ALL SELECT p.tenant, p.sequence, p.n, h.hash, sha256(p.pre || h.hash || '"}') FROM heads h JOIN head_pre p ON p.tenant = h.tenant AND p.sequence = h.sequence + 1)"""]


def level(name, df):
    return df.select(F.lit(name).alias("level"), "tenant", "sequence", "prev_hash", "hash")


@query("segment_chain", with_ev(NUMBERED, *SEGMENTS, """SELECT 'record' AS level, tenant, sequence, prev_hash, hash FROM seg
    UNION ALL SELECT 'head', tenant, sequence, prev_hash, hash FROM heads""", recursive=True))
def _(spark, sf):
    """Records chained inside segments and the chain of the segments' heads."""
    records, heads = H.segment_chain(ingest_rows(spark, sf), SEGMENT)
    return level("record", records).unionByName(level("head", heads))


@query("verify_segments", with_ev(NUMBERED, f"""hit AS (SELECT tenant, sequence, severity FROM numbered WHERE severity = 'critical')""",
    f"""SELECT tenant, 'record' AS level, sequence AS at, 'hash does not fit the record' AS reason FROM hit"""))
def _(spark, sf):
    records, heads = H.segment_chain(ingest_rows(spark, sf), SEGMENT)
    critical = events(spark, sf).where(F.col("severity") == "critical").select(F.col("event_id").alias("row_id"), F.lit(1).alias("_hit"))
    changed = records.join(critical, "row_id", "left").withColumn(
        "payload", F.when(F.col("_hit") == 1, "{}").otherwise(F.col("payload"))).drop("_hit")
    return H.verify_segments(changed, heads, SEGMENT)


# --- Alerts -----------------------------------------------------------------------------------------


def alert_rows(df):
    ref = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("ref"))))
    return df.select("title", "body", "severity", "rule_id", us("created_at"), ref.alias("ref"))


EVENT_ALERTS = """SELECT 'Elevated ingest severity (' || event_type || ')' AS title, 'event_id=' || event_id || ' source_id=' || source_id || ' severity=' || severity || ' trace=' AS body,
    severity, 'ingest.severity_warn_or_above' AS rule_id, ingested_us AS us,
    '{"event_id":"' || event_id || '","event_type":"' || event_type || '","source_id":"' || source_id || '"}' AS ref FROM ev WHERE severity <> 'info'"""

DIGEST_ALERTS = """SELECT 'Digest freshness below threshold' AS title, 'freshness=' || printf('%.3f', freshness) || ' strategy=1 k=' || k || ' selected=' || selected_n AS body, 'warn' AS severity,
      'digest.low_freshness' AS rule_id, us, '{"freshness":"' || printf('%.4f', freshness) || '","strategy":"1"}' AS ref FROM d WHERE freshness < 0.22
    UNION ALL SELECT 'Digest diversity below threshold', 'diversity=' || printf('%.3f', diversity) || ' strategy=1 k=' || k || ' selected=' || selected_n, 'info',
      'digest.low_diversity', us, '{"diversity":"' || printf('%.4f', diversity) || '","strategy":"1"}' FROM d WHERE diversity < 0.38
    UNION ALL SELECT 'Digest selection unexpectedly sparse', 'requested k=' || k || ' but only ' || selected_n || ' events matched filters/strategy', 'warn',
      'digest.sparse_selection', us, '{"k":"' || k || '","selected":"' || selected_n || '"}' FROM d WHERE k > 4 AND selected_n > 0 AND selected_n < k // 3"""


@query("alerts_from_events", with_ev(EVENT_ALERTS))
def _(spark, sf):
    return alert_rows(A.alerts_from_events(events(spark, sf)))


def hourly(spark, sf):
    return events(spark, sf).withColumn("hour", F.date_trunc("hour", "timestamp"))


HOUR = "h AS (SELECT *, us // 3600000000 AS hr FROM ev)"
HOUR_TOP = "hp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hr ORDER BY us DESC, event_id) AS rn FROM h) WHERE rn <= 40)"
HOUR_SCORES = """st AS (SELECT hr, count(*) AS input_n, count(DISTINCT source_id) AS srcs, max(us) AS mx, min(us) AS mn FROM h GROUP BY hr),
  pr AS (SELECT hr, count(*) AS selected_n, sum(us) AS s, count(DISTINCT source_id) AS psrcs FROM hp GROUP BY hr),
  d AS (SELECT st.hr, (st.hr + 1) * 3600000000 AS us, 40 AS k, selected_n,
     1.0 - ((st.hr + 1) * 3600000000 * selected_n - s)::DOUBLE / (selected_n * ((st.hr + 1) * 3600000000 - mn))::DOUBLE AS freshness,
     psrcs::DOUBLE / srcs AS diversity FROM st JOIN pr ON st.hr = pr.hr)"""


@query("alerts_from_digests", with_ev(HOUR, HOUR_TOP, HOUR_SCORES, DIGEST_ALERTS))
def _(spark, sf):
    ev = hourly(spark, sf)
    end = F.timestamp_micros(micros(F.col("hour")) + 3_600_000_000)
    scores = C.digest_scores(C.select_latest(ev, 40, ["hour"]), ev, ["hour"], as_of=end)
    digests = scores.withColumn("strategy", F.lit(1)).withColumn("window_end", end)
    return alert_rows(A.alerts_from_digests(digests, 40))


@query("alerts_from_decisions", with_ev(DEC, """SELECT 'AI suggestion requires operator review' AS title,
    'event_id=' || event_id || ' classification=' || c || ' — acknowledge via operator resolve endpoint.' AS body, 'warn' AS severity,
    'operator.review_required' AS rule_id, ingested_us AS us, '{"classification":"' || c || '","event_id":"' || event_id || '"}' AS ref
    FROM (SELECT *, CASE WHEN guardrails IN ('pass', 'rejected_output') THEN label ELSE guardrails END AS c FROM dec) WHERE guardrails <> 'pass' OR review"""))
def _(spark, sf):
    return alert_rows(A.alerts_from_decisions(decided(spark, sf)))


@query("alerts_from_actions", with_ev(ACTS, """SELECT 'Operator recorded ' || act AS title,
    'operator_id=op-' || (n % 7) || ' event_id=' || event_id || ' — tamper-evident audit append succeeded.' AS body,
    CASE act WHEN 'override' THEN 'warn' ELSE 'info' END AS severity, 'operator.resolution_recorded' AS rule_id, ingested_us + 30000000 AS us,
    '{"action":"' || act || '","event_id":"' || event_id || '","operator_id":"op-' || (n % 7) || '"}' AS ref FROM acts"""))
def _(spark, sf):
    return alert_rows(A.alerts_from_actions(operator_acts(spark, sf)))


CHECKS = "checks AS (SELECT tenant, day, max(us) AS us, count(*) FILTER (severity = 'critical') <= 12 AS valid FROM ev GROUP BY tenant, day)"


@query("audit_transition", with_ev(CHECKS, """SELECT tenant, us, 'Audit chain integrity failure' AS title, 'critical' AS severity FROM (SELECT *, lag(valid, 1, TRUE) OVER
    (PARTITION BY tenant ORDER BY us) AS before FROM checks) WHERE NOT valid AND before"""))
def _(spark, sf):
    """A daily check per tenant that fails when the day had more than 12 critical events."""
    checks = events(spark, sf).groupBy("tenant", "day").agg(
        F.max("timestamp").alias("checked_at"), (F.sum((F.col("severity") == "critical").cast("int")) <= 12).alias("valid"),
    ).withColumn("verify_err", F.col("tenant"))
    return A.alerts_from_audit(checks).select(F.col("body").alias("tenant"), us("created_at"), "title", "severity")


def greedy_sql(gap: int) -> str:
    """Serial throttle as recursion: the next kept alert is the first one at least ``gap`` after the last kept."""
    return f"""kept AS (SELECT key, min(us) AS us FROM a GROUP BY key
  UNION ALL SELECT k.key, min(a.us) FROM kept k JOIN a ON a.key = k.key AND a.us >= k.us + {gap} GROUP BY k.key, k.us)"""


@query("throttle_alerts", with_ev(
    "a AS MATERIALIZED (SELECT 'ingest|' || event_id AS key, ingested_us AS us, event_id FROM ev WHERE severity <> 'info')",
    "SELECT event_id, us FROM a"))
def _(spark, sf):
    """Default key: rule and event, so every event alert is its own key; repeated deliveries are dropped."""
    alerts = A.alerts_from_events(events(spark, sf))
    again = alerts.withColumn("created_at", F.timestamp_micros(micros(F.col("created_at")) + 44_999_999)).withColumn("id", F.sha2("id", 256))
    out = A.throttle_alerts(alerts.unionByName(again))
    return out.select(F.element_at("ref", F.lit("event_id")).alias("event_id"), us("created_at"))


@query("throttle_alerts_busy_rule", with_ev(
    "a AS MATERIALIZED (SELECT 'ingest.severity_warn_or_above' AS key, ingested_us AS us FROM ev WHERE severity <> 'info')",
    greedy_sql(3_600_000_000), "SELECT key AS rule_id, us FROM kept", recursive=True))
def _(spark, sf):
    """One key holds every alert: resolved in parallel time blocks."""
    out = A.throttle_alerts(A.alerts_from_events(events(spark, sf)), 3600, F.col("rule_id"), few=100, block_rows=64)
    return out.select("rule_id", us("created_at"))


@query("throttle_alerts_per_source", with_ev(
    "a AS MATERIALIZED (SELECT source_id AS key, ingested_us AS us FROM ev WHERE severity <> 'info')",
    greedy_sql(172_800_000_000), "SELECT key AS source_id, us FROM kept", recursive=True))
def _(spark, sf):
    source = F.element_at("ref", F.lit("source_id"))
    out = A.throttle_alerts(A.alerts_from_events(events(spark, sf)), 172800, source)
    return out.select(source.alias("source_id"), us("created_at"))


@query("alerts_newest_first", with_ev(
    "SELECT us, severity FROM (SELECT ingested_us AS us, severity FROM ev WHERE severity <> 'info' ORDER BY us DESC LIMIT 400)"))
def _(spark, sf):
    return A.alerts_newest_first(A.alerts_from_events(events(spark, sf)), 400).select(us("created_at"), "severity")


# --- Status and live feed ----------------------------------------------------------------------------------


@query("health_report", with_ev(NUMBERED, BROKEN, """SELECT CAST(count(*) AS BIGINT) AS audit_chain_length, count(*) FILTER (reason IS NOT NULL) = 0 AS audit_chain_valid,
    count(DISTINCT tenant) AS chains, (SELECT count(*) FROM ev) AS recent_events,
    (SELECT count(*) FROM ev WHERE severity <> 'info') AS alerts_buffered,
    coalesce((SELECT min(tenant || ': first bad sequence ' || s) FROM (SELECT tenant, min(sequence) AS s FROM broken WHERE reason IS NOT NULL GROUP BY tenant)), '') AS verify_err,
    CASE WHEN count(*) FILTER (reason IS NOT NULL) = 0 THEN 'ok' ELSE 'degraded' END AS status FROM broken"""))
def _(spark, sf):
    ev = events(spark, sf)
    return R.health_report(H.verify_chain(tampered(spark, sf)), ev, A.alerts_from_events(ev)).drop("audit_head_hash")


@query("live_feed", with_ev(DEC, top_sql(20), """SELECT 'event' AS type, count(*) AS messages FROM ev UNION ALL SELECT 'digest', count(DISTINCT day) FROM ev
    UNION ALL SELECT 'decision', count(*) FROM dec UNION ALL SELECT 'alert', count(*) FROM ev WHERE severity <> 'info'"""))
def _(spark, sf):
    ev = events(spark, sf)
    digests = C.curate(ev, C.LATEST, 20, ["day"], window_end=F.lit(None).cast("timestamp"))
    feed = sinks.live_feed(ev, digests, decided(spark, sf), A.alerts_from_events(ev))
    return feed.where(F.col("data").isNotNull()).groupBy("type").agg(F.count(F.lit(1)).alias("messages"))


@query("live_events", with_ev(f"""SELECT 'event' AS type, sha256('{{"event_id":"' || event_id || '","source_id":"' || source_id ||
    '","source_type":"synthetic","event_type":"' || event_type || '","severity":"' || severity || '","timestamp":"' || {rfc_sql('us')} ||
    '","ingested_at":"' || {rfc_sql('ingested_us')} || '","metadata":{{"ingestion_pod":"' || pod ||
    '","schema_version":"1.0.0","tenant_id":"' || tenant || '"}},"payload":' || payload || '}}') AS data_hash FROM ev"""))
def _(spark, sf):
    return sinks.live_envelope(events(spark, sf), "event", sinks.event_json()).select("type", F.sha2("data", 256).alias("data_hash"))


@query("read_messages", with_ev(f"""SELECT source_id AS key, sha256('{{"event_id":"' || event_id || '","source_id":"' || source_id ||
    '","source_type":"synthetic","event_type":"' || event_type || '","severity":"' || severity || '","timestamp":"' || {rfc_sql('us')} ||
    '","ingested_at":"' || {rfc_sql('ingested_us')} || '","metadata":{{"ingestion_pod":"' || pod ||
    '","schema_version":"1.0.0","tenant_id":"' || tenant || '"}},"payload":' || payload || '}}') AS value_hash FROM ev"""))
def _(spark, sf):
    """Keyed messages written to files and read again as any message source."""
    out = shared_folder(spark, "messages")
    sinks.write_messages(sinks.event_messages(events(spark, sf)), "json", out)
    return read_messages(spark, "json", path=out).select("key", F.sha2("value", 256).alias("value_hash"))


@query("preferred_present", with_ev(latest_sql(), seeds_sql(20, 80), fill_sql(20), """pc AS (SELECT day, max(us) AS us FROM ev WHERE source_id IN ('user-3', 'user-7') GROUP BY day)""",
    """SELECT p.day, bool_or(source_id IN ('user-3', 'user-7')) AS present, max(pc.us) AS candidate_us FROM picked p LEFT JOIN pc ON p.day = pc.day GROUP BY p.day"""))
def _(spark, sf):
    ev = events(spark, sf)
    pref = F.col("source_id").isin("user-3", "user-7")
    picked = C.select_min_diversity(ev, 20, 80, by=["day"])
    cand = ev.where(pref).groupBy("day").agg(F.max(micros(F.col("timestamp"))).alias("candidate_us"))
    return picked.groupBy("day").agg(F.bool_or(pref).alias("present")).join(cand, "day", "left").select("day", "present", "candidate_us")
