"""Source, validation, filter and message queries."""

from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import age_micros, micros, render_binary, resolve_tenant, rfc3339, severity_rank, splice_json
from auditweave.operators import curate as C
from auditweave.operators import reports as R
from auditweave.operators import validate as V
from auditweave.plans.base import EV, EVENT_COLUMNS, events, query, rank_sql, rfc_sql, table, us, with_ev
from auditweave.plans.curation import nation_packs, score_cols, scores_sql, top_sql
from auditweave.sources import changes as CH
from auditweave.sources import events as E
from auditweave.session import shared_folder
from auditweave.sources import packs, sinks, webhooks
from auditweave.sources.connector import decode_changes, read_change_log
from auditweave.sources.layout import write_clustered

# --- Events with one planted fault per residue ----------------------------------------

FAULT = "CASE WHEN n % 101 <= 8 THEN CAST(n % 101 AS INTEGER) ELSE -1 END"

BAD_EV = f"""bad AS (SELECT n, us, tenant, pod, payload,
    CASE WHEN f = 0 THEN '' ELSE event_id END AS event_id, CASE WHEN f = 1 THEN '' ELSE source_id END AS source_id,
    CASE WHEN f = 2 THEN '' ELSE source_type END AS source_type, CASE WHEN f = 3 THEN '' ELSE event_type END AS event_type,
    CASE WHEN f = 4 THEN '' WHEN f = 5 THEN 'bogus' ELSE severity END AS severity,
    CASE WHEN f = 6 THEN NULL ELSE us END AS ts_us, CASE WHEN f = 7 THEN '' ELSE '1.0.0' END AS version, f
  FROM (SELECT *, {FAULT} AS f FROM ev))"""

REASON = """CASE WHEN event_id = '' THEN 'event_id required' WHEN source_id = '' THEN 'source_id required'
    WHEN source_type = '' THEN 'source_type required' WHEN event_type = '' THEN 'event_type required'
    WHEN severity = '' THEN 'severity required'
    WHEN severity NOT IN ('info', 'warn', 'error', 'critical') THEN 'unknown severity "' || severity || '"'
    WHEN ts_us IS NULL THEN 'timestamp required' WHEN version = '' THEN 'metadata.schema_version required' END"""


def faulty_events(spark, sf):
    """Every event; those with n % 101 in 0..8 carry one fault each (8 only spoils the message text)."""
    fault = F.col("n") % 101
    blank = lambda at, c: F.when(fault == at, "").otherwise(F.col(c)).alias(c)
    return events(spark, sf).select(
        blank(0, "event_id"), blank(1, "source_id"), blank(2, "source_type"), blank(3, "event_type"),
        F.when(fault == 4, "").when(fault == 5, "bogus").otherwise(F.col("severity")).alias("severity"),
        F.when(fault == 6, None).otherwise(F.col("timestamp")).alias("timestamp"), "ingested_at", "payload",
        F.col("metadata").withField("schema_version", F.when(fault == 7, "").otherwise(F.lit("1.0.0"))).alias("metadata"),
        "n", "tenant",
    )


def raw_messages(spark, sf):
    ev = faulty_events(spark, sf)
    return ev.select(F.when(F.col("n") % 101 == 8, F.concat(F.lit("{oops "), "event_id")).otherwise(sinks.event_json()).alias("value"))


@query("validate_events", with_ev(BAD_EV, f"SELECT n, {REASON} AS reason FROM bad"))
def _(spark, sf):
    return V.validate_events(faulty_events(spark, sf)).select("n", "reason")


@query("split_rejects", with_ev(
    BAD_EV, f"SELECT coalesce({REASON}, 'accepted') AS reason, count(*) AS events FROM bad GROUP BY 1"))
def _(spark, sf):
    good, rejected = V.split_rejects(V.validate_events(faulty_events(spark, sf)))
    both = good.select(F.lit("accepted").alias("reason")).unionByName(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


@query("validate_events_strict", with_ev(BAD_EV, """SELECT n, CASE
    WHEN n % 13 = 1 AND source_type = 'synthetic' THEN 'source_type not in list' WHEN source_type = '' THEN 'source_type not in list'
    WHEN severity NOT IN ('info', 'warn', 'error', 'critical') THEN 'severity not in list' WHEN ts_us IS NULL THEN 'timestamp required'
    WHEN n % 17 = 0 THEN 'payload required' WHEN n % 19 = 0 THEN 'unknown field' END AS reason FROM bad"""))
def _(spark, sf):
    n = F.col("n")
    ev = faulty_events(spark, sf).withColumn(
        "source_type", F.when((n % 13 == 1) & (F.col("source_type") == "synthetic"), "carrier pigeon").otherwise(F.col("source_type"))
    ).withColumn("payload", F.when(n % 17 == 0, None).otherwise(F.col("payload")))
    raw = F.to_json(F.struct("event_id", "source_id", F.when(n % 19 == 0, "x").alias("surplus")))
    return V.validate_events_strict(ev, raw).select("n", "reason")


@query("read_events", with_ev(
    BAD_EV, f"SELECT event_id, source_id, severity, us, replace(payload, ' ', '') AS payload, tenant FROM bad WHERE f <> 8 AND ({REASON}) IS NULL"))
def _(spark, sf):
    ev = E.read_events(raw_messages(spark, sf))
    return ev.select("event_id", "source_id", "severity", us("timestamp"), "payload", F.col("metadata.tenant_id").alias("tenant"))


@query("decode_rejects", with_ev(
    BAD_EV, f"SELECT reason, count(*) AS messages FROM (SELECT CASE WHEN f = 8 THEN 'bad json' ELSE {REASON} END AS reason FROM bad) WHERE reason IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    rejected = E.decode_events(raw_messages(spark, sf)).where(F.col("reason").isNotNull())
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


@query("write_events", with_ev(f"""SELECT source_id AS key, '{{"event_id":"' || event_id || '","source_id":"' || source_id ||
    '","source_type":"synthetic","event_type":"' || event_type || '","severity":"' || severity || '","timestamp":"' || {rfc_sql('us')} ||
    '","ingested_at":"' || {rfc_sql('ingested_us')} || '","metadata":{{"ingestion_pod":"' || pod ||
    '","schema_version":"1.0.0","tenant_id":"' || tenant || '"}},"payload":' || payload || '}}' AS value FROM ev"""))
def _(spark, sf):
    return sinks.event_messages(events(spark, sf))


@query("write_digests", with_ev(top_sql(20), "ends AS (SELECT day, max(us) AS end_us FROM ev GROUP BY day)", f"""SELECT strftime(make_timestamp(e.end_us),
    '%Y-%m-%dT%H:%M:%S.%fZ') AS window_end, '1' AS strategy, CAST(count(*) AS INTEGER) AS selected_n, arg_max(p.event_id, p.us) AS first_id
    FROM picked p JOIN ends e ON e.day = p.day GROUP BY e.end_us"""))
def _(spark, sf):
    messages = sinks.digest_messages(daily_digests(spark, sf))
    member = lambda path: F.get_json_object("value", path)
    return messages.select(
        member("$.window_end").alias("window_end"), member("$.strategy").alias("strategy"),
        F.json_array_length(member("$.selected_events")).alias("selected_n"), member("$.selected_events[0].event_id").alias("first_id"))


@query("read_digests", with_ev(top_sql(20), scores_sql(),
    """ends AS (SELECT day, max(us) AS end_us FROM ev GROUP BY day)""",
    "SELECT e.end_us, s.freshness, s.diversity, s.redundancy, p.event_id, p.us FROM picked p JOIN scores s ON p.day = s.day JOIN ends e ON e.day = p.day"))
def _(spark, sf):
    """Digests written as messages, read back and exploded to rows."""
    messages = sinks.digest_messages(daily_digests(spark, sf))
    back = E.read_digests(messages).select(us("window_end", "end_us"), *score_cols()[2:], F.explode("selected_events").alias("e"))
    return back.select("end_us", "freshness", "diversity", "redundancy", "e.event_id", F.unix_micros("e.timestamp").alias("us"))


def daily_digests(spark, sf, k=20):
    ev = events(spark, sf)
    ends = ev.groupBy("day").agg(F.max("timestamp").alias("_end"))
    picked = C.select_latest(ev, k, ["day"])
    scores = C.digest_scores(picked, ev, ["day"]).join(ends, "day")
    return C.digest_records(picked, scores, C.LATEST, ["day"], F.col("_end"))


@query("digest_to_rows", with_ev(top_sql(20), "SELECT day, event_id, severity, us FROM picked"))
def _(spark, sf):
    rows = daily_digests(spark, sf).select("day", F.inline("selected_events"))
    return rows.select("day", "event_id", "severity", us("timestamp"))


@query("read_audit_inputs", with_ev("""SELECT CASE event_type WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'unknown' ELSE event_type END AS kind,
    '{"event_id":"' || event_id || '","k":' || regexp_extract(payload, '[0-9]+') || '}' AS payload FROM ev"""))
def _(spark, sf):
    kind = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("event_type"))
    k = F.get_json_object("payload", "$.k").cast("int")
    text = F.to_json(F.struct(kind.alias("kind"), F.struct("event_id", k.alias("k")).alias("payload")))
    return E.read_audit_inputs(events(spark, sf).select(text.alias("value")))


# --- Row changes ---------------------------------------------------------------------------

CHANGES = """chg AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'F' THEN 'update' ELSE 'delete' END AS action,
    '[' || o_orderkey || ',' || o_custkey || ',"' || o_orderstatus || '",' || CAST(round(o_totalprice * 100) AS BIGINT) || ']' AS cur,
    '[' || o_orderkey || ',' || o_custkey || ',"O",0]' AS old,
    CAST(epoch_us(o_orderdate) AS BIGINT) // 1000000 AS header_ts FROM orders)"""


def order_changes(spark, sf):
    """One change batch per order: open = insert, finished = update (urgent: two pairs, low: a broken batch), else delete."""
    o = table(spark, sf, "orders")
    text = lambda c: F.col(c).cast("string")
    cur = F.concat(F.lit("["), text("o_orderkey"), F.lit(","), text("o_custkey"), F.lit(',"'), F.col("o_orderstatus"), F.lit('",'),
                   F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit("]"))
    old = F.concat(F.lit("["), text("o_orderkey"), F.lit(","), text("o_custkey"), F.lit(',"O",0]'))
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = (
        F.when(status != "F", F.array(cur)).when(prio == "1-URGENT", F.array(old, cur, cur, old))
        .when(prio == "5-LOW", F.array(old, cur, old)).otherwise(F.array(old, cur))
    )
    names = F.when(prio == "2-HIGH", "Orders").when(prio == "3-MEDIUM", "items").otherwise("orders")
    return o.select(
        F.lit("shop").alias("schema"), names.alias("table"),
        F.when(status == "O", "insert").when(status == "F", "update").otherwise("delete").alias("action"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("header_ts"),
        F.lit("bin.000001").alias("log_file"), F.col("o_orderkey").alias("log_pos"), rows.alias("rows"))


def _mysql_payload(action, after="", before="", row=""):
    member = lambda name, v: f"""',"{name}":' || {v} || """ if v else ""
    return f"""'{{"action":"{action}"' || {member('after', after)}{member('before', before)}',"binlog":{{"binlog_file":"bin.000001","binlog_position":' || o_orderkey ||
      '}},"database":"shop"' || {member('row', row)}',"table":"' || tbl || '"}}'"""


MYSQL_EVENTS = f"""WITH {CHANGES}, t AS (SELECT *, CASE o_orderpriority WHEN '2-HIGH' THEN 'Orders' WHEN '3-MEDIUM' THEN 'items' ELSE 'orders' END AS tbl FROM chg),
  out AS (
    SELECT o_orderkey, 0 AS ordinal, 'mysql.row.insert' AS event_type, 'info' AS severity, header_ts, {_mysql_payload('insert', row='cur')} AS payload FROM t WHERE action = 'insert'
    UNION ALL SELECT o_orderkey, 0, 'mysql.row.delete', 'warn', header_ts, {_mysql_payload('delete', before='cur')} FROM t WHERE action = 'delete'
    UNION ALL SELECT o_orderkey, 0, 'mysql.row.update', 'info', header_ts, {_mysql_payload('update', 'cur', 'old')} FROM t WHERE action = 'update' AND o_orderpriority <> '5-LOW'
    UNION ALL SELECT o_orderkey, 1, 'mysql.row.update', 'info', header_ts, {_mysql_payload('update', 'old', 'cur')} FROM t WHERE action = 'update' AND o_orderpriority = '1-URGENT')
  SELECT sha256('{{"p0":"shop-db","p1":"' || event_type || '","p2":"' || (header_ts * 1000000) || '","p3":' || to_json(payload) || ',"p4":"bin.000001:' || o_orderkey || ':' || ordinal || '"}}') AS event_id,
    event_type, severity, header_ts * 1000000 AS us, payload FROM out"""


@query("normalize_mysql_changes", MYSQL_EVENTS)
def _(spark, sf):
    ev = CH.normalize_mysql_changes(order_changes(spark, sf), F.lit("shop-db"))
    return ev.select("event_id", "event_type", "severity", us("timestamp"), "payload")


@query("stream_change_log", MYSQL_EVENTS)
def _(spark, sf):
    """Changes landed as files of four splits in two goes, read by one connector query that stops and starts again."""
    out = shared_folder(spark, "changelog")
    changes = order_changes(spark, sf)
    rows = F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))
    line = splice_json(F.struct(*[c for c in changes.columns if c != "rows"]), "rows", rows).alias("value")
    split, segment = (F.pmod(F.hash("log_pos"), F.lit(n)) for n in (4, 2))
    landed = changes.select(line, split.alias("split"), segment.alias("segment")).persist()
    for i in range(2):
        landed.where(F.col("segment") == i).write.partitionBy("split", "segment").mode("append").text(f"{out}/log")
        log = decode_changes(read_change_log(spark, f"{out}/log", stream=True, files_per_partition=4))
        q = (log.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    landed.unpersist()
    read = spark.read.parquet(f"{out}/data").where(F.col("reason").isNull())
    ev = CH.normalize_mysql_changes(read, F.lit("shop-db"))
    return ev.select("event_id", "event_type", "severity", us("timestamp"), "payload")


@query("check_mysql_changes", f"""WITH {CHANGES} SELECT o_orderkey AS log_pos, 'update with odd row count' AS reason FROM chg
    WHERE action = 'update' AND o_orderpriority = '5-LOW'""")
def _(spark, sf):
    return CH.check_mysql_changes(order_changes(spark, sf)).where(F.col("reason").isNotNull()).select("log_pos", "reason")


@query("filter_tables", """SELECT o_orderkey AS log_pos, CASE o_orderpriority WHEN '2-HIGH' THEN 'Orders' ELSE 'orders' END AS table_name
    FROM orders WHERE o_orderpriority <> '3-MEDIUM'""")
def _(spark, sf):
    kept = CH.filter_tables(order_changes(spark, sf), CH.table_list(" Shop.ORDERS ,, warehouse.items"))
    return kept.select("log_pos", F.col("table").alias("table_name"))


LINE_CHANGES = """lc AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 'insert' WHEN 'R' THEN 'update' ELSE 'delete' END AS op,
    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 2 = 1) THEN NULL
         ELSE '[' || l_partkey || ',' || l_suppkey || ']' END AS new_tuple,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE '[' || l_partkey || ',null]' END AS old_tuple FROM lineitem),
  rel AS (SELECT n_regionkey + 1 AS relation_id, n_name AS tbl, r_name AS sch, n_nationkey * 1000 AS since,
    lead(n_nationkey * 1000) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS until
    FROM nation JOIN region ON n_regionkey = r_regionkey),
  named AS (SELECT * FROM lc JOIN rel ON lc.l_linenumber = rel.relation_id AND l_orderkey * 10 + l_linenumber >= since
    AND (until IS NULL OR l_orderkey * 10 + l_linenumber < until))"""


def line_changes(spark, sf):
    li = table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    flag = F.col("l_returnflag")
    no_new = (flag == "A") | ((flag == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 1))
    return li.select(
        F.col("l_linenumber").alias("relation_id"),
        F.when(flag == "N", "insert").when(flag == "R", "update").otherwise("delete").alias("op"),
        F.when(~no_new, F.concat(F.lit("["), text("l_partkey"), F.lit(","), text("l_suppkey"), F.lit("]"))).alias("new_tuple"),
        F.when(flag != "N", F.concat(F.lit("["), text("l_partkey"), F.lit(",null]"))).alias("old_tuple"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lsn"))


def relations(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select((F.col("n_regionkey") + 1).alias("relation_id"), F.col("r_name").alias("schema"), F.col("n_name").alias("table"), (F.col("n_nationkey") * 1000).alias("lsn"))


@query("resolve_relations", f"""WITH {LINE_CHANGES} SELECT l_orderkey * 10 + l_linenumber AS lsn, sch AS schema_name, tbl AS table_name
    FROM named""")
def _(spark, sf):
    """Every relation is renamed four times; changes get the name of their time, earlier ones none."""
    out = CH.resolve_relations(line_changes(spark, sf), relations(spark, sf))
    return out.select("lsn", F.col("schema").alias("schema_name"), F.col("table").alias("table_name"))


@query("normalize_postgres_changes", f"""WITH {LINE_CHANGES} SELECT l_orderkey * 10 + l_linenumber AS lsn,
    '{{' || '"columns":' || (CASE op WHEN 'insert' THEN new_tuple WHEN 'update' THEN coalesce(new_tuple, old_tuple) ELSE old_tuple END)
      || ',"op":"' || op || '","schema":"' || sch || '","table":"' || tbl || '"}}' AS payload,
    'postgres.row_change' AS event_type, 'info' AS severity, 'postgres-cdc' AS pod
    FROM named""")
def _(spark, sf):
    named = CH.resolve_relations(line_changes(spark, sf), relations(spark, sf))
    ev = CH.normalize_postgres_changes(named, F.lit("shop-pg"), F.timestamp_seconds(F.col("lsn")))
    return ev.select((micros(F.col("timestamp")) / 1_000_000).cast("long").alias("lsn"), "payload", "event_type", "severity",
                     F.col("metadata.ingestion_pod").alias("pod"))


# --- Webhooks ----------------------------------------------------------------------------------

HOOKS = """hook AS (SELECT n, ingested_us, CASE WHEN n % 31 = 0 THEN '' ELSE source_id END AS source_id,
    CASE WHEN n % 37 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN severity = 'info' THEN NULL WHEN n % 41 = 0 THEN 'loud' ELSE severity END AS sev,
    CASE WHEN event_type = 'click' THEN NULL ELSE us END AS own_us,
    CASE WHEN event_type = 'view' THEN NULL ELSE replace(payload, ' ', '') END AS body FROM ev)"""


def hook_bodies(spark, sf):
    n = F.col("n")
    quoted = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":"'), c, F.lit('"'))).otherwise("")
    sev = F.when(F.col("severity") != "info", F.when(n % 41 == 0, "loud").otherwise(F.col("severity")))
    text = F.concat(
        F.lit('{"source_id":"'), F.when(n % 31 == 0, "").otherwise(F.col("source_id")), F.lit('"'),
        quoted("event_type", F.when(n % 37 != 0, F.col("event_type"))), quoted("severity", sev),
        quoted("timestamp", F.when(F.col("event_type") != "click", rfc3339(F.col("timestamp")))),
        F.when(F.col("event_type") != "view", F.concat(F.lit(',"payload":'), "payload")).otherwise(""), F.lit("}"))
    return events(spark, sf).select("n", "ingested_at", text.alias("value"))


@query("normalize_webhooks", with_ev(HOOKS, """SELECT source_id, event_type, coalesce(sev, 'info') AS severity,
    coalesce(own_us, ingested_us) AS us, coalesce(body, '{}') AS payload FROM hook
    WHERE source_id <> '' AND event_type IS NOT NULL AND coalesce(sev, 'info') <> 'loud'"""))
def _(spark, sf):
    ev = webhooks.normalize_webhooks(hook_bodies(spark, sf), F.col("ingested_at"), F.col("n"))
    return ev.select("source_id", "event_type", "severity", us("timestamp"), "payload")


@query("webhook_rejects", with_ev(HOOKS, """SELECT reason, count(*) AS bodies FROM (SELECT CASE
    WHEN source_id = '' OR event_type IS NULL THEN 'source_id and event_type required'
    WHEN sev = 'loud' THEN 'unknown severity "loud"' END AS reason FROM hook) WHERE reason IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    out = webhooks.decode_webhooks(hook_bodies(spark, sf), F.col("ingested_at"), F.col("n")).where(F.col("reason").isNotNull())
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("bodies"))


@query("render_binary", """SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN base64(encode(text || chr(1)))
    WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN base64(encode(text)) ELSE text END) AS rendered FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.when(F.col("lang") == "de", F.concat("text", F.char(F.lit(1)))).otherwise(F.col("text")).cast("binary")
    return d.select("doc_id", F.sha2(render_binary(raw), 256).alias("rendered"))


# --- Projections and filters -------------------------------------------------------------------------

@query("new_events", with_ev("""SELECT sha256('{"p0":"' || source_id || '","p1":"' || event_type || '","p2":"' || us || '","p3":' || to_json(payload) || ',"p4":"' || n || '"}') AS event_id,
    source_id, '1.0.0' AS schema_version, ingested_us FROM ev"""))
def _(spark, sf):
    built = V.new_events(
        events(spark, sf), F.col("source_id"), F.lit("synthetic"), F.col("event_type"), F.col("severity"), F.col("payload"),
        F.col("timestamp"), F.col("ingested_at"), ordinal=F.col("n"))
    return built.select("event_id", "source_id", F.col("metadata.schema_version").alias("schema_version"), us("ingested_at", "ingested_us"))


@query("severity_rank", with_ev(BAD_EV, f"SELECT n, {rank_sql()} AS severity_rank FROM bad"))
def _(spark, sf):
    return faulty_events(spark, sf).select("n", severity_rank(F.col("severity")).alias("severity_rank"))


@query("age_at", with_ev("SELECT n, greatest(1706000000000000 - us, 0) AS age_us FROM ev"))
def _(spark, sf):
    ref = F.timestamp_micros(F.lit(1706000000000000))
    return events(spark, sf).select("n", age_micros(ref, F.col("timestamp")).alias("age_us"))


@query("resolve_tenant", with_ev("""SELECT n, CASE WHEN event_type = 'view' THEN 'default' WHEN event_type = 'click' THEN 'default'
    WHEN event_type = 'error' THEN 'fallback' ELSE tenant END AS tenant FROM ev"""))
def _(spark, sf):
    kind = F.col("event_type")
    own = F.when(kind == "view", " \t ").when(kind == "click", "").when(kind != "error", F.concat(F.lit(" "), "tenant"))
    fallback = F.when(kind == "error", "fallback").otherwise("")
    return events(spark, sf).select("n", resolve_tenant(own, fallback).alias("tenant"))


@query("find_event", with_ev("SELECT event_id, source_id, us FROM ev WHERE event_id = '000000000042'"))
def _(spark, sf):
    return V.find_event(events(spark, sf), "000000000042").select("event_id", "source_id", us("timestamp"))


@query("operator_queue", with_ev("SELECT event_id, severity FROM ev WHERE severity IN ('error', 'critical')"))
def _(spark, sf):
    return V.operator_queue(events(spark, sf)).select("event_id", "severity")


@query("role_filter", with_ev("""SELECT event_id FROM ev WHERE severity IN ('warn', 'error', 'critical')
    AND event_type IN ('error', 'purchase') AND starts_with(event_type, 'p')"""))
def _(spark, sf):
    return V.role_filter(events(spark, sf), "warn", ["error", "purchase"], "p").select("event_id")


@query("valid_operator_action", with_ev("""SELECT n, CASE WHEN event_type = 'view' THEN 'event_id, decision_hash and operator_id are required'
    WHEN severity = 'critical' THEN 'action must be accept, override, or annotate' END AS reason FROM ev"""))
def _(spark, sf):
    ev = events(spark, sf)
    actions = ev.select(
        "n", "event_id", F.sha2("event_id", 256).alias("decision_hash"),
        F.when(F.col("event_type") == "view", "").otherwise("op-1").alias("operator_id"),
        F.when(F.col("severity") == "critical", "ignore").when(F.col("severity") == "error", "override").otherwise("accept").alias("action"))
    return V.valid_operator_action(actions).select("n", "reason")


@query("default_severity", """WITH types AS (SELECT lower(n_name) AS name, CASE n_nationkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warn'
    WHEN 2 THEN 'error' ELSE 'critical' END AS sev FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA')
  SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'error' ELSE coalesce(t.sev, 'info') END AS severity
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN types t ON t.name = lower(n_name)""")
def _(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ev = c.select("c_custkey", F.lower("n_name").alias("event_type"), F.when(F.col("c_mktsegment") == "BUILDING", "error").otherwise("").alias("severity"))
    return V.default_severity(ev, packs.pack_event_types(nation_packs(spark, sf))).select("c_custkey", "severity")


SCANNED = with_ev("""SELECT event_id, us FROM ev WHERE us >= 1704844800000000 AND us < 1705536000000000
    AND source_id IN ('user-1', 'user-2', 'user-3', 'user-5', 'user-8') AND severity IN ('info', 'error') AND tenant IN ('tenant-1', 'tenant-3')""")


def scanned(ev):
    out = E.scan_events(
        ev, F.timestamp_seconds(F.lit(1704844800)), F.timestamp_seconds(F.lit(1705536000)),
        sources=["user-1", "user-2", "user-3", "user-5", "user-8"], severities=["info", "error"], tenants=["tenant-1", "tenant-3"])
    return out.select("event_id", us("timestamp"))


@query("scan_events", SCANNED)
def _(spark, sf):
    return scanned(events(spark, sf))


@query("scan_events_clustered", SCANNED)
def _(spark, sf):
    """The same scan over a table laid out by time, source and type."""
    out = shared_folder(spark, "clustered")
    write_clustered(events(spark, sf).select(*EVENT_COLUMNS), out, ["timestamp", "source_id", "event_type"])
    return scanned(spark.read.schema(S.EVENT).parquet(out))


@query("dedup_events", with_ev("SELECT event_id, ingested_us FROM ev"))
def _(spark, sf):
    ev = events(spark, sf)
    again = ev.withColumn("ingested_at", F.timestamp_micros(micros(F.col("ingested_at")) + 60_000_000))
    return R.dedup_events(ev.unionByName(again).unionByName(ev)).select("event_id", us("ingested_at", "ingested_us"))


# --- Order and recency ---------------------------------------------------------------------------------

@query("order_events", with_ev("SELECT event_id, us FROM ev"))
def _(spark, sf):
    return R.order_events(events(spark, sf)).select("event_id", us("timestamp"))


@query("recent_events", with_ev("SELECT event_id, ingested_us FROM ev ORDER BY ingested_us DESC, event_id DESC LIMIT 5000"))
def _(spark, sf):
    return R.recent(events(spark, sf), 5000).select("event_id", us("ingested_at", "ingested_us"))


@query("recent_events_per_tenant", with_ev("""SELECT tenant, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant
    ORDER BY ingested_us DESC, event_id DESC) AS r FROM ev) WHERE r <= 1500"""))
def _(spark, sf):
    return R.recent(events(spark, sf), 1500, by=["tenant"]).select("tenant", "event_id")


@query("feed_order", with_ev(f"SELECT event_id, {rank_sql()} AS severity_rank, us FROM ev"))
def _(spark, sf):
    """The whole table, most severe first; the order itself is covered by a test."""
    return R.feed_order(events(spark, sf)).select("event_id", severity_rank(F.col("severity")).alias("severity_rank"), us("timestamp"))


# --- Statistics --------------------------------------------------------------------------------------------

@query("source_stats", with_ev("""SELECT source_id, count(*) AS events_emitted, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors_seen,
    max(us) AS last_us, round((1706659200000000 - max(us)) / 1000000.0::DOUBLE, 6) AS lag_seconds, (1706659200000000 - max(us)) / 1000000.0 <= 43200 AS healthy FROM ev GROUP BY 1"""))
def _(spark, sf):
    at = F.timestamp_micros(F.lit(1706659200000000))
    st = R.source_stats(events(spark, sf), at, 43200.0, F.col("event_type") == "error")
    return st.select("source_id", "events_emitted", "errors_seen", us("last_event_at", "last_us"), F.round("lag_seconds", 6).alias("lag_seconds"), "healthy")


ESCALATION = """rules AS (SELECT * FROM (VALUES ('error', 2, 86400, 'critical'), ('click', 3, 172800, 'warn'), ('view', 4, 259200, 'error')) t(event_type, cnt, secs, esc))"""


@query("escalate_repeats", with_ev(ESCALATION, *[
    f"""w{i} AS (SELECT event_id, count(*) OVER (PARTITION BY source_id ORDER BY us RANGE BETWEEN {s}000000 PRECEDING AND CURRENT ROW) >= {n} AS hit
    FROM ev WHERE event_type = '{t}')""" for i, (t, n, s) in enumerate([("error", 2, 86400), ("click", 3, 172800), ("view", 4, 259200)])],
    "hits AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)",
    """SELECT e.event_id, CASE WHEN h.hit THEN r.esc ELSE e.severity END AS severity, coalesce(h.hit, FALSE) AS escalated
    FROM ev e LEFT JOIN hits h ON e.event_id = h.event_id LEFT JOIN rules r ON r.event_type = e.event_type"""))
def _(spark, sf):
    rules = spark.createDataFrame(
        [("error", 2, 86400, "critical"), ("click", 3, 172800, "warn"), ("view", 4, 259200, "error"),
         ("error", 7, 10, "warn"), ("click", 3, 999999, "error")],  # a second pack names two of the types
        "name string, escalate_after_count int, escalate_within_seconds int, escalated_severity string")
    return R.escalate_repeats(events(spark, sf), rules).select("event_id", "severity", "escalated")
