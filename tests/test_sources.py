"""Decoding, change normalisation, webhooks, packs and writers."""

import json

import pytest
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import render_binary, rfc3339, severity_rank
from auditweave.operators import reports as R
from auditweave.operators import validate as V
from auditweave.sources import changes as CH
from auditweave.sources import events as E
from auditweave.sources import packs, sinks, webhooks
from tests.event_rows import at, event, make_events


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


GOOD = {"event_id": "e1", "source_id": "s", "source_type": "kafka", "event_type": "t", "severity": "warn",
        "timestamp": "2024-01-01T00:00:01.5Z", "ingested_at": "2024-01-01T00:00:02Z", "payload": {"a": [1, 2]},
        "metadata": {"schema_version": "1.0.0", "tenant_id": "x"}}


@pytest.mark.parametrize("change,why", [
    ({}, None), ({"event_id": ""}, "event_id required"), ({"source_id": ""}, "source_id required"),
    ({"source_type": ""}, "source_type required"), ({"event_type": None}, "event_type required"),
    ({"severity": ""}, "severity required"), ({"severity": "bogus"}, 'unknown severity "bogus"'),
    ({"timestamp": None}, "timestamp required"), ({"metadata": {}}, "metadata.schema_version required"),
    ({"timestamp": "yesterday"}, "bad json"),
])
def test_first_failure_is_reported(spark, change, why):
    assert E.decode_events(messages(spark, json.dumps(GOOD | change))).first()["reason"] == why


def test_broken_messages_are_skipped(spark):
    got = E.read_events(messages(spark, "{oops", "5", "null", "", json.dumps(GOOD)))
    assert [r["event_id"] for r in got.collect()] == ["e1"]


@pytest.mark.parametrize("payload", [{"a": [1, 2]}, "text", "5", '{"k":1}', 5, [1], None, True])
def test_payload_round_trip(spark, payload):
    """Message -> event -> message keeps the payload's JSON value and type."""
    ev = E.read_events(messages(spark, json.dumps(GOOD | {"payload": payload})))
    again = json.loads(sinks.event_messages(ev).first()["value"])
    assert again["payload"] == payload and again["timestamp"] == GOOD["timestamp"]


def test_awkward_text_stays_valid_json(spark):
    ev = make_events(spark, [event(1, 'a"b\\c\n', 0, event_type="t\tü")])
    back = json.loads(sinks.event_messages(ev).first()["value"])
    assert back["source_id"] == 'a"b\\c\n' and back["event_type"] == "t\tü"


def test_rfc3339_forms(spark):
    df = spark.createDataFrame([(at(0),), (at(0.5),), (at(86399.000001),)], "t timestamp")
    assert [r[0] for r in df.select(rfc3339(F.col("t"))).collect()] == [
        "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5Z", "2024-01-01T23:59:59.000001Z"]


def test_severity_ranks(spark):
    df = spark.createDataFrame([(s,) for s in ("info", "warn", "error", "critical", "bogus", None)], "s string")
    assert [r[0] for r in df.select(severity_rank(F.col("s"))).collect()] == [0, 1, 2, 3, -1, -1]


def test_audit_inputs(spark):
    got = E.read_audit_inputs(messages(spark, '{"kind":"x","payload":{"a":1}}', '{"payload":"t"}', '{"kind":"","payload":3}', "no"))
    assert [(r["kind"], r["payload"]) for r in got.collect()] == [("x", '{"a":1}'), ("unknown", '"t"'), ("unknown", "3")]


CHANGE = "schema string, table string, action string, header_ts long, log_file string, log_pos long, rows array<string>"


def test_row_changes(spark):
    df = spark.createDataFrame([
        ("db1", "t1", "insert", 1700000000, "bin.1", 99, ['[1,"a"]', "[2]"]), ("db", "t", "delete", 1700000000, "bin.1", 100, ["[2]"]),
        ("db", "t", "update", 0, "bin.1", 101, ['[1,"old"]', '[1,"new"]']), ("db", "t", "update", 5, "bin.1", 102, ["[1]"]),
        ("db", "t", "update", 5, "bin.1", 103, []), ("db", "t", "truncate", 5, "bin.1", 104, ["[1]"])], CHANGE)
    got = CH.normalize_mysql_changes(df, F.lit("src"), F.lit(at(7))).collect()
    assert sorted((r["event_type"], r["severity"]) for r in got) == [
        ("mysql.row.delete", "warn"), ("mysql.row.insert", "info"), ("mysql.row.insert", "info"), ("mysql.row.update", "info")]
    up = next(r for r in got if r["event_type"] == "mysql.row.update")
    assert json.loads(up["payload"]) == {"action": "update", "after": [1, "new"], "before": [1, "old"], "database": "db", "table": "t",
                                          "binlog": {"binlog_file": "bin.1", "binlog_position": 101}}
    assert up["timestamp"] == at(7).replace(tzinfo=None) and len({r["event_id"] for r in got}) == 4
    assert [r["log_pos"] for r in CH.check_mysql_changes(df).where("reason is not null").collect()] == [102]


def test_names_and_binary_values_of_changes(spark):
    odd = 'odd"na\\me\n'
    df = spark.createDataFrame([(odd, None, "insert", 5, "b\"in", None, [[b"a\"b", None, b"\x00\x01", b""]])],
                               CHANGE.replace("array<string>", "array<array<binary>>"))
    got = json.loads(CH.normalize_mysql_changes(df, F.lit("s")).first()["payload"])
    assert got == {"action": "insert", "binlog": {"binlog_file": 'b"in', "binlog_position": None}, "database": odd, "table": None, "row": ['a"b', None, "AAE=", ""]}
    pg = spark.createDataFrame([("insert", odd, None, "[1]", None, 7)], "op string, schema string, table string, new_tuple string, old_tuple string, lsn long")
    assert json.loads(CH.normalize_postgres_changes(pg, F.lit("s")).first()["payload"]) == {"columns": [1], "op": "insert", "schema": odd, "table": None}


def test_relations_have_the_name_of_their_time(spark):
    rel = spark.createDataFrame([(1, "s", "old", 10), (1, "s", "new", 20), (2, "s", "other", 5)], "relation_id int, schema string, table string, lsn long")
    ch = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (1, 99), (2, 99), (3, 99)], "relation_id int, lsn long")
    got = sorted((r["relation_id"], r["lsn"], r["table"]) for r in CH.resolve_relations(ch, rel).collect())
    assert got == [(1, 10, "old"), (1, 19, "old"), (1, 20, "new"), (1, 99, "new"), (2, 99, "other")]


def test_ids_keep_nulls_and_separators_apart(spark):
    from auditweave.functions.columns import replay_safe_id
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a~b", None, None), ("a", "~b", None)], "x string, y string, z string")
    assert df.select(replay_safe_id(*[F.col(c) for c in "xyz"]).alias("i")).distinct().count() == 4


def test_feed_order(spark):
    ev = make_events(spark, [event(1, "s", 5, "info"), event(2, "s", 1, "error"), event(3, "s", 9, "error"), event(4, "s", 9, "error")])
    assert [r["event_id"] for r in R.feed_order(ev).collect()] == ["e00003", "e00004", "e00002", "e00001"]


def test_table_filter_ignores_case(spark):
    df = spark.createDataFrame([("shop", "orders"), ("SHOP", "Items"), ("shop", "users")], "schema string, table string")
    assert CH.filter_tables(df, [" Shop.ORDERS", "shop.items "]).count() == 2
    assert CH.filter_tables(df, []).count() == 3


def test_binary_rendering(spark):
    df = spark.createDataFrame([(b"",), (b"text\t\n",), (b"\x00\x01",), (None,), (b"\x01" * 100,)], "b binary")
    got = [r[0] for r in df.select(render_binary(F.col("b"))).collect()]
    import base64
    assert got == ["", "text\t\n", "AAE=", None, base64.b64encode(b"\x01" * 100).decode()]


def test_webhooks(spark):
    body = {"source_id": "s", "event_type": "t"}
    got = webhooks.decode_webhooks(messages(
        spark, json.dumps(body), json.dumps(body | {"severity": "error", "payload": {"x": 1}, "timestamp": "2024-01-01T02:00:00+01:00"}),
        json.dumps({"source_id": "s"}), json.dumps(body | {"severity": "loud"}), "{"), F.lit(at(9))).collect()
    assert [r["reason"] for r in got] == [None, None, "source_id and event_type required", 'unknown severity "loud"', "bad json"]
    assert (got[0]["severity"], got[0]["payload"], got[0]["timestamp"]) == ("info", "{}", at(9).replace(tzinfo=None))
    assert (got[1]["severity"], got[1]["payload"], got[1]["timestamp"]) == ("error", '{"x":1}', at(3600).replace(tzinfo=None))


def test_packs(spark, tmp_path):
    rows = [{"path": "p/a", "name": "", "instruction": "Do.", "roles": [{"name": "r", "curation_strategy": 4, "diversity_percent": 80.0, "digest_size": 20}],
             "event_types": [{"name": "x", "default_severity": "warn"}]}, {"path": "p/b", "name": "b", "roles": [{"name": "q"}]}]
    f = tmp_path / "packs.json"
    f.write_text("\n".join(json.dumps(r) for r in rows))
    table = packs.read_packs(spark, str(f))
    assert [(r["pack"], r["name"]) for r in packs.pack_roles(table).collect()] == [("p/a", "r")]
    assert [(r["pack"], r["instruction"]) for r in packs.pack_instructions(table).collect()] == [("p/a", "Do.")]
    ev = make_events(spark, [event(1, "s", 0, severity="", event_type="x"), event(2, "s", 0, severity="", event_type="y"), event(3, "s", 0, "error", "x")])
    filled = V.default_severity(ev, packs.pack_event_types(table)).orderBy("event_id").collect()
    assert [r["severity"] for r in filled] == ["warn", "info", "error"]


def test_hot_table_prunes_partitions(spark, tmp_path):
    ev = make_events(spark, [event(i, f"s{i % 3}", i * 3600, tenant="t") for i in range(72)])
    path = str(tmp_path / "hot")
    sinks.write_hot_events(ev, path)
    out = E.scan_events(spark.read.parquet(path), at(86400), at(90000), sources=["s0", "s1"], tenants=["t"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    filters = {k: plan.split(f"{k}: [")[1].split("]")[0] for k in ("PartitionFilters", "PushedFilters")}
    assert "event_date" in filters["PartitionFilters"] and "source_id" in filters["PushedFilters"]
    assert [r["event_id"] for r in out.collect()] == ["e00024"]


def test_escalation(spark):
    ev = make_events(spark, [event(i, "s1", t, "warn", "x") for i, t in enumerate([0, 100, 250, 400, 5000, 5001])] + [event(90, "s2", 101, "warn", "x")])
    rules = spark.createDataFrame([("x", "warn", 3, 300, "error")], "name string, default_severity string, escalate_after_count int, escalate_within_seconds int, escalated_severity string")
    got = R.escalate_repeats(ev, rules)
    assert sorted(r["event_id"] for r in got.where("escalated").collect()) == ["e00002", "e00003"]
    assert got.count() == 7 and got.where("severity = 'error'").count() == 2
    # The type also stands in a second pack: one rule counts, and no event comes out twice.
    twice = R.escalate_repeats(ev, rules.unionByName(rules.withColumn("escalate_after_count", F.lit(9))))
    assert sorted(map(str, twice.collect())) == sorted(map(str, got.collect()))
    many = rules.crossJoin(spark.range(2000).withColumnRenamed("id", "i")).withColumn("name", F.when(F.col("i") == 0, "x").otherwise(F.concat(F.lit("t"), F.col("i"))))
    assert R.escalate_repeats(ev, many.drop("i")).where("escalated").count() == 2
    bare = ev.withColumn("source_id", F.when(F.col("event_id") != "e00002", F.col("source_id"))).withColumn(
        "timestamp", F.when(F.col("event_id") != "e00003", F.col("timestamp")))
    kept = R.escalate_repeats(bare, rules)
    assert kept.count() == ev.count() and not kept.where("source_id is null or timestamp is null").where("escalated").count()


def test_dedup_keeps_the_first_arrival(spark):
    ev = make_events(spark, [event(1, "s", 0, ingested=9), event(1, "s", 0, ingested=4), event(2, "s", 1)])
    got = {r["event_id"]: r["ingested_at"] for r in R.dedup_events(ev).collect()}
    assert got["e00001"] == at(4).replace(tzinfo=None) and len(got) == 2


def test_dates_before_1970_and_strict_schema(spark):
    df = make_events(spark, [event(1, "s", -1704067201.5)])
    assert df.select(rfc3339(F.col("timestamp"))).first()[0] == "1969-12-31T23:59:58.5Z"
    ok = V.validate_events_strict(df, F.lit(json.dumps(GOOD))).first()["reason"]
    bad = V.validate_events_strict(df, F.lit(json.dumps(GOOD | {"extra": 1}))).first()["reason"]
    assert (ok, bad) == (None, "unknown field") and S.SEVERITIES[0] == "info"
