"""The change-log source: splits, offsets, restarts, and files that do not fit."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auditweave.sources import changes as CH
from auditweave.sources import connector as C


def land(root, split, name, values):
    path = root / split / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{v}\n" for v in values))


def drain(spark, root, out, checkpoint):
    q = (C.read_change_log(spark, str(root), stream=True).withColumn("part", F.spark_partition_id()).writeStream.format("parquet").option("path", str(out))
         .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def values(spark, out):
    return sorted(r["value"] for r in spark.read.parquet(str(out)).collect())


def test_a_table_of_all_splits(spark, tmp_path):
    land(tmp_path / "log", "a", "bin.000001", ["1", "2"])
    land(tmp_path / "log", "a", "bin.000002", ["", "é"])
    land(tmp_path / "log", "b", "day=1/x", [f"x{i}" for i in range(25_000)])
    land(tmp_path / "log", "b", "_SUCCESS", ["no"])
    land(tmp_path / "log", "c", ".hidden", ["no"])
    log = C.read_change_log(spark, str(tmp_path / "log"))
    assert sorted((r["split"], r["file"], r["n"], r["last"]) for r in log.groupBy("split", "file").agg(F.count("*").alias("n"), F.max("line").alias("last")).collect()) == [
        ("a", "bin.000001", 2, 1), ("a", "bin.000002", 2, 1), ("b", "day=1/x", 25_000, 24_999)]
    assert log.rdd.getNumPartitions() == 3
    assert C.read_change_log(spark, str(tmp_path / "log"), files_per_partition=2).rdd.getNumPartitions() == 2
    assert C.read_change_log(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_behind_its_offsets(spark, tmp_path):
    root, out, cp = tmp_path / "log", tmp_path / "out", tmp_path / "cp"
    land(root, "a", "bin.000001", ["a1"])
    land(root, "b", "bin.000001", ["b1", "b2"])
    stats = C.connector_stats(drain(spark, root, out, cp))
    assert stats["events_emitted"] == 3 and stats["healthy"] and stats["offsets"] == {
        "a": {"file": "bin.000001", "files": 1}, "b": {"file": "bin.000001", "files": 1}}
    assert spark.read.parquet(str(out)).select("part").distinct().count() == 2
    land(root, "a", "bin.000002", ["a2"])
    land(root, "c", "bin.000007", ["c1"])  # a split that was not there before
    assert C.connector_stats(drain(spark, root, out, cp))["events_emitted"] == 2
    assert C.connector_stats(drain(spark, root, out, cp))["events_emitted"] == 0
    assert values(spark, out) == ["a1", "a2", "b1", "b2", "c1"]


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    root, cp, seen = tmp_path / "log", str(tmp_path / "cp"), []
    land(root, "a", "bin.000001", ["a1"])

    def run(fail):
        def apply(batch, batch_id):
            seen.append((batch_id, sorted(r["value"] for r in batch.collect())))
            if fail:
                raise RuntimeError("lost")

        q = C.read_change_log(spark, str(root), stream=True).writeStream.foreachBatch(apply).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(True)
    land(root, "a", "bin.000002", ["a2"])  # lands meanwhile: not part of the batch that is read again
    run(False)
    run(False)
    assert seen == [(0, ["a1"]), (0, ["a1"]), (1, ["a2"])]


def test_files_behind_the_offset_raise(spark, tmp_path):
    root = tmp_path / "log"
    land(root, "a", "bin.000005", ["a5"])
    drain(spark, root, tmp_path / "out", tmp_path / "cp")
    land(root, "a", "bin.000004", ["a4"])
    land(root, "a", "bin.000006", ["a6"])
    with pytest.raises(StreamingQueryException, match="do not fit its offset"):
        drain(spark, root, tmp_path / "out", tmp_path / "cp")


def test_changes_become_events(spark, tmp_path):
    change = dict(schema="s", table="t", action="update", header_ts=1, log_file="bin.000001", log_pos=4, rows=[[1, "a"], [1, "b"]])
    land(tmp_path / "log", "a", "bin.000001", [json.dumps(change), "no json"])
    decoded = C.decode_changes(C.read_change_log(spark, str(tmp_path / "log")))
    assert [(r["line"], r["reason"]) for r in decoded.where("reason is not null").collect()] == [(1, "bad json")]
    [ev] = CH.normalize_mysql_changes(decoded.where("reason is null"), F.col("split")).collect()
    assert (ev["source_id"], ev["event_type"], json.loads(ev["payload"])["after"]) == ("a", "mysql.row.update", [1, "b"])
