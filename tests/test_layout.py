"""Clustered tables: the same rows, fewer files for a filter on any of the columns."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.sources import events as E
from auditweave.sources.layout import interleaved, range_number, write_clustered
from tests.event_rows import T0, at, event, make_events


def files_for(path, column, low, high):
    """Files whose statistics do not rule out values of ``column`` between ``low`` and ``high``."""
    found = files = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        files += 1
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        stats = [g.column(i).statistics for g in groups for i in range(g.num_columns) if g.column(i).path_in_schema == column]
        found += any(s is None or not s.has_min_max or (s.min <= high and s.max >= low) for s in stats)
    return found, files


def many(spark):
    """20,000 events; a third of them of one source."""
    n = F.col("id")
    source = F.when(n % 3 == 0, "s0000").otherwise(F.format_string("s%04d", F.pmod(F.xxhash64("id"), F.lit(900)).cast("int")))
    kind = F.format_string("k%02d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("int"))
    like = make_events(spark, [event(0, "s", 0)]).drop("event_id", "source_id", "event_type", "timestamp")
    return spark.range(20_000).select(
        F.format_string("e%05d", n).alias("event_id"), source.alias("source_id"), kind.alias("event_type"),
        F.timestamp_seconds(F.lit(int(T0.timestamp())) + n).alias("timestamp"),
    ).crossJoin(F.broadcast(like)).select(*S.EVENT.fieldNames())


def test_filters_on_each_column_read_few_files(spark, tmp_path):
    ev, by_time, clustered = many(spark), str(tmp_path / "time"), str(tmp_path / "clustered")
    ev.repartitionByRange(64, "timestamp").write.parquet(by_time)
    write_clustered(ev, clustered, ["timestamp", "source_id", "event_type"], files=64)
    for column, low, high in [("source_id", "s0700", "s0700"), ("event_type", "k07", "k07")]:
        assert files_for(by_time, column, low, high) == (64, 64)
        found, files = files_for(clustered, column, low, high)
        assert found <= files / 2, (column, found, files)
    found, files = files_for(clustered, "timestamp", at(5000), at(5010))
    assert found <= files / 2
    back = spark.read.schema(S.EVENT).parquet(clustered)
    assert back.exceptAll(ev).isEmpty() and back.count() == 20_000
    for options in [dict(sources=["s0700"]), dict(event_types=["k07"]), dict(start=at(5000), end=at(5010))]:
        wanted = sorted(r["event_id"] for r in E.scan_events(ev, **options).collect())
        assert wanted and sorted(r["event_id"] for r in E.scan_events(back, **options).collect()) == wanted


def test_rows_that_agree_are_spread_and_nulls_kept(spark, tmp_path):
    same = [event(i, "s", 0) for i in range(400)]
    nothing = [(None,) * len(S.EVENT)] * 3
    write_clustered(make_events(spark, same + nothing), str(tmp_path / "t"), ["timestamp", "source_id"], files=4)
    back = spark.read.schema(S.EVENT).parquet(str(tmp_path / "t"))
    sizes = [r[0] for r in back.groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(sizes) == 403 and max(sizes) < 250 and back.where("event_id IS NULL").count() == 3
    write_clustered(make_events(spark, []), str(tmp_path / "empty"), ["timestamp"])
    assert spark.read.schema(S.EVENT).parquet(str(tmp_path / "empty")).count() == 0
    with pytest.raises(ValueError):
        write_clustered(back, str(tmp_path / "wide"), ["source_id"] * 11)


def test_key_interleaves_range_numbers(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "x string, y int")
    key = interleaved([range_number("x", ["b", "c"]), range_number("y", [1, 2, 3])], 2)
    # x, y as numbers: (0, 1), (1, 2), (2, 0)
    assert [r[0] for r in rows.select(key).collect()] == [0b0001, 0b0110, 0b1000]


def test_times_have_statistics(spark, tmp_path):
    make_events(spark, [event(1, "s", 7)]).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert files_for(str(tmp_path / "t"), "timestamp", at(0), at(6)) == (0, 1)
    assert files_for(str(tmp_path / "t"), "timestamp", at(7), at(7) + dt.timedelta(seconds=1)) == (1, 1)


def test_range_number_counts_cuts_not_above_the_value(spark):
    for cuts in ([5], [1, 1, 4], [2, 2, 2, 3, 9, 9, 11], list(range(0, 126, 2))):
        rows = spark.createDataFrame([(v,) for v in [None, *range(-1, 130)]], "x int").select("x", range_number("x", cuts))
        assert [n for _, n in rows.collect()] == [0 if x is None else sum(c <= x for c in cuts) for x, _ in rows.collect()]


def test_key_is_computed_once_per_row(spark, tmp_path):
    """Nothing is computed while rows are compared: the sort and the ranges are over plain columns."""
    ev = make_events(spark, [event(i, f"s{i}", i) for i in range(300)])
    plans = []
    layout_sort = ev.__class__.sortWithinPartitions
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ev.__class__, "sortWithinPartitions", lambda df, *by, **k: plans.append(out := layout_sort(df, *by, **k)) or out)
        write_clustered(ev.withColumn("_cell", F.lit(1)), str(tmp_path / "t"), ["timestamp", "source_id"], files=4)
    ordered = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in ordered.splitlines() if "Sort [" in x or "RepartitionByExpression" in x]
    assert len(lines) == 2 and not any("lambda" in x or "aggregate(" in x or "filter(" in x for x in lines)
    assert spark.read.parquet(str(tmp_path / "t")).columns == [*S.EVENT.fieldNames(), "_cell"]
