"""Events delivered again, however late: an exact memory of the ids let through, for as long as a retention says.

The ids of the newest batches are read from what those batches wrote. Every so many batches they become a *segment*: the
ids in buckets by hash, and a Bloom filter in blocks, one bitmap of Spark's own bitmap functions each. A batch asks the
filters first and reads only the buckets of the ids that may be there, so old segments cost their filters (27 bits an id)
and not their ids. What the filters let through is compared with the ids themselves. Segments are never written again;
those whose ids are all older than the retention are not read any more.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditweave.operators.reports import dedup_events
from auditweave.streaming.jobs import batch_dir, batches_before, claim, newest_time, run, write_batch, written_batches

BITS = 32_768  # fixed: a bitmap of Spark's bitmap functions
BLOCK_IDS = 1_200  # ids per bitmap on average
PROBES = 8  # bits per id: at 27 bits an id about 2 of 100,000 ids are taken for seen ones and looked up
BUCKETS = 64


def bucket_of() -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int")


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "event_id"), blocks)


def probe(i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), "event_id"), F.lit(BITS))


def bit_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), position % 8)), F.lit(2)) == 1


def id_filters(ids: DataFrame, blocks: int) -> DataFrame:
    """Bloom filter of ``event_id`` as (block, bits); partial bitmaps are merged before the shuffle."""
    bits = ids.select(block_of(F.lit(blocks)).alias("block"), F.explode(F.array(*[probe(i) for i in range(PROBES)])).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_seen(ids: DataFrame, filters: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """(event_id, segment, bucket) of the ids that the filters of ``segments`` (id, blocks) cannot rule out.

    ``filters`` has (segment, block, bits). Every id that is in a segment comes out for it.
    """
    places = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(n).cast("long").alias("blocks")) for s, n in segments]))
    asked = ids.select("event_id", places.alias("place")).select("event_id", "place.segment", block_of(F.col("place.blocks")).alias("block"))
    there = reduce(Column.__and__, [bit_set(F.col("bits"), probe(i)) for i in range(PROBES)])
    return asked.join(filters, ["segment", "block"]).where(there).select("event_id", "segment", bucket_of().alias("bucket"))


def remembered(from_day: Column) -> Column:
    """Ids without any time are remembered as long as their segment is."""
    return F.coalesce(F.col("day") >= from_day, F.lit(True))


def seen_ids(rows: DataFrame) -> DataFrame:
    day = F.to_date(F.coalesce("ingested_at", "timestamp"))
    return rows.where(F.col("event_id").isNotNull()).select("event_id", day.alias("day"))


def read_taken(spark: SparkSession, out: str, batches: list[int]) -> DataFrame:
    """Ids that these batches let through, from their output."""
    if not batches:
        return spark.createDataFrame([], "event_id string, day date")
    fields = "event_id string, timestamp timestamp, ingested_at timestamp"
    return seen_ids(spark.read.schema(fields).parquet(*[batch_dir(f"{out}/events", b) for b in batches]))


def ask_filters(spark: SparkSession, out: str, ids: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    filters = spark.read.schema("batch_id int, block long, bits binary").option("basePath", f"{out}/filters")
    filters = filters.parquet(*[batch_dir(f"{out}/filters", s) for s, _ in segments])
    return maybe_seen(ids, filters.withColumnRenamed("batch_id", "segment"), segments)


def stored_hits(spark: SparkSession, out: str, maybe: DataFrame, from_day: Column) -> DataFrame:
    """The ids of ``maybe`` that are in their segment; only the buckets it names are read (at most 64 a segment)."""
    touched: dict[int, list[int]] = {}
    for segment, bucket in maybe.select("segment", "bucket").distinct().collect():
        touched.setdefault(segment, []).append(bucket)
    if not touched:
        return maybe.select("event_id").limit(0)
    stored = spark.read.schema("event_id string, day date, batch_id int, bucket int").option("basePath", f"{out}/segments")
    stored = stored.parquet(*[batch_dir(f"{out}/segments", s) for s in touched])
    places = reduce(Column.__or__, [(F.col("batch_id") == s) & F.col("bucket").isin(b) for s, b in touched.items()])
    stored = stored.where(places & remembered(from_day)).withColumnRenamed("batch_id", "segment").drop("day", "bucket")
    return maybe.join(stored, ["event_id", "segment"], "left_semi").select("event_id")


def write_segment(spark: SparkSession, out: str, ids: DataFrame, batch_id: int) -> None:
    """Ids by bucket, their filters, and last the mark that makes the segment count."""
    write_batch(ids.withColumn("bucket", bucket_of()).repartition("bucket"), f"{out}/segments", batch_id, ["bucket"])
    total, newest = ids.agg(F.count(F.lit(1)), F.max("day")).first()
    blocks = max(1, -(-total // BLOCK_IDS))
    write_batch(id_filters(ids, blocks), f"{out}/filters", batch_id)
    mark = spark.createDataFrame([(batch_id, blocks, newest)], "segment int, blocks long, newest date")
    write_batch(mark.coalesce(1), f"{out}/marks", batch_id)


def seen_batch(out: str, retain_days: int = 30, segment_every: int = 20) -> Callable[[DataFrame, int], None]:
    """Batch function: the first delivery of every id to ``{out}/events``.

    An id is known if an earlier batch let it through with an arrival (``ingested_at``, else ``timestamp``) at most
    ``retain_days`` days before the newest arrival of the earlier batches; within a batch always. Rows without an id are
    all let through. An id that comes again after the retention is let through and known anew.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        batch = batch.persist()
        before, _ = newest_time(spark, out, batch, batch_id, "ingested_at")
        from_day = F.date_sub(F.to_date(F.timestamp_micros(before)), retain_days)
        done = batches_before(f"{out}/events", written_batches(spark, f"{out}/events"), batch_id)
        marks = [b for b in written_batches(spark, f"{out}/marks") if b < batch_id]
        open_ = [b for b in done if not marks or b > marks[-1]]
        named = F.col("event_id").isNotNull()
        first = dedup_events(batch.where(named))
        ids = first.select("event_id")
        known = read_taken(spark, out, open_).where(remembered(from_day)).select("event_id")
        maybe = None
        if marks:
            rows = spark.read.schema("segment int, blocks long, newest date").parquet(*[batch_dir(f"{out}/marks", b) for b in marks])
            live = rows.where(F.coalesce(F.col("newest") >= from_day, F.lit(True))).orderBy("segment").collect()
            if live:
                maybe = ask_filters(spark, out, ids, [(r.segment, r.blocks) for r in live]).persist()
                known = known.unionByName(stored_hits(spark, out, maybe, from_day))
        fresh = first.join(known, "event_id", "left_anti").select(*batch.columns)
        write_batch(fresh.unionByName(batch.where(~named)), f"{out}/events", batch_id)
        if batch_id % segment_every == segment_every - 1:
            write_segment(spark, out, read_taken(spark, out, [*open_, batch_id]), batch_id)
        if maybe is not None:
            maybe.unpersist()
        batch.unpersist()

    return apply


def stream_first_deliveries(events: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(events, seen_batch(out, **options), checkpoint, every)
