"""Structured Streaming jobs.

Each job is one ``foreachBatch`` query whose batch function reuses the batch operators. Outputs carry the
batch id in their directory, and a directory is overwritten when a batch is run again after a failure,
so every batch takes effect once.
"""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from auditweave import schema as S
from auditweave.functions.columns import micros, normalize_tenant, resolve_tenant
from auditweave.operators import alerts as A
from auditweave.operators import chain, curate, decide, precedents
from auditweave.sources import sinks
from auditweave.sources.events import decode_events


AUDIT_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.AUDIT)

# --- Plumbing ------------------------------------------------------------------


def run(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start ``fn`` on every micro-batch; with ``every`` on a timer, else until the input is drained."""
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def batch_dir(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Write one batch's rows; a rerun of the batch replaces them."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(batch_dir(path, batch_id))


#: Files a task writes at once before it sorts what is left by folder.
OPEN_FILES = 4


@contextmanager
def open_files(spark: SparkSession, n: int = OPEN_FILES) -> Iterator[None]:
    """Tasks write up to ``n`` folders at once; only rows of further ones are sorted by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_folded(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's chained records by tenant, without a second sort beside the one before the fold.

    Folded rows come tenant by tenant; Spark, which does not know, would sort them again by folder. A task with more
    tenants than ``OPEN_FILES`` still does so for the others.
    """
    with open_files(df.sparkSession):
        write_batch(df, path, batch_id, ["tenant"])


def written_batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches that were committed under ``path`` (a finished write leaves its marker)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    done = [p for p in found if p.getName().startswith("batch_id=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch_id=")) for p in done)


def read_state(spark: SparkSession, path: str, schema: str | StructType, batch_id: int) -> DataFrame:
    """State left by the newest batch before this one; empty for the first batch.

    Every batch writes its whole (small) state, so one directory is read whatever the age of the stream, and a rerun starts from the same state. State that does not fit the batch is an error, never an empty
    start: later batches under ``path`` mean that a new or older checkpoint writes over an existing output, and none
    before a batch other than the first means that the state was lost.
    """
    before = batches_before(path, written_batches(spark, path), batch_id)
    if not before:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_dir(path, before[-1]))


def batches_before(path: str, known: list[int], batch_id: int) -> list[int]:
    """The batches before this one; an error where they do not fit it."""
    if known and known[-1] > batch_id:
        raise ValueError(f"{path} already holds batch {known[-1]}, yet batch {batch_id} is run: use the checkpoint that wrote it, or a new folder")
    before = [b for b in known if b < batch_id]
    if batch_id and not before:
        raise ValueError(f"no state under {path} before batch {batch_id}")
    return before


def read_changes(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """State kept by ``write_changes``: the newest whole state before this batch and what was added after it.

    Rows are only ever added; the reader leaves out those that no longer count by a condition of its own (a time, a
    rank). Errors as in ``read_state``.
    """
    whole, added = written_batches(spark, f"{path}/whole"), written_batches(spark, f"{path}/added")
    before = batches_before(path, sorted({*whole, *added}), batch_id)
    if not before:
        return spark.createDataFrame([], schema)
    start = max((b for b in whole if b < batch_id), default=None)
    parts = [] if start is None else [batch_dir(f"{path}/whole", start)]
    parts += [batch_dir(f"{path}/added", b) for b in added if b < batch_id and (start is None or b > start)]
    return spark.read.schema(schema).parquet(*parts)


def write_changes(added: DataFrame, state: DataFrame, path: str, batch_id: int, every: int, whole: bool = False) -> None:
    """Write what a batch adds to a state, or, every so many batches (and on demand), the ``state`` that still counts.

    So a batch writes as much as it adds, and reads at most ``every`` small folders beside one whole state. Which of the
    two is written depends on the batch id alone, so a rerun replaces what it wrote before.
    """
    if whole or batch_id % every == every - 1:
        write_batch(state, f"{path}/whole", batch_id)
    else:
        write_batch(added, f"{path}/added", batch_id)


def claim(spark: SparkSession, out: str, batch_id: int) -> None:
    """Refuse to write under a folder that another streaming query has begun.

    The query's id lives in its checkpoint, so a query started with a fresh checkpoint has another one.
    """
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if query is None:  # called outside a stream
        return
    owner = f"{out}/owner"
    if path_exists(spark, owner):
        known = spark.read.text(owner).first()
        if known is None or known[0] != query:
            raise ValueError(f"{out} belongs to another query; restart with its checkpoint, or use a new folder")
        return
    if batch_id:
        raise ValueError(f"{out} has no owner, yet batch {batch_id} is run")
    spark.createDataFrame([(query,)], "id string").coalesce(1).write.text(owner)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def move_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Give a folder another path; false if there is no such folder."""
    if not path_exists(spark, source):
        return False
    old, new = spark._jvm.org.apache.hadoop.fs.Path(source), spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")
    return True


def batch_time(spark: SparkSession, out: str, batch_id: int) -> Column:
    """The time of a batch: taken once and stored, so that a rerun and all its outputs agree."""
    path = batch_dir(f"{out}/times", batch_id)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)
    return F.lit(spark.read.schema("at timestamp").parquet(path).select(micros(F.col("at"))).first()[0])


# --- Curate ------------------------------------------------------------------------


def still_shown(shown: DataFrame, from_us: Column) -> DataFrame:
    """Ids shown at or after ``from_us``, each with its last time; older ones leave the suppression set."""
    last = shown.groupBy("event_id").agg(F.max("shown_at").alias("shown_at"))
    return last.where(micros(F.col("shown_at")) >= from_us)


def curate_batch(
    out: str, strategy: int = S.DEFAULT_STRATEGY, k: int = S.BATCH_K, by: Sequence[str] = (),
    window: str | None = None, delay_seconds: float = 30.0, suppress_seconds: float = S.SUPPRESSION_SECONDS,
    flush_at: int | None = None, compact_every: int = 20, **options,
) -> Callable[[DataFrame, int], None]:
    """Batch function: digests under ``{out}/digests``, suppressed ids under ``{out}/shown``.

    A batch writes the ids and waiting rows that it adds; every ``compact_every`` batches the state that still counts is
    written anew (``write_changes``).

    Without ``window`` the micro-batch is the window: one digest per group of it, none for an empty batch, at the
    batch's stored time.

    With ``window`` (for example ``"5 seconds"``) a digest covers one event-time window, whole: rows wait under
    ``{out}/waiting`` until the watermark (newest time seen minus ``delay_seconds``) passes the window's end, and are
    selected once. Rows that come after that, and rows without a time, go to ``{out}/late``. ``flush_windows`` closes what waits when a stream is
    over (it runs one more batch, ``flush_at``, that takes every window as closed). A selected event is suppressed while
    its window ended less than ``suppress_seconds`` ago.
    """
    shown_schema = "event_id string, shown_at timestamp"

    def write_digests(rows: DataFrame, keys: list[str], shown: DataFrame, end: Column, batch_id: int, from_us: Column) -> None:
        # the selection feeds the digest, its scores and the new shown ids
        picked = curate.select_events(rows, strategy, k, keys, shown, **options).persist()
        scores = curate.digest_scores(picked, rows, keys, shown)
        write_batch(curate.digest_records(picked, scores, strategy, keys, end), f"{out}/digests", batch_id)
        add_shown(shown, picked.select("event_id", end.alias("shown_at")), batch_id, from_us)
        picked.unpersist()

    def add_shown(shown: DataFrame, added: DataFrame, batch_id: int, from_us: Column) -> None:
        write_changes(added, still_shown(shown.unionByName(added), from_us), f"{out}/shown", batch_id, compact_every)

    def span(seconds: float) -> Column:
        return F.lit(int(seconds * 1_000_000))

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        shown = read_changes(spark, f"{out}/shown", shown_schema, batch_id)
        nothing = spark.createDataFrame([], shown_schema)
        batch = batch.persist()
        if window is None:
            now = batch_time(spark, out, batch_id)
            from_us = now - span(suppress_seconds)
            shown = still_shown(shown, from_us)
            if batch.isEmpty():
                add_shown(shown, nothing, batch_id, from_us)
            else:
                write_digests(batch, list(by), shown, F.timestamp_micros(now), batch_id, from_us)
            batch.unpersist()
            return
        timed = batch.where(F.col("timestamp").isNotNull())
        windowed = timed.withColumn("window_end", F.window("timestamp", window)["end"])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windowed.schema)
        before, now = newest_time(spark, out, batch, batch_id)
        end = micros(F.col("window_end"))
        # null before the first row: nothing is late or closed then
        past = F.coalesce(end <= before - span(delay_seconds), F.lit(False))
        untimed = batch.where(F.col("timestamp").isNull()).withColumn("window_end", F.lit(None).cast("timestamp"))
        late = windowed.where(past).withColumn("reason", F.lit("late"))
        write_batch(late.unionByName(untimed.withColumn("reason", F.lit("no time"))), f"{out}/late", batch_id)
        # windows that earlier batches closed are left out of the state by their end
        waiting = read_changes(spark, f"{out}/waiting", fields, batch_id).where(~past)
        fresh = windowed.where(~past)
        flush = flush_at == batch_id
        closed = F.lit(True) if flush else F.coalesce(end <= now - span(delay_seconds), F.lit(False))
        open_ = waiting.where(~closed).unionByName(fresh.where(~closed))
        write_changes(fresh.where(~closed), open_, f"{out}/waiting", batch_id, compact_every, whole=flush)
        full = waiting.where(closed).unionByName(fresh.where(closed)).persist()
        # what the batch before still suppressed: several windows may close at once
        shown = still_shown(shown, F.coalesce(before - span(suppress_seconds + delay_seconds), F.lit(0)))
        from_us = F.coalesce(now - span(suppress_seconds + delay_seconds), F.lit(0))
        if full.isEmpty():
            add_shown(shown, nothing, batch_id, from_us)
        else:
            write_digests(full, [*by, "window_end"], shown, F.col("window_end"), batch_id, from_us)
        full.unpersist()
        batch.unpersist()

    return apply


def newest_time(spark: SparkSession, out: str, batch: DataFrame, batch_id: int, column: str = "timestamp") -> tuple[Column, Column]:
    """Newest time (microseconds) before and with this batch, kept under ``{out}/newest``."""
    seen = read_state(spark, f"{out}/newest", "newest_us long", batch_id)
    top = batch.select(micros(F.col(column)).alias("newest_us")).unionByName(seen).agg(F.max("newest_us").alias("newest_us"))
    write_batch(top, f"{out}/newest", batch_id)
    read = lambda df: F.lit(df.agg(F.max("newest_us")).first()[0]).cast("long")
    return read(seen), read(spark.read.schema("newest_us long").parquet(batch_dir(f"{out}/newest", batch_id)))


def flush_windows(spark: SparkSession, events: DataFrame, out: str, **options) -> None:
    """Select the windows that still wait after a stream's last batch (``events`` gives the columns only)."""
    last = max(written_batches(spark, f"{out}/waiting/whole") + written_batches(spark, f"{out}/waiting/added"), default=None)
    if last is not None:
        curate_batch(out, flush_at=last + 1, **options)(events.limit(0), last + 1)


def stream_curate(events: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(events, curate_batch(out, **options), checkpoint, every)


# --- Late data and duplicates --------------------------------------------------------


def dedup_stream(events: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Drop redelivered event ids within the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def split_late(events: DataFrame, newest_us: Column, delay_seconds: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a batch: late rows are older than the newest time seen so far minus the delay."""
    late = micros(F.col("timestamp")) < newest_us - F.lit(int(delay_seconds * 1_000_000))
    is_late = F.coalesce(late, F.lit(False))
    return events.where(~is_late), events.where(is_late).withColumn("reason", F.lit("late"))


def late_split_batch(out: str, delay_seconds: float = 30.0) -> Callable[[DataFrame, int], None]:
    """Batch function: rows on time to ``{out}/events``, late ones to ``{out}/late``.

    The newest time seen so far is kept under ``{out}/newest``.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        batch = batch.persist()
        before, _ = newest_time(spark, out, batch, batch_id)
        on_time, late = split_late(batch, before, delay_seconds)
        write_batch(on_time, f"{out}/events", batch_id)
        write_batch(late, f"{out}/late", batch_id)
        batch.unpersist()

    return apply


# --- Throttle as state -----------------------------------------------------------------


def _throttle_state(seconds: float):
    gap = int(seconds * 1_000_000)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches, ignore_index=True).sort_values(["us", "id"])
        kept = []
        for i, us in enumerate(rows["us"]):
            if last is None or us - last >= gap:
                kept.append(i)
                last = int(us)
        state.update((last,))
        state.setTimeoutTimestamp(last // 1000 + max(int(seconds * 1000), 1))
        yield rows.iloc[kept][["id", "key", "us"]]

    return keep


def throttle_stream(alerts: DataFrame, seconds: float = S.THROTTLE_SECONDS, delay: str = "30 seconds", key: Column | None = None) -> DataFrame:
    """Kept (id, key, us) of an alert stream; state per key is the last kept time, dropped when it can no longer matter.

    One micro-batch of one key is ordered in memory; ``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``
    bounds it.
    """
    keyed = (
        alerts.withWatermark("created_at", delay)
        .select("id", "created_at", (A.throttle_key() if key is None else key).alias("key"), micros(F.col("created_at")).alias("us"))
    )
    return keyed.groupBy("key").applyInPandasWithState(
        _throttle_state(seconds), "id string, key string, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_alerts(events: DataFrame, seconds: float = S.THROTTLE_SECONDS) -> DataFrame:
    """Event alerts of a stream, throttled."""
    return throttle_stream(A.alerts_from_events(events), seconds)


# --- Audit --------------------------------------------------------------------------------


def audit_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Batch function: append (tenant, timestamp, kind, payload, row_id) rows to the chains under ``out``.

    Rows without a time get the batch's, which is stored, so a rerun hashes the same.

    Records lie under ``{out}/records/batch_id=N/tenant=T``, so one tenant's chain is read from its own files. The
    heads of all tenants are kept under ``{out}/heads``, so appending reads one small row per tenant, not the log. A
    rerun of a batch continues from the same heads and writes the same records; a log without its heads, or begun by
    another query, is an error. Rows without a kind or tenant go to ``{out}/refused``. One tenant's rows of a batch are
    folded by one task; ``segmented_audit_batch`` spreads them.
    """
    head_schema = "tenant string, next_sequence long, head_hash string"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        batch = with_time(batch, out, batch_id)
        heads = read_state(spark, f"{out}/heads", head_schema, batch_id)
        write_batch(chain.refused_rows(batch), f"{out}/refused", batch_id)
        write_folded(chain.append_chain(batch, heads), f"{out}/records", batch_id)
        written = spark.read.schema(AUDIT_DDL).parquet(batch_dir(f"{out}/records", batch_id))
        new_heads = chain.chain_stats(written).select("tenant", "next_sequence", "head_hash")
        untouched = heads.join(new_heads, "tenant", "left_anti")
        write_batch(new_heads.unionByName(untouched), f"{out}/heads", batch_id)

    return apply


def with_time(batch: DataFrame, out: str, batch_id: int) -> DataFrame:
    """Rows without a time get that of their batch."""
    at = F.timestamp_micros(batch_time(batch.sparkSession, out, batch_id))
    return batch.withColumn("timestamp", F.coalesce("timestamp", at))


def segmented_audit_batch(out: str, segment_rows: int = 100_000, check: bool = True) -> Callable[[DataFrame, int], None]:
    """Batch function: append rows as in ``audit_batch`` to two-level chains under ``out``.

    The state per tenant (``{out}/state``) is its next number, the head of its open segment and that of its chain of
    segment heads. A batch continues the open segment and starts as many as its rows fill, all folded in parallel, so a
    tenant with most of the rows spreads over tasks. Segments that became full give a record each to ``{out}/heads``. With
    ``check`` the appended records are verified from the state before the batch, and what breaks is written to
    ``{out}/broken``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        batch = with_time(batch, out, batch_id)
        state = read_state(spark, f"{out}/state", chain.SEGMENT_STATE, batch_id)
        write_batch(chain.refused_rows(batch), f"{out}/refused", batch_id)
        write_folded(chain.append_segments(batch, state, segment_rows), f"{out}/records", batch_id)
        written = spark.read.schema(f"{AUDIT_DDL}, segment long").parquet(batch_dir(f"{out}/records", batch_id))
        write_batch(chain.segment_ends(written, state, segment_rows), f"{out}/ends", batch_id)
        ends = spark.read.parquet(batch_dir(f"{out}/ends", batch_id))
        write_batch(chain.close_segments(ends), f"{out}/heads", batch_id)
        heads = spark.read.schema(AUDIT_DDL).parquet(batch_dir(f"{out}/heads", batch_id))
        if check:
            # An open segment goes on from its head; a tenant at a border has nothing to go on from but its number.
            trusted = state.select("tenant", (F.col("next_sequence") - 1).alias("sequence"), F.col("head_hash").alias("hash"))
            write_batch(chain.bad_records(written, trusted, segment_rows), f"{out}/broken", batch_id)
        write_batch(chain.segment_state(ends, heads, state), f"{out}/state", batch_id)

    return apply


def stream_audit_segmented(rows: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(rows, segmented_audit_batch(out, **options), checkpoint, every)


def read_segments(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(records with their segment, segment heads) of a segmented log."""
    records = spark.read.schema(f"{AUDIT_DDL}, segment long").parquet(f"{out}/records").select(*S.AUDIT.fieldNames(), "segment")
    return records, spark.read.schema(AUDIT_DDL).parquet(f"{out}/heads").select(*S.AUDIT.fieldNames())


def read_chain(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(AUDIT_DDL).parquet(f"{out}/records").select(*S.AUDIT.fieldNames())


def audit_inputs(inputs: DataFrame, tenant: str = "default", at: Column | None = None) -> DataFrame:
    """Chain rows of decoded audit inputs (kind, payload): tenant from the payload, else the given one.

    Without ``at`` they have no time yet: the stream gives them that of their batch.
    """
    own = normalize_tenant(F.coalesce(F.get_json_object("payload", "$.tenant"), F.lit(tenant)))
    when = F.lit(None).cast("timestamp") if at is None else at
    return inputs.select(
        own.alias("tenant"), when.alias("timestamp"), "kind", "payload",
        F.sha2(F.concat_ws("~", "kind", "payload"), 256).alias("row_id"),
    )


def stream_audit(rows: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return run(rows, audit_batch(out), checkpoint, every)


# --- Decide ---------------------------------------------------------------------------------


def digest_rows(digests: DataFrame) -> DataFrame:
    """One row per selected event of every digest."""
    return digests.select(F.explode("selected_events").alias("e")).select("e.*")


def decide_batch(out: str, instruction: str, provider: decide.Provider, guardrails=None) -> Callable[[DataFrame, int], None]:
    """Batch function: decide every event of the batch's digests; decisions and their audit records under ``out``."""
    append = audit_batch(f"{out}/audit")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        made = decide.decide(digest_rows(batch), instruction, provider, guardrails)
        # written once and read back, so that a costly provider is not asked again for the audit rows
        write_batch(made, f"{out}/made", batch_id)
        made = spark.read.parquet(batch_dir(f"{out}/made", batch_id))
        append(decide.decision_audit_rows(made), batch_id)
        records = spark.read.schema(f"{AUDIT_DDL}, row_id string").parquet(batch_dir(f"{out}/audit/records", batch_id))
        final = decide.chained_decisions(made, records)
        write_batch(sinks.decision_messages(final), f"{out}/decisions", batch_id)

    return apply


def stream_decide(digests: DataFrame, out: str, checkpoint: str, instruction: str, provider, guardrails=None, every: str | None = None) -> StreamingQuery:
    return run(digests, decide_batch(out, instruction, provider, guardrails), checkpoint, every)


# --- Liveness and fan-out -----------------------------------------------------------------------


def _liveness(stalled_ms: int):
    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]], "status": ["stalled"], "last_us": [last], "events": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for pdf in batches:
            last, n = max(last, int(pdf["us"].max())), n + len(pdf)
        state.update((last, n))
        state.setTimeoutTimestamp(last // 1000 + stalled_ms)
        yield pd.DataFrame({"source_id": [key[0]], "status": ["alive"], "last_us": [last], "events": [n]})

    return watch


def source_liveness(events: DataFrame, stalled_seconds: float = 90.0, delay: str = "30 seconds") -> DataFrame:
    """Per source: ``alive`` on every batch with events, ``stalled`` once when none came for the given event time.

    A source's rows of one batch are read as a stream of Arrow chunks, so a busy source needs no memory.
    """
    rows = events.withWatermark("timestamp", delay).select("source_id", "timestamp", micros(F.col("timestamp")).alias("us"))
    return rows.groupBy("source_id").applyInPandasWithState(
        _liveness(int(stalled_seconds * 1000)), "source_id string, status string, last_us long, events long",
        "last long, n long", "append", GroupStateTimeout.EventTimeTimeout,
    )


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVENESS = "source_id string, status string, last_us long, events long"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Newest time and number of events of each source in a part of a batch."""
    for pdf in batches:
        per = pdf.groupby("source_id", dropna=False)["us"].agg(["max", "size"]).reset_index()
        yield pd.DataFrame({"source_id": per["source_id"], "last_us": per["max"].astype("Int64"), "n": per["size"]})


class _Watch(StatefulProcessor):
    """Per source the newest event time and the number of events, with one timer that each batch of events moves on."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.seen.get() if self.seen.exists() else (None, 0)
        for pdf in rows:
            newest = pdf["last_us"].dropna()
            if len(newest):
                last = int(newest.max()) if last is None else max(last, int(newest.max()))
            n += int(pdf["n"].sum())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        self.seen.update((last, n))
        yield self.row(key, "alive", last, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.row(key, "stalled", *self.seen.get())

    def row(self, key, status, last, n) -> pd.DataFrame:
        return pd.DataFrame({"source_id": [key[0]], "status": [status], "last_us": pd.array([last], dtype="Int64"), "events": [n]})


def watch_sources(events: DataFrame, silent_seconds: float = 90.0) -> DataFrame:
    """Per source: ``alive`` for every batch with events of it, ``stalled`` once none came for so long by the clock.

    Timers run on processing time, so a stream that falls silent as a whole still reports its sources: run it with a
    processing-time trigger, as only a batch, even an empty one, fires timers. A source that speaks again is ``alive``
    again, and its count goes on. Events are reduced to one row per source and Arrow batch before they are brought to their
    source's state, so a busy source costs a few rows. Needs the RocksDB state store (``ROCKS_DB``), set before the start.
    """
    rows = events.select("source_id", micros(F.col("timestamp")).alias("us")).mapInPandas(_counted, "source_id string, last_us long, n long")
    return rows.groupBy("source_id").transformWithStateInPandas(_Watch(int(silent_seconds * 1000)), LIVENESS, "Append", "ProcessingTime")


def _throttled(
    spark: SparkSession, alerts: DataFrame, out: str, batch_id: int, seconds: float, key: Column | None = None, **options
) -> DataFrame:
    """Alerts of a batch kept by the greedy throttle over all batches; the last kept time per key is the state.

    The walk goes on from a key's last kept time, so alerts within its gap fall before the batch is throttled as a table
    of its own; what is left of them lies under ``{out}/raised``. Alerts without a key or time are kept and leave no state.
    """
    gap = int(seconds * 1_000_000)
    key = A.throttle_key() if key is None else key
    state = read_state(spark, f"{out}/throttle", "key string, last_us long", batch_id)
    open_ = alerts
    if batch_id:  # the first batch has no state to meet
        keyed = alerts.withColumn("_key", key).withColumn("_us", micros(F.col("created_at")))
        within = F.coalesce(F.col("_us") < F.col("last_us") + gap, F.lit(False))
        open_ = keyed.join(state.withColumnRenamed("key", "_key"), "_key", "left").where(~within).select(alerts.columns)
    # written once and read back: the throttle reads them many times, and their columns and sources are costly
    write_batch(open_, f"{out}/raised", batch_id)
    raised = spark.read.schema(alerts.schema).parquet(batch_dir(f"{out}/raised", batch_id))
    write_batch(A.throttle_alerts(raised, seconds, key, **options), f"{out}/alerts", batch_id)
    kept = spark.read.schema(alerts.schema).parquet(batch_dir(f"{out}/alerts", batch_id))
    seen = state.unionByName(kept.select(key.alias("key"), micros(F.col("created_at")).alias("last_us")).dropna())
    last = seen.groupBy("key").agg(F.max("last_us").alias("last_us"))
    # Keys whose gap is over by the newest alert can suppress nothing that is on time. Checks bear the time of the
    # batch, all other alerts that of the data.
    newest = last.where(F.col("key") != "platform.audit_chain_invalid").agg(F.max("last_us")).first()[0]
    over = F.coalesce(F.col("last_us") <= F.lit(newest).cast("long") - gap, F.lit(False))
    write_batch(last.where(~over), f"{out}/throttle", batch_id)
    return kept


def throttle_batch(out: str, seconds: float = S.THROTTLE_SECONDS, key: Column | None = None, **options) -> Callable[[DataFrame, int], None]:
    """Batch function: alerts kept by the greedy throttle over all batches, under ``{out}/alerts``.

    A busy key is cut into blocks of equally many times whose summaries are composed (``alerts.throttle_alerts``, which
    takes ``options``), so no task holds a key's whole batch; ``throttle_stream`` does. The state under
    ``{out}/throttle`` is one number per key whose gap is not over.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        claim(batch.sparkSession, out, batch_id)
        _throttled(batch.sparkSession, batch, out, batch_id, seconds, key, **options)

    return apply


def stream_throttled(alerts: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(alerts, throttle_batch(out, **options), checkpoint, every)


def _checked(spark: SparkSession, out: str, heads: DataFrame, batch_id: int, at: Column) -> DataFrame:
    """Verify what the batch appended from the heads before it; alerts for chains that turned invalid."""
    written = spark.read.schema(AUDIT_DDL).parquet(batch_dir(f"{out}/audit/records", batch_id))
    trusted = heads.select("tenant", (F.col("next_sequence") - 1).alias("sequence"), F.col("head_hash").alias("hash"))
    verdict = chain.verify_since(written, trusted)
    error = F.when(~F.col("valid"), F.concat(F.col("tenant"), F.lit(": first bad sequence "), F.col("first_bad").cast("string")))
    checks = verdict.select("tenant", at.alias("checked_at"), "valid", error.alias("verify_err"))
    before = read_state(spark, f"{out}/checks", "tenant string, checked_at timestamp, valid boolean, verify_err string", batch_id)
    write_batch(checks, f"{out}/checks", batch_id)
    both = before.unionByName(spark.read.schema(before.schema).parquet(batch_dir(f"{out}/checks", batch_id)))
    return A.alerts_from_audit(both).where(F.col("created_at") == at)


def platform_batch(
    out: str, strategy: int = S.DEFAULT_STRATEGY, k: int = S.BATCH_K, diversity: float = S.DEFAULT_DIVERSITY, by: Sequence[str] = (),
    instruction: str = "", provider: decide.Provider | None = None, guardrails=None, seconds: float = S.THROTTLE_SECONDS,
    fallback_tenant: str = "", **options,
) -> Callable[[DataFrame, int], None]:
    """Batch function for raw messages that feeds one audit log per tenant from all producers, and its watchers.

    Accepted events, one digest per tenant (and group of ``by``) of the batch, and, with a ``provider``, decisions over
    the digests' events each add their rows to the tenant's chain under ``{out}/audit``. The appended part is verified
    from the heads before it, and a chain that turns invalid raises an alert. Alerts of events, digests, decisions and
    checks are throttled over batches. The live feed has all four kinds of messages.
    """
    append = audit_batch(f"{out}/audit")

    def row(rank: int, kind: Column, key: Column) -> Column:
        return F.concat_ws(":", F.lit(rank), kind, key)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        now = F.timestamp_micros(batch_time(spark, out, batch_id))
        decoded = decode_events(batch).persist()
        good = decoded.where(F.col("reason").isNull()).drop("reason", "value")
        good = good.withColumn("tenant", resolve_tenant(F.col("metadata.tenant_id"), fallback_tenant))
        write_batch(good.drop("tenant"), f"{out}/events", batch_id)
        write_batch(decoded.where(F.col("reason").isNotNull()).select("value", "reason"), f"{out}/rejects", batch_id)
        keys = ["tenant", *by]
        picked = curate.select_events(good, strategy, k, keys, diversity=diversity, **options).persist()
        ends = good.groupBy(*keys).agg(F.max("ingested_at").alias("_end"))
        scores = curate.digest_scores(picked, good, keys).join(ends, keys)
        write_batch(curate.digest_records(picked, scores, strategy, keys, F.col("_end")).drop("_end"), f"{out}/digests", batch_id)
        digests = spark.read.parquet(batch_dir(f"{out}/digests", batch_id))
        ingest = sinks.ingest_audit_rows(good, fallback_tenant)
        rows = ingest.withColumn("row_id", row(0, F.col("kind"), F.col("row_id")))
        chosen = curate.digest_selection_payload(digests, k, diversity)
        key = F.to_json(F.struct(*keys))
        rows = rows.unionByName(chosen.select("tenant", F.col("window_end").alias("timestamp"), "kind", "payload", row(1, F.col("kind"), key).alias("row_id")))
        alerts = A.alerts_from_events(good).unionByName(A.alerts_from_digests(digests, k))
        if provider is not None:
            write_batch(decide.decide(picked.drop("tenant"), instruction, provider, guardrails), f"{out}/made", batch_id)
            made = spark.read.parquet(batch_dir(f"{out}/made", batch_id))
            told = decide.decision_audit_rows(made)
            rows = rows.unionByName(told.withColumn("row_id", row(2, F.col("kind"), F.col("row_id"))))
            alerts = alerts.unionByName(A.alerts_from_decisions(made))
        heads = read_state(spark, f"{out}/audit/heads", "tenant string, next_sequence long, head_hash string", batch_id)
        append(rows, batch_id)
        kept = _throttled(spark, alerts.unionByName(_checked(spark, out, heads, batch_id, now)), out, batch_id, seconds)
        feed = [sinks.live_envelope(good.drop("tenant"), "event", sinks.event_json()), sinks.live_envelope(digests, "digest"), sinks.live_envelope(kept, "alert")]
        if provider is not None:
            records = spark.read.schema(f"{AUDIT_DDL}, row_id string").parquet(batch_dir(f"{out}/audit/records", batch_id))
            mine = records.where(F.startswith("row_id", F.lit("2:"))).withColumn("row_id", F.regexp_replace("row_id", "^2:[^:]*:", ""))
            write_batch(decide.chained_decisions(made, mine), f"{out}/decisions", batch_id)
            feed.append(sinks.live_envelope(spark.read.parquet(batch_dir(f"{out}/decisions", batch_id)), "decision"))
        write_batch(reduce(DataFrame.unionByName, feed), f"{out}/live", batch_id)
        picked.unpersist()
        decoded.unpersist()

    return apply


def run_platform(messages: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(messages, platform_batch(out, **options), checkpoint, every)


def fan_out_batch(out: str, fallback_tenant: str = "") -> Callable[[DataFrame, int], None]:
    """Batch function for raw messages: accepted events, rejects, ``ingest`` audit rows, alerts and live messages.

    The decoded batch is kept once and feeds all outputs.
    """
    append = audit_batch(f"{out}/audit")

    def apply(batch: DataFrame, batch_id: int) -> None:
        claim(batch.sparkSession, out, batch_id)
        decoded = decode_events(batch).persist()
        good = decoded.where(F.col("reason").isNull()).drop("reason", "value")
        write_batch(good, f"{out}/events", batch_id)
        write_batch(decoded.where(F.col("reason").isNotNull()).select("value", "reason"), f"{out}/rejects", batch_id)
        append(sinks.ingest_audit_rows(good, fallback_tenant), batch_id)
        alerts = A.alerts_from_events(good)
        write_batch(alerts, f"{out}/alerts", batch_id)
        feed = [sinks.live_envelope(good, "event", sinks.event_json()), sinks.live_envelope(alerts, "alert")]
        write_batch(reduce(DataFrame.unionByName, feed), f"{out}/live", batch_id)
        decoded.unpersist()

    return apply


def fan_out(messages: DataFrame, out: str, checkpoint: str, every: str | None = None, fallback_tenant: str = "") -> StreamingQuery:
    return run(messages, fan_out_batch(out, fallback_tenant), checkpoint, every)


# --- Retries ---------------------------------------------------------------------------------


def retry_batch(out: str, check: Callable[[DataFrame, int], DataFrame], attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """Batch function: rows that ``check`` refuses are tried again with later batches; after ``attempts`` tries they are dead.

    ``check(rows, batch_id)`` gives the rows back with a ``reason`` (null: accepted). What a batch tried lies under
    ``{out}/tried/batch_id=N/outcome=accepted|retry|dead`` as (row, attempts, reason), written at once, so all three
    outcomes take effect together and a rerun replaces them. The rows to retry and their counts are read from the batch
    before, so they survive a restart. Rows that wait are tried with the next batch, whenever it comes. Columns of the
    input may have any name but ``reason`` and ``_attempts``.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        fields = StructType().add("row", batch.schema).add("attempts", "integer").add("reason", "string").add("outcome", "string")
        before = read_state(spark, f"{out}/tried", fields, batch_id).where("outcome = 'retry'")
        rows = before.select("row.*", F.col("attempts").alias("_attempts")).unionByName(batch.withColumn("_attempts", F.lit(0)))
        tries = F.col("_attempts") + 1
        outcome = F.when(F.col("reason").isNull(), "accepted").when(tries < attempts, "retry").otherwise("dead")
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("row")
        tried = check(rows, batch_id).select(row, tries.cast("int").alias("attempts"), F.col("reason").cast("string").alias("reason"), outcome.alias("outcome"))
        write_batch(tried, f"{out}/tried", batch_id, ["outcome"])

    return apply


def stream_retry(rows: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(rows, retry_batch(out, **options), checkpoint, every)


def read_tried(spark: SparkSession, out: str) -> DataFrame:
    """(row, attempts, reason, outcome) of all rows: accepted and dead ones of all batches, and those that still wait."""
    last = written_batches(spark, f"{out}/tried")
    tried = spark.read.parquet(f"{out}/tried")
    return tried.where((F.col("outcome") != "retry") | (F.col("batch_id") == last[-1])).drop("batch_id")


# --- Precedents ------------------------------------------------------------------------------


def precedents_batch(out: str, max_n: int = S.DEFAULT_MAX_PRECEDENTS, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """Batch function over new audit records: keeps the ``max_n`` newest precedents per match key under ``{out}/newest``.

    Only the batch's records are parsed. Decoded decisions and actions stay under ``{out}/decisions`` and
    ``{out}/actions``; an action finds a decision of any earlier batch there, and a decision an action that came first.
    The n newest of all pairs are the n newest among those stored and those of the batch, so a batch adds its own n
    newest per key, and every ``compact_every`` batches the merged list is written anew.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, out, batch_id)
        newest = read_changes(spark, f"{out}/newest", precedents.STORED, batch_id)
        parts = {"decisions": precedents.passed_decisions(batch), "actions": precedents.operator_actions(batch).drop("operator_id", "acted_at")}
        old, new = {}, {}
        for name, rows in parts.items():
            write_batch(rows, f"{out}/{name}", batch_id)
            new[name] = spark.read.schema(rows.schema).parquet(batch_dir(f"{out}/{name}", batch_id))
            known = [batch_dir(f"{out}/{name}", b) for b in written_batches(spark, f"{out}/{name}") if b < batch_id]
            old[name] = spark.read.schema(rows.schema).parquet(*known) if known else spark.createDataFrame([], rows.schema)
        pairs = precedents.paired(new["decisions"], new["actions"].unionByName(old["actions"])).unionByName(
            precedents.paired(old["decisions"], new["actions"]))
        ranked = lambda rows: precedents.newest_rows(rows, max_n)
        write_changes(ranked(pairs), ranked(newest.unionByName(pairs)), f"{out}/newest", batch_id, compact_every)

    return apply


def stream_precedents(audit: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    return run(audit, precedents_batch(out, **options), checkpoint, every)


def read_precedents(
    spark: SparkSession, out: str, max_n: int = S.DEFAULT_MAX_PRECEDENTS, fields: Sequence[str] = precedents.PRECEDENT_FIELDS,
) -> DataFrame:
    """The stored precedents as ``operators.precedents.as_lists`` gives them; ``max_n`` at most that of the job."""
    last = max(written_batches(spark, f"{out}/newest/whole") + written_batches(spark, f"{out}/newest/added"), default=-1)
    return precedents.as_lists(read_changes(spark, f"{out}/newest", precedents.STORED, last + 1), max_n, fields)
