"""Per-tenant SHA-256 audit chains.

Verification is fully parallel: a stored record only has to be compared with its stored predecessor,
so the serial walk becomes a join on (tenant, sequence - 1). Payloads are hashed map-side and never
shuffled.

Appending to one chain is serial by definition (each hash covers the one before). Everything that can
be parallel is: sequence numbers come from ``positions`` and record bodies are built in the JVM; only the
hash fold runs in order, as a stream over sorted rows with constant memory. Large tenants use segments:
chains of bounded length that are folded in parallel and whose heads are chained in turn, in one go
(``segment_chain``) or batch by batch (``append_segments``, ``close_segments``, ``segment_state``).
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import RECORD_SUFFIX, first_failure, micros, present, record_hash, record_prefix
from auditweave.functions.ranking import positions, time_cell

COLUMNS = S.AUDIT.fieldNames()


# --- Verify ------------------------------------------------------------------


def link_records(audit: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """Every record with its stored predecessor's hash (null when there is none).

    ``trusted`` (tenant, sequence, hash) are records outside the table that may be predecessors too.
    Columns: tenant, sequence, hash, prev_hash, self_ok (stored hash fits the record's own fields),
    pred_hash, copies (records sharing the sequence).
    """
    self_ok = F.col("hash") == record_hash(
        F.col("sequence"), F.col("timestamp"), F.col("kind"), F.col("payload"), F.col("prev_hash")
    )
    records = audit.select(
        "tenant", "sequence", (F.col("sequence") - 1).alias("_at"), "hash", "prev_hash",
        F.coalesce(self_ok, F.lit(False)).alias("self_ok"),
    )
    known = audit.select("tenant", "sequence", "hash")
    if trusted is not None:
        known = known.unionByName(trusted.select("tenant", "sequence", "hash"))
    before = known.groupBy("tenant", F.col("sequence").alias("_at")).agg(F.max("hash").alias("pred_hash"))
    # sequence - 1 identifies the sequence, so counting copies reuses the join's partitioning
    copies = F.count(F.lit(1)).over(Window.partitionBy("tenant", "_at"))
    return records.join(before, ["tenant", "_at"], "left").withColumn("copies", copies).drop("_at")


def after_checkpoints(audit: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records above their tenant's checkpoint; tenants without one are kept whole."""
    cuts = checkpoints.select("tenant", F.col("sequence").alias("_from"))
    return (
        audit.join(cuts, "tenant", "left")
        .where(F.col("_from").isNull() | (F.col("sequence") > F.col("_from"))).drop("_from")
    )


def bad_records(audit: DataFrame, checkpoints: DataFrame | None = None, segment_rows: int | None = None) -> DataFrame:
    """Records that break their chain, with ``reason``.

    ``checkpoints`` (tenant, sequence, hash) are trusted records a chain may continue from; records up
    to them are not looked at. A tenant without one must start at sequence 0 with an empty previous hash. With
    ``segment_rows`` every segment must start so.
    """
    newer = audit if checkpoints is None else after_checkpoints(audit, checkpoints)
    linked = link_records(newer, checkpoints)
    starts = F.col("sequence") % F.lit(segment_rows) == 0 if segment_rows else F.col("sequence") == 0
    expected = F.when(starts, "").otherwise(F.col("pred_hash"))
    reason = (
        F.when(F.col("copies") > 1, "duplicate sequence")
        .when(~F.col("self_ok"), "hash does not fit the record")
        .when(expected.isNull(), "predecessor missing")
        .when(F.col("prev_hash").isNull() | (F.col("prev_hash") != expected), "predecessor hash differs")
    )
    return linked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("tenant", "sequence", "reason")


def chain_stats(audit: DataFrame) -> DataFrame:
    """Per tenant: records, head hash and the sequence the next record gets."""
    return audit.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("length"),
        F.max_by("hash", "sequence").alias("head_hash"),
        (F.max("sequence") + 1).alias("next_sequence"),
    )


def _verdict(audit: DataFrame, first_bad: DataFrame) -> DataFrame:
    return (
        chain_stats(audit).join(first_bad, "tenant", "left")
        .select("tenant", F.col("first_bad").isNull().alias("valid"), "first_bad", "length", "head_hash")
    )


def verify_chain(audit: DataFrame) -> DataFrame:
    """Per tenant: valid, first bad sequence, length, head hash."""
    return _verdict(audit, bad_records(audit).groupBy("tenant").agg(F.min("sequence").alias("first_bad")))


def verify_since(audit: DataFrame, checkpoints: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Incremental verification: only records above each tenant's checkpoint (tenant, sequence, hash).

    Tenants without a checkpoint are verified from the start. A tenant with nothing above its checkpoint has its row
    too: length 0 and the checkpoint's hash as head, so a chain that was cut back is not passed over.
    """
    newer = after_checkpoints(audit, checkpoints)
    bad = bad_records(audit, checkpoints, segment_rows).groupBy("tenant").agg(F.min("sequence").alias("first_bad"))
    trusted = checkpoints.select("tenant", F.col("hash").alias("_trusted"))
    return _verdict(newer, bad).join(trusted, "tenant", "full").select(
        "tenant", F.coalesce("valid", F.lit(True)).alias("valid"), "first_bad",
        F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("head_hash", "_trusted").alias("head_hash"),
    )


def anchor_heads(audit: DataFrame, at: Column) -> DataFrame:
    """Snapshot of (tenant, length, sequence, hash) to keep outside the chain."""
    return audit.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("length"), F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash")
    ).withColumn("anchored_at", at)


def check_anchors(audit: DataFrame, anchors: DataFrame) -> DataFrame:
    """Compare anchors with the table: a cut tail or a replaced record shows up here even if links verify."""
    now = audit.select("tenant", "sequence", F.col("hash").alias("_now"))
    found = anchors.join(now, ["tenant", "sequence"], "left")
    status = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("hash"), "replaced").otherwise("present")
    )
    return found.withColumn("status", status).drop("_now")


# --- Append ------------------------------------------------------------------


def fold_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain hashes over rows sorted by (chain, sequence); keeps only the running hash between batches.

    Only the key and body columns become Python objects; all others are passed on as they are.
    """
    chain, prev, suffix = None, b"", RECORD_SUFFIX.encode()
    for batch in batches:
        prevs, hashes = [], []
        keys = batch.column("_chain").to_numpy(zero_copy_only=False)
        bodies = batch.column("_body").to_pandas().tolist()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(edges, edges[1:]):  # one run per chain
            if begin < end and keys[begin] != chain:
                chain, prev = keys[begin], batch.column("_start")[begin].as_py().encode()
            for body in bodies[begin:end]:
                prevs.append(prev)
                prev = hashlib.sha256(body + prev + suffix).hexdigest().encode()
                hashes.append(prev)
        kept = [c for c in batch.schema.names if c not in ("_chain", "_start", "_body")]
        columns = [batch.column(c) for c in kept] + [pa.array(c, pa.binary()).cast(pa.string()) for c in (prevs, hashes)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "prev_hash", "hash"])


def _fold(rows: DataFrame, chain: Column, start: Column) -> DataFrame:
    """Add prev_hash and hash to sequenced rows; one ordered stream per chain key. A column ``_head`` is left out.

    Bodies, which hold the payload again, are built from the sorted rows, so that no sort holds them.
    """
    body = record_prefix(F.col("sequence"), F.col("timestamp"), F.col("kind"), F.col("payload")).cast("binary")
    kept = [f for f in rows.schema.fields if f.name != "_head"]
    keyed = rows.select(*[f.name for f in kept], chain.alias("_chain"), start.alias("_start"))
    ordered = keyed.repartition("_chain").sortWithinPartitions("_chain", "sequence")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ordered.select("*", body.alias("_body")).mapInArrow(fold_hashes, f"{out}, prev_hash string, hash string")


def assign_sequence(rows: DataFrame, heads: DataFrame | None = None, cell_micros: int = 1_000_000) -> DataFrame:
    """Number (tenant, timestamp, kind, payload, row_id) rows per tenant by (timestamp, row_id).

    Continues after ``heads`` (tenant, next_sequence, head_hash); only a tenant's first row bears the head it follows, in
    ``_head``. Tenant and timestamp must not be null (``check_rows``).
    """
    cells = rows.withColumn("_cell", time_cell(micros(F.col("timestamp")), cell_micros))
    order = [F.col("timestamp").asc(), F.col("row_id").asc()]
    start = None
    if heads is not None:
        start = heads.select("tenant", F.col("next_sequence").alias("_next"), F.col("head_hash").alias("_head"))
    numbered = positions(cells, ["tenant"], "_cell", order, "_pos", start).drop("_cell")
    if heads is None:
        numbered = numbered.withColumn("_next", F.lit(0)).withColumn("_head", F.lit(""))
    sequence = (F.col("_pos") + F.coalesce("_next", F.lit(0))).cast("long")
    head = F.when(F.col("_pos") == 0, F.coalesce("_head", F.lit("")))
    return numbered.withColumn("sequence", sequence).withColumn("_head", head).drop("_pos", "_next")


def check_rows(rows: DataFrame) -> DataFrame:
    """Add ``reason`` for rows that cannot be chained: no kind, tenant or time."""
    checks = [(present(F.col("kind")), "kind required"), (F.col("tenant").isNotNull(), "tenant required"), (F.col("timestamp").isNotNull(), "timestamp required")]
    return rows.withColumn("reason", first_failure(checks))


def refused_rows(rows: DataFrame) -> DataFrame:
    """Rows that cannot be chained, with ``reason``."""
    return check_rows(rows).where(F.col("reason").isNotNull())


def _accepted(rows: DataFrame) -> DataFrame:
    return check_rows(rows).where(F.col("reason").isNull()).drop("reason")


def append_chain(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Audit records for new rows (tenant, timestamp, kind, payload, row_id), one chain per tenant.

    Rows without a kind, tenant or time are refused: they get no record. ``refused_rows`` gives them with their reason.
    """
    numbered = assign_sequence(_accepted(rows), heads).select(
        "tenant", "sequence", "timestamp", "kind", "payload", "row_id", "_head"
    )
    return _fold(numbered, F.col("tenant"), F.col("_head")).select(*COLUMNS, "row_id")


def segment_chain(rows: DataFrame, segment_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(records, heads) of a two-level chain.

    Records are chained inside segments of ``segment_rows`` sequence numbers, all segments in
    parallel. Heads hold one row per segment (payload = segment number and last hash) and form a
    second chain per tenant, so altering any record changes a head, and altering a head breaks the
    head chain.
    """
    numbered = assign_sequence(_accepted(rows)).select("tenant", "sequence", "timestamp", "kind", "payload", "row_id")
    numbered = numbered.withColumn("segment", F.floor(F.col("sequence") / segment_rows).cast("long"))
    records = _fold(numbered, F.struct("tenant", "segment").cast("string"), F.lit(""))
    return records, _fold(segment_heads(records), F.col("tenant"), F.lit(""))


SEGMENT_STATE = "tenant string, next_sequence long, head_hash string, open_time timestamp, heads_hash string"


def append_segments(rows: DataFrame, state: DataFrame, segment_rows: int = 100_000) -> DataFrame:
    """Audit records of new rows, with their ``segment``, continuing after ``state`` (SEGMENT_STATE).

    The tenant's open segment is continued from its head; later segments start anew, so all are folded in parallel and
    one task folds at most ``segment_rows`` records, however many rows a tenant has.
    """
    numbered = assign_sequence(_accepted(rows), state.select("tenant", "next_sequence", "head_hash")).select(
        "tenant", "sequence", "timestamp", "kind", "payload", "row_id", "_head"
    ).withColumn("segment", F.floor(F.col("sequence") / segment_rows).cast("long"))
    # only the first row of a segment in the batch gives the start
    start = F.when(F.col("sequence") % segment_rows == 0, "").otherwise(F.col("_head"))
    return _fold(numbered, F.struct("tenant", "segment").cast("string"), start).select(*COLUMNS, "row_id", "segment")


def segment_ends(records: DataFrame, state: DataFrame, segment_rows: int) -> DataFrame:
    """Newest record of each segment that ``records`` touch: (tenant, segment, timestamp, last, hash, full, heads_hash).

    ``timestamp`` is the newest of the whole segment, also of its records in earlier batches.
    """
    ends = records.groupBy("tenant", "segment").agg(
        F.max("timestamp").alias("timestamp"), F.max("sequence").alias("last"), F.max_by("hash", "sequence").alias("hash"))
    known = state.select("tenant", F.floor(F.col("next_sequence") / segment_rows).cast("long").alias("_open"), "open_time", "heads_hash")
    time = F.greatest("timestamp", F.when(F.col("segment") == F.col("_open"), F.col("open_time")))
    return ends.join(known, "tenant", "left").select(
        "tenant", "segment", time.alias("timestamp"), "last", "hash",
        (F.col("last") % segment_rows == segment_rows - 1).alias("full"), F.coalesce("heads_hash", F.lit("")).alias("heads_hash"))


def close_segments(ends: DataFrame) -> DataFrame:
    """Heads of the segments that became full, chained after those before them."""
    full = ends.where("full").select("tenant", "segment", "timestamp", F.col("hash").alias("_last"), "heads_hash")
    rows = head_rows(full, "heads_hash")
    return _fold(rows, F.col("tenant"), F.col("heads_hash")).select(*COLUMNS)


def segment_state(ends: DataFrame, heads: DataFrame, state: DataFrame) -> DataFrame:
    """State after a batch, from its segment ends and new heads; untouched tenants keep theirs."""
    newest = ends.groupBy("tenant").agg(F.max_by(F.struct("last", "hash", "timestamp", "full", "heads_hash"), "segment").alias("e"))
    closed = heads.groupBy("tenant").agg(F.max_by("hash", "sequence").alias("_heads"))
    moved = newest.join(closed, "tenant", "left").select(
        "tenant", (F.col("e.last") + 1).alias("next_sequence"), F.when(F.col("e.full"), "").otherwise(F.col("e.hash")).alias("head_hash"),
        F.when(~F.col("e.full"), F.col("e.timestamp")).alias("open_time"), F.coalesce("_heads", "e.heads_hash").alias("heads_hash"))
    return moved.unionByName(state.join(moved, "tenant", "left_anti"))


def head_rows(last: DataFrame, *more: str) -> DataFrame:
    """Unchained head rows of (tenant, segment, timestamp, _last: hash of the segment's last record)."""
    body = F.to_json(F.struct("segment", F.col("_last").alias("segment_head")))
    return last.select("tenant", F.col("segment").alias("sequence"), "timestamp", F.lit("segment").alias("kind"), body.alias("payload"), *more)


def segment_heads(records: DataFrame) -> DataFrame:
    """One unchained head row per (tenant, segment)."""
    return head_rows(records.groupBy("tenant", "segment").agg(
        F.max("timestamp").alias("timestamp"), F.max_by("hash", "sequence").alias("_last")))


def verify_segments(records: DataFrame, heads: DataFrame, segment_rows: int) -> DataFrame:
    """Broken records, head mismatches and broken head links of a two-level chain, as (tenant, level, at, reason).

    A tenant's newest segment may be open (not full, without a head).
    """
    inner = records.withColumn("sequence", F.col("sequence") - F.col("segment") * segment_rows)
    # the hash covers the tenant-wide sequence, the link check uses the position inside the segment
    ok = F.col("hash") == record_hash(
        F.col("segment") * segment_rows + F.col("sequence"), F.col("timestamp"), F.col("kind"), F.col("payload"), F.col("prev_hash")
    )
    rec = inner.select("tenant", "segment", "sequence", (F.col("sequence") - 1).alias("_at"), "prev_hash",
                       F.coalesce(ok, F.lit(False)).alias("_ok"))
    before = inner.groupBy("tenant", "segment", F.col("sequence").alias("_at")).agg(F.max("hash").alias("_pred"))
    expected = F.when(F.col("sequence") == 0, "").otherwise(F.col("_pred"))
    reason = (
        F.when(~F.col("_ok"), "hash does not fit the record")
        .when(expected.isNull(), "predecessor missing")
        .when(F.col("prev_hash") != expected, "predecessor hash differs")
    )
    at = (F.col("segment") * segment_rows + F.col("sequence")).alias("at")
    broken = (
        rec.join(before, ["tenant", "segment", "_at"], "left").withColumn("reason", reason)
        .where(F.col("reason").isNotNull()).select("tenant", F.lit("record").alias("level"), at, "reason")
    )
    stored = heads.select("tenant", F.col("sequence").alias("at"), F.col("payload").alias("_stored"))
    found = segment_heads(records).select("tenant", F.col("sequence").alias("at"), F.col("payload").alias("_found"))
    open_ = records.groupBy("tenant").agg(F.max("sequence").alias("_end")).where((F.col("_end") + 1) % segment_rows != 0)
    open_ = open_.select("tenant", F.floor(F.col("_end") / segment_rows).cast("long").alias("_open"))
    mismatch = (
        stored.join(found, ["tenant", "at"], "full").join(open_, "tenant", "left")
        .where(~F.col("_stored").eqNullSafe(F.col("_found")))
        .where(F.col("_stored").isNotNull() | ~F.coalesce(F.col("at") == F.col("_open"), F.lit(False)))
        .select("tenant", F.lit("segment").alias("level"), "at", F.lit("segment head differs").alias("reason"))
    )
    links = bad_records(heads).select("tenant", F.lit("head").alias("level"), F.col("sequence").alias("at"), "reason")
    return broken.unionByName(mismatch).unionByName(links)


# --- Retention -----------------------------------------------------------------


def retention_tiers(df: DataFrame, as_of: Column, hot_days: int = 30, archive_days: int = 5 * 365) -> DataFrame:
    """Storage tier of every event by age: hot, archive, purge."""
    age_days = (micros(as_of) - micros(F.col("timestamp"))) / F.lit(86_400_000_000)
    tier = F.when(age_days < hot_days, "hot").when(age_days < archive_days, "archive").otherwise("purge")
    return df.withColumn("tier", tier)


def audit_retention(audit: DataFrame, as_of: Column, keep_days: int = 7 * 365) -> tuple[DataFrame, DataFrame]:
    """(kept records, checkpoints at the cut).

    A tenant loses the records before its first one that is younger than ``keep_days``, whatever times come later: a
    chain can only be cut at its start, and a late-stamped old record must not take young ones with it. A record without
    a time counts as young. The checkpoint at the cut lets ``verify_since`` verify what is kept.
    """
    old = F.coalesce((micros(as_of) - micros(F.col("timestamp"))) >= keep_days * 86_400_000_000, F.lit(False))
    ends = audit.groupBy("tenant").agg(
        F.coalesce(F.min(F.when(~old, F.col("sequence"))) - 1, F.max("sequence")).alias("sequence")
    )
    cut = audit.select("tenant", "sequence", "hash").join(ends, ["tenant", "sequence"])
    return after_checkpoints(audit, cut), cut
