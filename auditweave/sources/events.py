"""Decoding topic messages and scanning stored tables.

Messages come from any Spark source with a ``value`` column (Kafka, files, a table); batch and
streaming frames use the same decoders.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import blank_to_null, json_member_text, parse_json
from auditweave.operators.validate import event_failure


def read_messages(spark: SparkSession, fmt: str, stream: bool = False, path: str | None = None, **options) -> DataFrame:
    """Messages as (key, value) text, with topic, partition and offset where the source has them.

    ``fmt`` is ``kafka`` or any file format with a ``value`` column.
    """
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    if fmt == "text":
        reader = reader.schema("value string")
    elif fmt != "kafka":
        reader = reader.schema("key string, value string")
    df = reader.load(path) if path else reader.load()
    key = F.col("key").cast("string") if "key" in df.columns else F.lit(None).cast("string")
    place = [c for c in ("topic", "partition", "offset") if c in df.columns]
    return df.select(key.alias("key"), F.col("value").cast("string").alias("value"), *place)


def decode_events(messages: DataFrame) -> DataFrame:
    """Events of raw messages with ``reason`` set for undecodable or invalid ones."""
    parsed = parse_json(messages.select("value"), "value", S.EVENT)
    typed = parsed.withColumn("payload", json_member_text(F.col("value"), "payload", F.col("payload")))
    reason = F.when(F.col("bad_json"), F.lit("bad json")).otherwise(event_failure())
    return typed.withColumn("reason", reason).select(*S.EVENT.fieldNames(), "reason", "value")


def read_events(messages: DataFrame) -> DataFrame:
    """Valid events only; undecodable and invalid messages are skipped (see ``decode_events``)."""
    return decode_events(messages).where(F.col("reason").isNull()).drop("reason", "value")


def read_digests(messages: DataFrame) -> DataFrame:
    """Digest messages; undecodable ones are skipped."""
    return parse_json(messages.select("value"), "value", S.DIGEST).where(~F.col("bad_json")).drop("value", "bad_json")


def read_decisions(messages: DataFrame) -> DataFrame:
    """Decision messages; undecodable ones are skipped."""
    return parse_json(messages.select("value"), "value", S.DECISION).where(~F.col("bad_json")).drop("value", "bad_json")


def read_audit_inputs(messages: DataFrame) -> DataFrame:
    """(kind, payload text) of audit inputs; a missing or empty kind becomes ``unknown``."""
    rows = parse_json(messages.select("value"), "value", "kind string, payload string").where(~F.col("bad_json"))
    payload = json_member_text(F.col("value"), "payload", F.col("payload"))
    return rows.select(
        F.coalesce(blank_to_null(F.col("kind")), F.lit("unknown")).alias("kind"),
        F.coalesce(payload, F.lit("null")).alias("payload"),
    )


def read_audit(audit: DataFrame, tenant: str) -> DataFrame:
    """One tenant's whole chain in order."""
    return audit.where(F.col("tenant") == tenant).orderBy("sequence")


def scan_events(
    events: DataFrame, start=None, end=None, sources: Sequence[str] = (), event_types: Sequence[str] = (),
    severities: Sequence[str] = (), tenants: Sequence[str] = (),
) -> DataFrame:
    """Filtered scan of the event table; [start, end) and lists are pushed to the files.

    On a table written by ``write_hot_events`` the time range also prunes date partitions.
    """
    out = events
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") < F.lit(end))
    if "event_date" in events.columns:
        if start is not None:
            out = out.where(F.col("event_date") >= F.to_date(F.lit(start)))
        if end is not None:
            out = out.where(F.col("event_date") <= F.to_date(F.lit(end)))
    for column, values in (("source_id", sources), ("event_type", event_types), ("severity", severities)):
        if values:
            out = out.where(F.col(column).isin(list(values)))
    if tenants:
        name = "tenant_id" if "tenant_id" in events.columns else "metadata.tenant_id"
        out = out.where(F.col(name).isin(list(tenants)))
    return out


def scan_audit(audit: DataFrame, start=None, end=None, kinds: Sequence[str] = ()) -> DataFrame:
    """Audit rows of a time range [start, end) and kinds."""
    out = audit
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") < F.lit(end))
    return out.where(F.col("kind").isin(list(kinds))) if kinds else out
