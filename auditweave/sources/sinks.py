"""Message encodings and writers. Every writer takes a batch frame, so it also serves ``foreachBatch``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import JSON_OPTIONS, resolve_tenant, rfc3339, splice_json


def event_json() -> Column:
    """Canonical event as JSON; the payload is spliced in as stored text."""
    fields = F.struct(
        "event_id", "source_id", "source_type", "event_type", "severity", rfc3339(F.col("timestamp")).alias("timestamp"),
        rfc3339(F.col("ingested_at")).alias("ingested_at"),
        F.struct("metadata.trace_id", "metadata.ingestion_pod", "metadata.schema_version", "metadata.tenant_id").alias("metadata"),
    )
    return splice_json(fields, "payload", F.coalesce("payload", F.lit("null")))


def event_messages(events: DataFrame) -> DataFrame:
    """(key = source_id, value = event JSON)."""
    return events.select(F.col("source_id").alias("key"), event_json().alias("value"))


def digest_messages(digests: DataFrame) -> DataFrame:
    """One JSON message per digest, no key."""
    body = F.struct(*[F.col(f) for f in S.DIGEST.fieldNames()])
    return digests.select(F.lit(None).cast("string").alias("key"), F.to_json(body, JSON_OPTIONS).alias("value"))


def decision_messages(decisions: DataFrame) -> DataFrame:
    """(key = event_id, value = decision JSON)."""
    body = F.struct(*[F.col(f) for f in S.DECISION.fieldNames()])
    return decisions.select(F.col("event_id").alias("key"), F.to_json(body, JSON_OPTIONS).alias("value"))


def write_messages(messages: DataFrame, fmt: str, path: str | None = None, mode: str = "append", **options) -> None:
    """Write (key, value) messages to Kafka (keyed partitions) or to files."""
    writer = messages.write.format(fmt).options(**options)
    writer = writer if fmt == "kafka" else writer.mode(mode)
    writer.save(path) if path else writer.save()


def write_hot_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Event table in one-day partitions with the tenant as its own column.

    The rebalance hint lets AQE split a busy day over many tasks and join small ones; rows are sorted
    by source and time so file statistics can skip sources.
    """
    flat = events.withColumn("tenant_id", resolve_tenant(F.col("metadata.tenant_id"))).withColumn(
        "event_date", F.to_date("timestamp")
    )
    (
        flat.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "source_id", "timestamp")
        .write.mode(mode).partitionBy("event_date").parquet(path)
    )


def write_audit(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append chained records, one directory per tenant."""
    records.write.mode(mode).partitionBy("tenant").parquet(path)


def read_audit_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.AUDIT).parquet(path).select(*S.AUDIT.fieldNames())


def write_dead_letter(rejects: DataFrame, path: str, mode: str = "append") -> None:
    """Rejected rows by reason."""
    rejects.write.mode(mode).json(path)


def live_envelope(df: DataFrame, kind: str, value: Column | None = None) -> DataFrame:
    """(type, data) envelope of one message family: event, digest, decision or alert."""
    data = F.to_json(F.struct(*df.columns), JSON_OPTIONS) if value is None else value
    return df.select(F.lit(kind).alias("type"), data.alias("data"))


def live_feed(events: DataFrame, digests: DataFrame, decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """The four live message families in one table."""
    return (
        live_envelope(events, "event", event_json())
        .unionByName(live_envelope(digests, "digest"))
        .unionByName(live_envelope(decisions, "decision"))
        .unionByName(live_envelope(alerts, "alert"))
    )


def ingest_payload() -> Column:
    """Audit payload of an accepted event."""
    return F.to_json(F.struct("event_id", "source_id"))


def ingest_audit_rows(events: DataFrame, fallback_tenant: str = "") -> DataFrame:
    """One ``ingest`` audit row per accepted event, ready for the chain."""
    return events.select(
        resolve_tenant(F.col("metadata.tenant_id"), fallback_tenant).alias("tenant"),
        F.col("ingested_at").alias("timestamp"), F.lit("ingest").alias("kind"),
        ingest_payload().alias("payload"), F.col("event_id").alias("row_id"),
    )


def export_audit_bundle(records: DataFrame, verdict: DataFrame, path: str) -> None:
    """Verdict manifest (one row per tenant) and the records themselves, side by side."""
    manifest = verdict.select(
        F.lit(S.EXPORT_SLICE).alias("slice"), F.current_timestamp().alias("exported_at"), "tenant",
        F.col("valid").alias("audit_verified"),
        F.when(F.col("valid"), "").otherwise(F.concat(F.lit("first bad sequence "), F.col("first_bad").cast("string")))
        .alias("verify_err"),
        F.col("head_hash").alias("chain_head_hash"),
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    records.write.mode("overwrite").partitionBy("tenant").json(f"{path}/records")
