"""Building, checking and filtering canonical events."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import (
    blank_to_null, first_failure, present, replay_safe_id, resolve_tenant, severity_rank,
)


def metadata(trace_id=None, ingestion_pod=None, tenant_id=None, schema_version=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (null if trace_id is None else trace_id).alias("trace_id"),
        (null if ingestion_pod is None else ingestion_pod).alias("ingestion_pod"),
        (F.lit(S.SCHEMA_VERSION) if schema_version is None else schema_version).alias("schema_version"),
        (null if tenant_id is None else tenant_id).alias("tenant_id"),
    )


def new_events(
    df: DataFrame, source_id: Column, source_type: Column, event_type: Column, severity: Column, payload: Column,
    timestamp: Column | None = None, ingested_at: Column | None = None, event_id: Column | None = None,
    ordinal: Column | None = None, meta: Column | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Project any table onto canonical events.

    Without ``event_id`` the id is a hash of source, type, time, payload and ``ordinal``, so that a
    replayed batch yields the same ids. Times default to now.
    """
    now = F.current_timestamp()
    ingested = now if ingested_at is None else ingested_at
    ts = ingested if timestamp is None else F.coalesce(timestamp, ingested)
    if event_id is None:
        parts = [source_id, event_type, F.unix_micros(ts), payload]
        event_id = replay_safe_id(*parts, *([ordinal] if ordinal is not None else []))
    return df.select(
        event_id.alias("event_id"), source_id.alias("source_id"), source_type.alias("source_type"),
        event_type.alias("event_type"), severity.alias("severity"), ts.alias("timestamp"),
        ingested.alias("ingested_at"), payload.alias("payload"),
        (metadata() if meta is None else meta).alias("metadata"), *keep,
    )


def event_failure() -> Column:
    """Reason the event is invalid, null when valid. Checks run in order; the first failure is reported."""
    sev = F.col("severity")
    return first_failure([
        (present(F.col("event_id")), "event_id required"),
        (present(F.col("source_id")), "source_id required"),
        (present(F.col("source_type")), "source_type required"),
        (present(F.col("event_type")), "event_type required"),
        (present(sev), "severity required"),
        (severity_rank(sev) >= 0, F.concat(F.lit('unknown severity "'), F.coalesce(sev, F.lit("")), F.lit('"'))),
        (F.col("timestamp").isNotNull(), "timestamp required"),
        (present(F.col("metadata.schema_version")), "metadata.schema_version required"),
    ])


def validate_events(events: DataFrame) -> DataFrame:
    """Add ``reason`` (null when valid)."""
    return events.withColumn("reason", event_failure())


def strict_failure(raw: Column | None = None) -> Column:
    """Published-schema form: also checks the source type list, required fields and unknown keys.

    ``raw`` is the undecoded JSON text; when given, keys outside the schema are reported.
    """
    checks = [
        (F.col("event_id").isNotNull(), "event_id required"),
        (F.col("source_id").isNotNull(), "source_id required"),
        (F.col("source_type").isin(S.SOURCE_TYPES), "source_type not in list"),
        (F.col("event_type").isNotNull(), "event_type required"),
        (F.col("severity").isin(S.SEVERITIES), "severity not in list"),
        (F.col("timestamp").isNotNull(), "timestamp required"),
        (F.col("ingested_at").isNotNull(), "ingested_at required"),
        (F.col("payload").isNotNull(), "payload required"),
        (F.col("metadata.schema_version").isNotNull(), "metadata.schema_version required"),
    ]
    if raw is not None:
        known = F.array(*[F.lit(n) for n in S.EVENT.fieldNames()])
        checks.append((F.size(F.array_except(F.json_object_keys(raw), known)) == 0, "unknown field"))
    return first_failure(checks)


def validate_events_strict(events: DataFrame, raw: Column | None = None) -> DataFrame:
    return events.withColumn("reason", strict_failure(raw))


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``) of a checked table."""
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def find_event(events: DataFrame, event_id: str) -> DataFrame:
    """First arrival of one event id."""
    return events.where(F.col("event_id") == event_id).orderBy("ingested_at", "timestamp").limit(1)


def operator_queue(events: DataFrame) -> DataFrame:
    """Events for which an operator is offered help: error and critical."""
    return events.where(F.col("severity").isin("error", "critical"))


def with_tenant(events: DataFrame, fallback: str = "") -> DataFrame:
    return events.withColumn("tenant", resolve_tenant(F.col("metadata.tenant_id"), fallback))


def action_failure() -> Column:
    """Reason an operator action is refused, null when accepted."""
    return first_failure([
        (
            present(F.col("event_id")) & present(F.col("decision_hash")) & present(F.col("operator_id")),
            "event_id, decision_hash and operator_id are required",
        ),
        (F.col("action").isin(S.OPERATOR_ACTIONS), "action must be accept, override, or annotate"),
    ])


def valid_operator_action(actions: DataFrame) -> DataFrame:
    return actions.withColumn("reason", action_failure())


def default_severity(events: DataFrame, event_types: DataFrame) -> DataFrame:
    """Fill a missing severity from the pack's event type, else ``info``."""
    defaults = event_types.groupBy(F.col("name").alias("event_type")).agg(F.min("default_severity").alias("_default"))
    filled = F.coalesce(blank_to_null(F.col("severity")), blank_to_null(F.col("_default")), F.lit("info"))
    return events.join(defaults, "event_type", "left").withColumn("severity", filled).drop("_default")


def role_filter(
    events: DataFrame, min_severity: str | None = None, event_types: Sequence[str] = (),
    event_type_prefix: str | None = None, sources: Sequence[str] = (),
) -> DataFrame:
    """Events one operator role may see; conditions given are and-ed and pushed to the scan."""
    out = events
    if min_severity:
        out = out.where(F.col("severity").isin(S.SEVERITIES[S.SEVERITIES.index(min_severity):]))
    if event_types:
        out = out.where(F.col("event_type").isin(list(event_types)))
    if event_type_prefix:
        out = out.where(F.col("event_type").startswith(event_type_prefix))
    if sources:
        out = out.where(F.col("source_id").isin(list(sources)))
    return out
