"""Landed webhook bodies as canonical events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import blank_to_null, first_failure, json_member_text, parse_json, present
from auditweave.operators.validate import event_failure, new_events


def decode_webhooks(bodies: DataFrame, received_at: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    """Events of webhook bodies (JSON text in ``value``) with ``reason`` for refused ones.

    source_id and event_type are required; severity defaults to info, payload to {}, and an own
    timestamp replaces the arrival time.
    """
    field = lambda name: F.col(f"_in_{name}")
    decoded = parse_json(bodies, "value", S.WEBHOOK, "_in_")
    payload = json_member_text(F.col("value"), "payload", field("payload"))
    events = new_events(
        decoded, field("source_id"), F.lit("webhook"), field("event_type"),
        F.coalesce(blank_to_null(field("severity")), F.lit("info")), F.coalesce(payload, F.lit("{}")),
        timestamp=field("timestamp"), ingested_at=received_at, ordinal=ordinal, keep=["value", "_in_bad_json"],
    )
    reason = first_failure([
        (~F.col("_in_bad_json"), "bad json"),
        (present(F.col("source_id")) & present(F.col("event_type")), "source_id and event_type required"),
    ])
    return events.withColumn("reason", F.coalesce(reason, event_failure())).drop("_in_bad_json")


def normalize_webhooks(bodies: DataFrame, received_at: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    return decode_webhooks(bodies, received_at, ordinal).where(F.col("reason").isNull()).drop("reason", "value")
