"""Recency lists, feeds, statistics and status reports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import micros, parse_json, severity_rank
from auditweave.functions.ranking import positions, time_cell, top_n
from auditweave.operators.precedents import operator_actions


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per event_id, the first arrival. Partial group limits keep a much repeated id small."""
    order = [F.col("ingested_at").asc(), F.col("timestamp").asc(), F.col("source_id").asc(), F.col("payload").asc()]
    return top_n(events, ["event_id"], order, 1)


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("timestamp").desc(), F.col("event_id").asc())


def recent(df: DataFrame, n: int, arrival: str = "ingested_at", by: Sequence[str] = (), tie: str = "event_id") -> DataFrame:
    """Newest n rows by arrival, per group if ``by`` is given."""
    return top_n(df, list(by), [F.col(arrival).desc(), F.col(tie).desc()], n, salt_by=tie)


def feed_order(events: DataFrame) -> DataFrame:
    """Operator feed: most severe first, newest first within a severity."""
    return events.orderBy(severity_rank(F.col("severity")).desc(), F.col("timestamp").desc(), F.col("event_id").asc())


def recent_decisions(decisions: DataFrame, n: int = 12, arrival: str = "ingested_at") -> DataFrame:
    return recent(decisions, n, arrival)


def recent_audit(audit: DataFrame, n: int = 50) -> DataFrame:
    return audit.orderBy(F.col("timestamp").desc(), F.col("tenant"), F.col("sequence").desc()).limit(n)


def decisions_with_events(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions joined to their event; the event id is deduplicated first."""
    return decisions.join(dedup_events(events), "event_id")


def decision_status(audit: DataFrame) -> DataFrame:
    """Every decision record with its latest operator action, null while open."""
    act = operator_actions(audit)
    latest = act.groupBy("chain", "decision_hash").agg(
        F.max_by(F.struct("operator_action", "operator_id", "acted_at"), "action_seq").alias("_last")
    )
    decisions = audit.where(F.col("kind").startswith("decision")).select(
        F.col("tenant").alias("chain"), "sequence", "kind", F.col("hash").alias("decision_hash"),
        "payload",
    )
    # one parse for the four members
    decisions = parse_json(decisions, "payload", "event_id string, provider string, model_id string, operator_review string").drop("payload", "bad_json")
    return (
        decisions.join(latest, ["chain", "decision_hash"], "left")
        .select("*", F.col("_last.operator_action").alias("operator_action"), F.col("_last.operator_id").alias("operator_id"),
                F.col("_last.acted_at").alias("operator_action_at"))
        .drop("_last").withColumnRenamed("chain", "tenant")
    )


def decision_quality(status: DataFrame, by: Sequence[str] = ("provider", "model_id", "tenant")) -> DataFrame:
    """Outcome counts and rates over ``decision_status`` rows."""
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    passed = F.col("kind").isin(S.DECISION_KINDS)
    return status.groupBy(*by).agg(
        F.count(F.lit(1)).alias("decisions"), F.sum(passed.cast("long")).alias("passed"),
        count("decision_rejected_input").alias("rejected_input"), count("decision_rejected_output").alias("rejected_output"),
        count("decision_provider_error").alias("provider_errors"), share(passed).alias("pass_rate"),
        share(~passed | (F.col("operator_review") == "true")).alias("review_rate"),
        share(F.col("operator_action") == "override").alias("override_rate"),
    )


def audit_kind_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("tenant", "kind").agg(F.count(F.lit(1)).alias("records"))


def digest_quality_trend(scores: DataFrame, period: Column) -> DataFrame:
    """Mean scores per strategy and period."""
    return scores.groupBy(period.alias("period"), "strategy").agg(
        F.avg("freshness").alias("freshness"), F.avg("diversity").alias("diversity"), F.avg("redundancy").alias("redundancy"),
        F.count(F.lit(1)).alias("digests"),
    )


def health_report(verdict: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: chains with their total length, validity, newest head and first error, and the events and alerts there are.

    ``verdict`` comes from ``verify_chain``. The head shown is that of the longest chain; the error names the first
    broken tenant.
    """
    error = F.concat(F.col("tenant"), F.lit(": first bad sequence "), F.col("first_bad").cast("string"))
    chain = verdict.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("audit_chain_length"),
        F.coalesce(F.bool_and("valid"), F.lit(True)).alias("audit_chain_valid"),
        F.count(F.lit(1)).alias("chains"),
        F.max_by("head_hash", F.struct("length", "tenant")).alias("audit_head_hash"),
        F.coalesce(F.min(F.when(~F.col("valid"), error)), F.lit("")).alias("verify_err"),
    )
    n_events = events.agg(F.count(F.lit(1)).alias("recent_events"))
    n_alerts = alerts.agg(F.count(F.lit(1)).alias("alerts_buffered"))
    # three one-row aggregates side by side
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(chain).join(one(n_events), "_one").join(one(n_alerts), "_one").drop("_one")
    return out.withColumn("status", F.when(F.col("audit_chain_valid"), "ok").otherwise("degraded"))


def source_stats(events: DataFrame, as_of: Column, stalled_after: float = 90.0, error_col: Column | None = None) -> DataFrame:
    """Per source: events emitted, errors, last event, lag, health. Heartbeats are events, so they count as life.

    Newest event type rides along as ``details``.
    """
    err = F.lit(0) if error_col is None else error_col.cast("int")
    lag = (micros(as_of) - micros(F.col("last_event_at"))) / 1e6
    stats = events.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("events_emitted"), F.sum(err).cast("long").alias("errors_seen"),
        F.max("timestamp").alias("last_event_at"), F.max("source_type").alias("source_type"),
    )
    return (
        stats.withColumn("lag_seconds", lag).withColumn("healthy", F.col("lag_seconds") <= stalled_after)
        .withColumn("details", F.create_map(F.lit("source_id"), F.col("source_id"), F.lit("source_type"), F.col("source_type")))
    )


def escalation_rules(event_types: DataFrame) -> DataFrame:
    """One rule per event type; if several packs name a type, the one with the smallest count, then the shortest time."""
    rules = event_types.where(F.col("escalate_after_count") > 0).select(
        F.col("name").alias("event_type"), F.col("escalate_after_count").alias("_n"),
        (F.col("escalate_within_seconds").cast("long") * 1_000_000).alias("_span"), "escalated_severity",
    )
    return rules.groupBy("event_type").agg(F.min(F.struct("_n", "_span", "escalated_severity")).alias("_r")).select("event_type", "_r.*")


def escalate_repeats(events: DataFrame, event_types: DataFrame) -> DataFrame:
    """Raise severity when a source repeats an event type: the N-th event within S seconds and those after it.

    ``event_types`` rows: name, escalate_after_count (N), escalate_within_seconds (S),
    escalated_severity. An event escalates when the (N-1)-th event before it, same source and type,
    is at most S seconds old. Events are numbered per source and type without bringing them together, and each
    finds that earlier event by its number, so a busy source spreads over tasks and rules may be any number. Events
    without a source or time cannot be counted and never escalate.
    """
    joined = events.join(escalation_rules(event_types), "event_type", "left")
    countable = F.col("_n").isNotNull() & F.col("source_id").isNotNull() & F.col("timestamp").isNotNull()
    ruled = joined.where(countable).withColumn("_us", micros(F.col("timestamp"))).withColumn("_cell", time_cell(F.col("_us")))
    plain = joined.where(~countable).withColumn("escalated", F.lit(False))
    numbered = positions(ruled, ["source_id", "event_type"], "_cell", [F.col("_us"), F.col("event_id")], "_at")
    earlier = numbered.select("source_id", "event_type", (F.col("_at") + F.col("_n") - 1).alias("_at"), F.col("_us").alias("_nth_back"))
    hit = F.coalesce(F.col("_nth_back") >= F.col("_us") - F.col("_span"), F.lit(False))
    counted = (
        numbered.join(earlier, ["source_id", "event_type", "_at"], "left").withColumn("escalated", hit)
        .withColumn("severity", F.when(F.col("escalated"), F.col("escalated_severity")).otherwise(F.col("severity")))
    )
    cols = [*events.columns, "escalated"]
    return counted.select(*cols).unionByName(plain.select(*cols))
