"""Past operator resolutions that match an event."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import normalize_tenant, parse_json, present
from auditweave.functions.ranking import top_n

_DECISION_PAYLOAD = (
    "event_id string, event_type string, source_id string, severity string, tenant string, "
    "guardrails_status string, response struct<classification string, suggestion string>"
)
_ACTION_PAYLOAD = "decision_id string, action string, annotation string, operator_id string"

PRECEDENT_FIELDS = [
    "decision_hash", "event_id", "event_type", "source_id", "severity", "tenant", "classification", "suggestion",
    "operator_action", "annotation", "operator_audit_hash",
]


def passed_decisions(audit: DataFrame) -> DataFrame:
    """Decisions that passed the guardrails, decoded from the chain (tenant = chain)."""
    stored = audit.where(F.col("kind").isin(S.DECISION_KINDS)).select(
        F.col("tenant").alias("chain"), F.col("hash").alias("decision_hash"), F.col("sequence").alias("decision_seq"), "payload"
    )
    rows = parse_json(stored, "payload", _DECISION_PAYLOAD).where(~F.col("bad_json"))
    status = F.coalesce(F.col("guardrails_status"), F.lit(""))
    return rows.where(status.isin("", "pass")).select(
        "chain", "decision_hash", "decision_seq", "event_id", "event_type", "source_id", "severity",
        normalize_tenant(F.col("tenant")).alias("tenant"),
        F.coalesce("response.classification", F.lit("")).alias("classification"),
        F.coalesce("response.suggestion", F.lit("")).alias("suggestion"),
    )


def operator_actions(audit: DataFrame) -> DataFrame:
    """Operator actions that name a decision, decoded from the chain."""
    stored = audit.where(F.col("kind") == "operator_action").select(
        F.col("tenant").alias("chain"), F.col("hash").alias("operator_audit_hash"), F.col("sequence").alias("action_seq"),
        F.col("timestamp").alias("acted_at"), "payload",
    )
    rows = parse_json(stored, "payload", _ACTION_PAYLOAD).where(~F.col("bad_json") & present(F.col("decision_id")))
    return rows.select(
        "chain", F.col("decision_id").alias("decision_hash"), F.col("action").alias("operator_action"),
        F.coalesce("annotation", F.lit("")).alias("annotation"), "operator_id", "operator_audit_hash", "action_seq", "acted_at",
    )


def paired(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions with their actions; those without a partner drop out.

    The hash is the first key: rows are sorted by it, and chains have few different names.
    """
    rest = [c for c in actions.columns if c not in decisions.columns]
    return decisions.join(actions, ["decision_hash", "chain"]).select(*decisions.columns, *rest)


def resolved_precedents(audit: DataFrame) -> DataFrame:
    """Passing decisions with their operator actions; decisions or actions without a partner drop out."""
    return paired(passed_decisions(audit), operator_actions(audit).drop("operator_id", "acted_at"))


def orphan_actions(audit: DataFrame) -> DataFrame:
    """Operator actions whose decision is not in the chain."""
    known = audit.where(F.col("kind").startswith("decision")).select(
        F.col("tenant").alias("chain"), F.col("hash").alias("decision_hash")
    )
    return operator_actions(audit).join(known, ["chain", "decision_hash"], "left_anti")


def _newest():
    return [F.col("decision_seq").desc(), F.col("action_seq").desc()]


def find_precedents(
    audit: DataFrame, event_type: str, source_id: str, severity: str, tenant: str = "",
    max_n: int = S.DEFAULT_MAX_PRECEDENTS,
) -> DataFrame:
    """Precedents of one event, newest decision first. An empty criterion matches nothing."""
    max_n = max_n if max_n > 0 else S.DEFAULT_MAX_PRECEDENTS
    found = resolved_precedents(audit)
    if not (event_type and source_id and severity):
        return found.limit(0)
    match = (
        (F.lower("event_type") == event_type.lower())
        & (F.col("source_id") == source_id)
        & (F.lower("severity") == severity.lower())
        & (F.col("tenant") == normalize_tenant(F.lit(tenant)))
    )
    return found.where(match).orderBy(*_newest()).limit(max_n)


def _match_keys(df: DataFrame, tenant: str) -> DataFrame:
    keyed = df.withColumn("_type", F.lower("event_type")).withColumn("_sev", F.lower("severity")).withColumn(
        "_tenant", normalize_tenant(F.col(tenant))
    )
    return keyed.withColumn("_match", F.xxhash64(*_KEYS[1:]))


#: A hash of the key comes first: sorts compare it and seldom the texts, of which types, severities and tenants are few.
_KEYS = ["_match", "_type", "source_id", "_sev", "_tenant"]


#: A decoded decision with one of its actions, as jobs store it.
STORED = (
    "chain string, decision_hash string, decision_seq long, event_id string, event_type string, source_id string, severity string, "
    "tenant string, classification string, suggestion string, operator_action string, annotation string, "
    "operator_audit_hash string, action_seq long"
)


def _ranked(pairs: DataFrame, max_n: int) -> DataFrame:
    max_n = max_n if max_n > 0 else S.DEFAULT_MAX_PRECEDENTS
    keyed = _match_keys(pairs, "tenant").where(
        present(F.col("event_type")) & present(F.col("source_id")) & present(F.col("severity"))
    )
    return top_n(keyed, _KEYS, _newest(), max_n, rank="precedent_rank", salt_by="operator_audit_hash")


def newest_rows(pairs: DataFrame, max_n: int = S.DEFAULT_MAX_PRECEDENTS) -> DataFrame:
    """The ``max_n`` newest of resolved precedents per match key, with their columns as in ``STORED``."""
    return _ranked(pairs, max_n).select(*[c.split()[0] for c in STORED.split(", ")])


def as_lists(
    pairs: DataFrame, max_n: int = S.DEFAULT_MAX_PRECEDENTS, fields: Sequence[str] = PRECEDENT_FIELDS,
) -> DataFrame:
    """At most ``max_n`` precedents per match key, as one array per key, newest first; of each only ``fields``.

    The array is collected over the window that ranked the rows, so that they are neither sorted nor grouped again.
    """
    whole = Window.partitionBy(*_KEYS).orderBy(*_newest()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arrays = _ranked(pairs, max_n).withColumn("precedents", F.collect_list(F.struct(*fields)).over(whole))
    return arrays.where("precedent_rank = 1").select(*_KEYS, "precedents")


def newest_precedents(audit: DataFrame, max_n: int = S.DEFAULT_MAX_PRECEDENTS) -> DataFrame:
    """At most ``max_n`` precedents per match key, as one array per key, newest first.

    The ranking does not depend on the event asking, so the list is cut before any event is joined.
    """
    return as_lists(resolved_precedents(audit), max_n)


def with_lists(events: DataFrame, lists: DataFrame) -> DataFrame:
    """Events (with a ``tenant`` column) plus their precedents array, empty when there is none.

    One row per event goes in and out: the join is many-to-one, so a key shared by very many events
    is left to AQE's skew split and never multiplies rows.
    """
    joined = _match_keys(events, "tenant").join(lists, _KEYS, "left").drop("_match", "_type", "_sev", "_tenant")
    empty = F.array().cast(lists.schema["precedents"].dataType)
    return joined.withColumn("precedents", F.coalesce("precedents", empty))


def with_precedents(events: DataFrame, audit: DataFrame, max_n: int = S.DEFAULT_MAX_PRECEDENTS) -> DataFrame:
    """``with_lists`` over the precedents of an audit log."""
    return with_lists(events, newest_precedents(audit, max_n))


def precedents_for_events(events: DataFrame, audit: DataFrame, max_n: int = S.DEFAULT_MAX_PRECEDENTS) -> DataFrame:
    """One row per (event, precedent): event_id, precedent_rank and the precedent's fields."""
    return listed_rows(events, newest_precedents(audit, max_n))


def listed_rows(events: DataFrame, lists: DataFrame) -> DataFrame:
    """``precedents_for_events`` with the lists given."""
    listed = with_lists(events.select("event_id", "event_type", "source_id", "severity", "tenant"), lists)
    rows = listed.select("event_id", F.posexplode("precedents").alias("_i", "precedent"))
    return rows.select("event_id", (F.col("_i") + 1).alias("precedent_rank"), "precedent")
