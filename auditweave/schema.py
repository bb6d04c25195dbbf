"""Row types and fixed values of the event, digest, decision, audit and alert tables."""

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
SCHEMA_VERSION = "1.0.0"
SEVERITIES = ["info", "warn", "error", "critical"]  # ascending rank, 0..3
SOURCE_TYPES = ["mysql_cdc", "postgres_cdc", "kafka", "webhook", "synthetic"]
OPERATOR_ACTIONS = ["accept", "override", "annotate"]
DECISION_KINDS = ["decision", "decision_with_precedents"]

MAX_INPUT_BYTES = 65536
MIN_CONFIDENCE = 0.6
INJECTION_PATTERNS = [
    r"ignore (all )?previous instructions",
    r"disregard (the )?(system|developer) (prompt|instructions)",
    r"you are now (a |an )?[a-z]+ assistant",
]

LOW_FRESHNESS = 0.22
LOW_DIVERSITY = 0.38
SPARSE_MIN_K = 4
SPARSE_DIVISOR = 3
THROTTLE_SECONDS = 45

DEFAULT_STRATEGY = 4
DEFAULT_DIVERSITY = 80.0
DEFAULT_K = 20
BATCH_K = 40
WINDOW_SECONDS = 5
DEFAULT_MAX_PRECEDENTS = 5
RECENT_EVENTS = 5000
RECENT_ALERTS = 400
RECENT_DECISIONS = 500
SUPPRESSION_SECONDS = 86400

EXPORT_SLICE = "ingest_digest_ai_operator_export"

DEFAULT_INSTRUCTION = (
    "You are assisting a manufacturing line supervisor.\n"
    "Classify the event (routine / elevated / critical) and propose one concrete operator action "
    "in under two sentences.\n"
    "If evidence is ambiguous, bias toward requesting human review rather than autonomous operational moves."
)
DEFAULT_PRECEDENT_INSTRUCTION = (
    "You are assisting a manufacturing line supervisor.\n"
    "Similar past operator resolutions are provided as precedents.\n"
    "Classify the current event (routine / elevated / critical) and propose concrete operator steps.\n"
    "Never recommend autonomous operational moves; bias toward human review when evidence is ambiguous."
)

# Whitespace removed when a tenant or instruction is trimmed.
TRIM_CHARS = " \t\n\x0b\f\r\x85\xa0"

# --- Row types --------------------------------------------------------------


def _fields(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

METADATA = _fields(("trace_id", _S), ("ingestion_pod", _S), ("schema_version", _S), ("tenant_id", _S))
EVENT = _fields(
    ("event_id", _S), ("source_id", _S), ("source_type", _S), ("event_type", _S), ("severity", _S),
    ("timestamp", _TS), ("ingested_at", _TS), ("payload", _S), ("metadata", METADATA),
)
DIGEST = _fields(
    ("strategy", T.IntegerType()), ("freshness", _D), ("diversity", _D), ("redundancy", _D),
    ("selected_events", T.ArrayType(EVENT)), ("window_end", _TS),
)
RESPONSE = _fields(
    ("classification", _S), ("suggestion", _S), ("confidence", _D), ("requires_review", _B),
    ("reasons", T.ArrayType(_S)),
)
DECISION = _fields(
    ("event_id", _S), ("provider", _S), ("model_id", _S), ("prompt_hash", _S), ("response", RESPONSE),
    ("guardrails", _S), ("operator_review", _B), ("audit_chain_hash", _S), ("audit_chain_prev", _S),
)
AUDIT = _fields(
    ("tenant", _S), ("sequence", _L), ("timestamp", _TS), ("kind", _S), ("payload", _S),
    ("prev_hash", _S), ("hash", _S),
)
ALERT = _fields(
    ("id", _S), ("title", _S), ("body", _S), ("severity", _S), ("rule_id", _S), ("created_at", _TS),
    ("ref", T.MapType(_S, _S)),
)
ROLE = _fields(
    ("name", _S), ("curation_strategy", T.IntegerType()), ("diversity_percent", _D), ("digest_size", T.IntegerType()),
    ("min_severity", _S), ("event_types", T.ArrayType(_S)), ("event_type_prefix", _S),
    ("sources", T.ArrayType(_S)), ("preferred_sources", T.ArrayType(_S)),
)
EVENT_TYPE = _fields(
    ("name", _S), ("default_severity", _S), ("escalate_after_count", T.IntegerType()),
    ("escalate_within_seconds", T.IntegerType()), ("escalated_severity", _S),
)
PACK = _fields(
    ("path", _S), ("name", _S), ("description", _S), ("instruction", _S),
    ("roles", T.ArrayType(ROLE)), ("event_types", T.ArrayType(EVENT_TYPE)),
)
WEBHOOK = _fields(
    ("source_id", _S), ("event_type", _S), ("severity", _S), ("payload", _S), ("timestamp", _TS),
)
