"""Column expressions used by more than one operator. All stay in generated JVM code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave import schema as S


def severity_rank(severity: Column) -> Column:
    """info 0 < warn 1 < error 2 < critical 3; anything else -1."""
    rank = F.lit(-1)
    for i, name in enumerate(S.SEVERITIES):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def age_micros(ref: Column, ts: Column) -> Column:
    """Age at ``ref`` in microseconds; events from the future count as fresh (0)."""
    return F.greatest(micros(ref) - micros(ts), F.lit(0).cast("long"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(S.TRIM_CHARS))


def normalize_tenant(c: Column) -> Column:
    return F.coalesce(blank_to_null(trimmed(c)), F.lit("default"))


def resolve_tenant(event_tenant: Column, fallback: str | Column = "") -> Column:
    """Event tenant, else the caller's fallback, else ``default``; blank counts as missing."""
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(blank_to_null(trimmed(event_tenant)), blank_to_null(trimmed(fb)), F.lit("default"))


def rfc3339(ts: Column) -> Column:
    """UTC text with the fraction's trailing zeros dropped (``2024-01-01T00:00:07.5Z``).

    Goes through a zone-free timestamp, so the text (and any hash over it) does not depend on the
    session's zone.
    """
    epoch = F.lit("1970-01-01").cast("date").cast("timestamp_ntz")
    utc = F.timestamp_add("MICROSECOND", micros(ts), epoch).cast("string")
    return F.concat(F.translate(utc, " ", "T"), F.lit("Z"))


# Timestamps in JSON messages keep microseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def render_binary(c: Column) -> Column:
    """Bytes as text, or base64 when a control byte other than tab, LF, CR occurs."""
    text = c.cast("string")
    control = text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    unbroken = F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))  # Spark breaks base64 lines at 76 characters
    return F.when(control, unbroken).otherwise(F.make_valid_utf8(text))


def json_safe(payload: Column) -> Column:
    """Escape the three characters that JSON writers for the web escape, for stable hashing."""
    out = F.replace(payload, F.lit("&"), F.lit("\\u0026"))
    out = F.replace(out, F.lit("<"), F.lit("\\u003c"))
    return F.replace(out, F.lit(">"), F.lit("\\u003e"))


def json_string(c: Column) -> Column:
    """JSON string literal of a text column."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def parse_json(df: DataFrame, text: str, schema: T.StructType | str, prefix: str = "") -> DataFrame:
    """Add one column per schema field, and ``{prefix}bad_json`` for text that does not fit the schema.

    The parse sits in a generator, which Catalyst neither repeats per field nor moves filters into.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col(text), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [prefix + f for f in wanted.fieldNames()]
    out = df.select("*", F.inline(F.array(parsed)).alias(*names, prefix + "bad_json"))
    return out.withColumn(prefix + "bad_json", F.col(text).isNull() | F.col(prefix + "bad_json").isNotNull())


def json_member_text(document: Column, key: str, text: Column) -> Column:
    """JSON text of a member that was read as a string: the quotes are put back if it was a JSON string.

    Only documents in which the key seems to be followed by a quote are looked at twice.
    """
    suspect = document.rlike(f'"{key}"\\s*:\\s*"')
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant"))
    return F.when(suspect & (kind == "STRING"), json_string(text)).otherwise(text)


def splice_json(before: Column, key: str, raw: Column, after: Column | None = None) -> Column:
    """JSON object with an already encoded member between the members of two structs.

    The member is spliced in as stored text, never parsed and written again, so a hash over the result
    depends on nothing but the stored bytes. Each struct needs at least one field that is not null.
    """
    head = F.to_json(before)
    parts = [F.substring(head, F.lit(1), F.length(head) - 1), F.lit(f',"{key}":'), raw]
    if after is None:
        return F.concat(*parts, F.lit("}"))
    return F.concat(*parts, F.lit(","), F.substring(F.to_json(after), 2, 2**31 - 1))


def record_prefix(sequence: Column, timestamp: Column, kind: Column, payload: Column) -> Column:
    """Everything of the hashed record body up to the previous hash."""
    return F.concat(
        F.lit('{"sequence":'), sequence.cast("string"),
        F.lit(',"timestamp":"'), rfc3339(timestamp),
        F.lit('","kind":'), json_string(kind),
        F.lit(',"payload":'), json_safe(F.coalesce(payload, F.lit("null"))),
        F.lit(',"prev_hash":"'),
    )


RECORD_SUFFIX = '"}'


def record_hash(sequence: Column, timestamp: Column, kind: Column, payload: Column, prev_hash: Column) -> Column:
    """SHA-256 over {sequence, timestamp, kind, payload, prev_hash}; the hash itself is excluded."""
    body = F.concat(record_prefix(sequence, timestamp, kind, payload), prev_hash, F.lit(RECORD_SUFFIX))
    return F.sha2(body, 256)


def prompt_hash(context: Column, instruction: Column) -> Column:
    return F.sha2(F.concat(context, F.char(F.lit(0)), instruction), 256)


def replay_safe_id(*parts: Column) -> Column:
    """Identifier that is the same when a batch is computed again.

    The parts are hashed as a JSON object, which keeps nulls and separators inside the parts apart.
    """
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def content_fingerprint(source_id: Column, event_type: Column, payload: Column) -> Column:
    return replay_safe_id(source_id, event_type, payload)


def first_failure(checks: list[tuple[Column, str | Column]]) -> Column:
    """Reason of the first check that does not hold, null when all hold.

    A check that evaluates to null counts as failed.
    """
    reason = F.lit(None).cast("string")
    for ok, why in reversed(checks):
        text = why if isinstance(why, Column) else F.lit(why)
        reason = F.when(F.coalesce(ok, F.lit(False)), reason).otherwise(text)
    return reason


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")
