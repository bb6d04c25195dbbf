"""Guarded model decisions over events.

Status of an event: ``rejected_input`` (text refused, the model is not called), ``provider_error``,
``rejected_output`` (answer refused) or ``pass``. Anything but a pass forces operator review.
"""

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import (
    blank_to_null, first_failure, present, prompt_hash, resolve_tenant, rfc3339, splice_json, trimmed,
)
from auditweave.operators.precedents import PRECEDENT_FIELDS, with_precedents
from auditweave.operators.validate import event_failure

Validator = tuple[str, Callable[[Column], Column]]


def literal_start(pattern: str) -> str:
    """Letters, digits and spaces that every match of ``pattern`` begins with, in lower case; empty where none are certain."""
    plain = re.match(r"[A-Za-z0-9 ]*", pattern)[0]
    outside, groups = re.sub(r"\[[A-Za-z0-9-]+\]", "c", pattern), 1
    while groups:
        outside, groups = re.subn(r"\([^()]*\)", "g", outside)
    if re.search(r"[|\\\[\]()]", outside) or re.search(r"[\\#]", pattern):  # another start may follow, or cannot be told
        return ""
    return (plain[:-1] if pattern[len(plain):len(plain) + 1] in ("?", "*", "+", "{") else plain).lower()


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs in ``text``, whatever the case.

    A text of ASCII characters without the start of any pattern is not searched: a regular expression is tried at every
    character. Other texts always are, as characters beyond ASCII may be the other case of a letter in ASCII.
    """
    found = text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
    starts = [literal_start(p) for p in patterns]
    if not all(starts):
        return found
    begins = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(s)) for s in dict.fromkeys(starts)])
    seen = F.exists(F.array(F.lower(text)), begins)  # an array of one text, so that it is lowered once
    return F.when((F.octet_length(text) > F.char_length(text)) | seen, found).when(text.isNotNull(), False)


@dataclass
class Guardrails:
    """Limits and extra validators. A validator is (reason, column -> true when acceptable)."""

    max_input_bytes: int = S.MAX_INPUT_BYTES
    min_confidence: float = S.MIN_CONFIDENCE
    patterns: Sequence[str] = field(default_factory=lambda: list(S.INJECTION_PATTERNS))
    input_validators: list[Validator] = field(default_factory=list)
    output_validators: list[Validator] = field(default_factory=list)

    def input_failure(self, text: Column) -> Column:
        """Reason the text may not be sent to a model, null when it may."""
        patterns = [(~any_pattern(text, self.patterns), "prompt-injection pattern detected")]
        return first_failure([
            (F.octet_length(text) <= self.max_input_bytes, "input exceeds max bytes"),
            *(patterns if self.patterns else []),
            *[(check(text), why) for why, check in self.input_validators],
        ])

    def output_failure(self, response: Column) -> Column:
        """Reason the answer may not be shown, null when it may."""
        conf = response["confidence"]
        review = F.coalesce(response["requires_review"], F.lit(False))
        return first_failure([
            (present(response["classification"]), "classification required"),
            (conf.between(0.0, 1.0) & ~F.isnan(conf), "confidence out of range"),
            ((conf >= self.min_confidence) | review, "low confidence without requires_review"),
            *[(check(response), why) for why, check in self.output_validators],
        ])


def parse_response(content: Column) -> Column:
    """Model text as a response struct; null for text that is not a JSON object. Absent fields take zero values."""
    r = F.from_json(content, S.RESPONSE)
    ok = content.isNotNull() & F.startswith(F.ltrim(content), F.lit("{")) & F.try_parse_json(content).isNotNull()
    full = F.struct(
        F.coalesce(r["classification"], F.lit("")).alias("classification"),
        F.coalesce(r["suggestion"], F.lit("")).alias("suggestion"),
        F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(r["requires_review"], F.lit(False)).alias("requires_review"),
        r["reasons"].alias("reasons"),
    )
    return F.when(ok, full)


def response(classification, suggestion, confidence, requires_review, reasons=None) -> Column:
    """Response struct from literals or columns."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    why = F.lit(None).cast("array<string>") if reasons is None else (
        reasons if isinstance(reasons, Column) else F.array(*[F.lit(x) for x in reasons]).cast("array<string>"))
    return F.struct(
        c(classification).cast("string").alias("classification"), c(suggestion).cast("string").alias("suggestion"),
        c(confidence).cast("double").alias("confidence"), c(requires_review).cast("boolean").alias("requires_review"),
        why.alias("reasons"),
    )


@dataclass
class ColumnProvider:
    """Answers computed by expressions over the event row; ``error`` is null on success."""

    name: str
    model_id: str
    answer: Column
    error: Column | None = None

    def score(self, rows: DataFrame) -> DataFrame:
        err = F.lit(None).cast("string") if self.error is None else self.error
        return rows.withColumn("provider_error", err).withColumn(
            "response", F.when(F.col("provider_error").isNull(), self.answer)
        )


@dataclass
class BatchProvider:
    """Any model client: ``call(frame with context, instruction) -> texts`` (JSON answers; None = error).

    Runs on Arrow batches in the tasks that hold the events; build clients inside ``call``. An exception
    marks the rows of that batch as provider errors.
    """

    name: str
    model_id: str
    call: Callable[[pd.DataFrame], Sequence[str | None]]

    def score(self, rows: DataFrame) -> DataFrame:
        call = self.call

        @F.pandas_udf("struct<content: string, error: string>")
        def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for context, instruction in parts:
                try:
                    texts = list(call(pd.DataFrame({"context": context, "instruction": instruction})))
                    errors = [None if t is not None else "empty response" for t in texts]
                except Exception as exc:  # the provider's failure is data here, not a task failure
                    texts, errors = [None] * len(context), [str(exc) or type(exc).__name__] * len(context)
                yield pd.DataFrame({"content": texts, "error": errors})

        # A model is not a function of its input: Catalyst must neither repeat nor move the call.
        scored = rows.withColumn("_r", ask.asNondeterministic()("context", "instruction"))
        parsed = scored.withColumn("response", parse_response(F.col("_r.content")))
        bad = F.when(F.col("response").isNull(), F.lit("response is not a JSON object"))
        return parsed.withColumn("provider_error", F.coalesce(F.col("_r.error"), bad)).drop("_r")


Provider = ColumnProvider | BatchProvider


def precedents_json() -> Column:
    """Precedents as JSON; empty optional texts are left out."""
    optional = {"event_id", "classification", "suggestion", "annotation", "operator_audit_hash"}
    trimmed_rows = F.transform("precedents", lambda p: F.struct(*[
        (blank_to_null(p[f]) if f in optional else p[f]).alias(f) for f in PRECEDENT_FIELDS
    ]))
    return F.when(F.size("precedents") > 0, F.to_json(trimmed_rows)).otherwise("null")


def decision_context(with_precedent_list: bool = False) -> Column:
    """JSON handed to the model, keys in alphabetical order, payload as stored."""
    head, tail = F.struct("event_id", "event_type"), F.struct("severity", "source_id", rfc3339(F.col("timestamp")).alias("timestamp"))
    payload = F.coalesce(F.col("payload"), F.lit("null"))
    if with_precedent_list:
        payload = F.concat(payload, F.lit(',"precedents":'), precedents_json())
    return splice_json(head, "payload", payload, tail)


def resolve_instruction(requested: Column, pack: Column | None = None, default: str = S.DEFAULT_INSTRUCTION) -> Column:
    """Request text, else the pack's instruction, else the built-in default."""
    choices = [blank_to_null(trimmed(requested))]
    if pack is not None:
        choices.append(blank_to_null(pack))
    return F.coalesce(*choices, F.lit(default))


def decide(
    events: DataFrame, instruction: Column | str, provider: Provider, guardrails: Guardrails | None = None,
    precedents: bool = False,
) -> DataFrame:
    """One decision per valid event; invalid events are left out (see ``validate_events``).

    The provider only sees events whose text passed the input checks. Result: the event's columns plus
    provider, model_id, prompt_hash, response, guardrails, operator_review and reason.
    """
    g = guardrails or Guardrails()
    instr = F.lit(instruction) if isinstance(instruction, str) else instruction
    ready = (
        events.where(event_failure().isNull())
        .withColumn("context", decision_context(precedents)).withColumn("instruction", instr)
        .withColumn("prompt_hash", prompt_hash(F.col("context"), F.col("instruction")))
        .withColumn("_refused", g.input_failure(F.concat("context", F.lit("\n"), "instruction")))
    )
    if isinstance(provider, ColumnProvider):  # pure expressions: one pass, no split
        scored = provider.score(ready)
    else:
        refused = ready.where(F.col("_refused").isNotNull())
        refused = refused.withColumn("provider_error", F.lit(None).cast("string")).withColumn(
            "response", F.lit(None).cast(S.RESPONSE)
        )
        scored = provider.score(ready.where(F.col("_refused").isNull())).unionByName(refused)
    out_reason = F.when(F.col("response").isNotNull(), g.output_failure(F.col("response")))
    status = (
        F.when(F.col("_refused").isNotNull(), "rejected_input")
        .when(F.col("provider_error").isNotNull(), "provider_error")
        .when(F.col("_out").isNotNull(), "rejected_output")
        .otherwise("pass")
    )
    # The outcome is produced by a generator: a later filter on it is then evaluated on its result
    # instead of being rewritten, checks, hashes and all, into every plan node below.
    outcome = F.struct(
        F.when(F.col("_status").isin("pass", "rejected_output"), F.col("response")).alias("response"),
        F.col("_status").alias("guardrails"),
        F.coalesce("_refused", "provider_error", "_out").alias("reason"),
        F.when(F.col("_status") == "pass", F.coalesce(F.col("response.requires_review"), F.lit(False))).otherwise(True)
        .alias("operator_review"),
    )
    judged = scored.withColumn("_out", out_reason).withColumn("_status", status)
    kept = [c for c in judged.columns if c not in _SCRATCH]
    return judged.select(
        *kept, F.inline(F.array(outcome)).alias("response", "guardrails", "reason", "operator_review"),
        F.lit(provider.name).alias("provider"), F.lit(provider.model_id).alias("model_id"),
    )


_SCRATCH = {"_refused", "_out", "_status", "response", "provider_error", "context", "instruction"}


def _response_json() -> Column:
    r = F.col("response")
    return F.struct(
        r["classification"].alias("classification"), r["suggestion"].alias("suggestion"),
        r["confidence"].alias("confidence"), r["requires_review"].alias("requires_review"),
        F.when(F.size(r["reasons"]) > 0, r["reasons"]).alias("reasons"),
    )


def decision_audit_rows(decisions: DataFrame, chain_tenant: str = "default", at: str = "ingested_at") -> DataFrame:
    """Audit rows of plain decisions: one per decision, kind by status, payload keys in alphabetical order.

    Passing decisions name the event's tenant in the payload, the others the chain's, as recorded by
    the service that writes them. All go to the event's tenant chain.
    """
    event_tenant = resolve_tenant(F.col("metadata.tenant_id"), chain_tenant)
    common = [F.col("event_id"), F.col("model_id"), F.col("prompt_hash"), F.col("provider")]
    passed = F.to_json(F.struct(
        "event_id", "event_type", F.col("guardrails").alias("guardrails_status"), "model_id", "operator_review",
        "prompt_hash", "provider", _response_json().alias("response"), "severity", "source_id",
        event_tenant.alias("tenant"),
    ))
    tenant = F.lit(chain_tenant).alias("tenant")
    bad_input = F.to_json(F.struct(*common, "reason", tenant))
    bad_output = F.to_json(F.struct(*common, "reason", _response_json().alias("response"), tenant))
    failed = F.to_json(F.struct(F.col("reason").alias("error"), *common, tenant))
    payload = (
        F.when(F.col("guardrails") == "pass", passed).when(F.col("guardrails") == "rejected_input", bad_input)
        .when(F.col("guardrails") == "rejected_output", bad_output).otherwise(failed)
    )
    kind = F.when(F.col("guardrails") == "pass", "decision").otherwise(F.concat(F.lit("decision_"), F.col("guardrails")))
    return decisions.select(
        event_tenant.alias("tenant"), F.col(at).alias("timestamp"), kind.alias("kind"), payload.alias("payload"),
        F.col("event_id").alias("row_id"),
    )


def operator_action_rows(actions: DataFrame, at: str = "acted_at") -> DataFrame:
    """Audit rows of accepted operator actions (event_id, decision_hash, operator_id, action, annotation, tenant)."""
    body = F.to_json(F.struct(
        "action", F.coalesce("annotation", F.lit("")).alias("annotation"), F.col("decision_hash").alias("decision_id"),
        "operator_id", "tenant",
    ))
    return actions.select(
        "tenant", F.col(at).alias("timestamp"), F.lit("operator_action").alias("kind"), body.alias("payload"),
        F.concat_ws("~", "decision_hash", "operator_id", "event_id").alias("row_id"),
    )


def build_steps(response_col: Column, precedents: Column, status: Column) -> Column:
    """Steps shown to the operator: the answer, then one per precedent; blocked decisions get one fixed step."""
    def step(text, cited):
        return F.struct(text.alias("text"), cited.alias("cited_precedent_hash"))

    no_hash = F.lit(None).cast("string")
    first = step(F.concat(response_col["classification"], F.lit(" — "), response_col["suggestion"]), no_hash)

    def cite(p):
        note = F.when(present(p["annotation"]), F.concat(F.lit(" — "), p["annotation"])).otherwise("")
        idea = F.when(present(p["suggestion"]), F.concat(F.lit(" (AI had suggested: "), p["suggestion"], F.lit(")"))).otherwise("")
        text = F.concat(
            F.lit("Prior "), p["classification"], F.lit(" on similar "), p["event_type"], F.lit("/"), p["severity"],
            F.lit(": operator "), p["operator_action"], note, idea,
        )
        return step(text, p["decision_hash"])

    what = F.coalesce(blank_to_null(response_col["suggestion"]), status)
    blocked = step(F.concat(F.lit("Suggestion blocked by guardrails ("), what, F.lit("); review manually.")), no_hash)
    return F.when(status == "pass", F.concat(F.array(first), F.transform(precedents, cite))).otherwise(F.array(blocked))


def suggest_with_precedents(
    events: DataFrame, audit: DataFrame, provider: Provider, instruction: Column | str = "",
    max_n: int = S.DEFAULT_MAX_PRECEDENTS, guardrails: Guardrails | None = None, chain_tenant: str = "default",
) -> DataFrame:
    """Decisions informed by precedents, with operator steps. Adds tenant, precedents and steps."""
    instr = F.lit(instruction) if isinstance(instruction, str) else instruction
    instr = F.coalesce(blank_to_null(instr), F.lit(S.DEFAULT_PRECEDENT_INSTRUCTION))
    asked = events.withColumn("tenant", resolve_tenant(F.col("metadata.tenant_id"), chain_tenant))
    decided = decide(with_precedents(asked, audit, max_n), instr, provider, guardrails, precedents=True)
    return decided.withColumn("steps", build_steps(F.col("response"), F.col("precedents"), F.col("guardrails")))


def suggestion_audit_rows(suggestions: DataFrame, at: str = "ingested_at") -> DataFrame:
    """Audit rows of precedent-informed decisions: kind decision_with_precedents on a pass."""
    passed = F.col("guardrails") == "pass"
    body = F.to_json(F.struct(
        "event_id", "event_type", F.col("guardrails").alias("guardrails_status"), "model_id",
        F.when(passed, F.col("operator_review")).alias("operator_review"),
        F.size("precedents").alias("precedent_count"),
        F.when(passed, F.transform("precedents", lambda p: p["decision_hash"])).alias("precedent_hashes"),
        "prompt_hash", "provider", F.when(~passed, F.col("reason")).alias("reason"),
        F.when(F.col("response").isNotNull(), _response_json()).alias("response"), "severity", "source_id", "tenant",
    ))
    kind = F.when(passed, "decision_with_precedents").otherwise(F.concat(F.lit("decision_"), F.col("guardrails")))
    return suggestions.select(
        "tenant", F.col(at).alias("timestamp"), kind.alias("kind"), body.alias("payload"), F.col("event_id").alias("row_id")
    )


def chained_decisions(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Decisions with the hashes of their audit records (``records`` from ``append_chain``, joined on row_id)."""
    r = records.where(F.col("kind").startswith("decision")).select(
        F.col("row_id").alias("event_id"), F.col("hash").alias("audit_chain_hash"), F.col("prev_hash").alias("audit_chain_prev")
    )
    return decisions.join(r, "event_id")


def shadow_compare(primary: DataFrame, shadow: DataFrame) -> DataFrame:
    """Per pair of outcomes of two providers on the same events: count and agreement.

    The shadow's decisions are only compared, never published.
    """
    label = F.coalesce(F.col("response.classification"), F.col("guardrails"))
    a = primary.select("event_id", label.alias("primary_label"))
    b = shadow.select("event_id", label.alias("shadow_label"))
    counts = a.join(b, "event_id").groupBy("primary_label", "shadow_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("agree", F.col("primary_label") == F.col("shadow_label"))
