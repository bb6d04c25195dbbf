"""Alert rules over events, digests, decisions, actions and chain checks, and their throttle.

The throttle is greedy: an alert is kept when at least ``seconds`` passed since the last *kept* alert of
its key. Keys with few alerts are folded in one array expression. A key with many alerts (a rule that
fires all the time may hold a third of all rows) is cut into blocks of equally many times: each block reports, for every
state it could be entered with, the time of its last kept alert; a walk over these few block summaries
gives the true entry state of every block that keeps an alert; then all these are resolved in parallel. The result equals
the serial walk.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import blank_to_null, micros, present, replay_safe_id, severity_rank, trimmed
from auditweave.functions.ranking import positions, time_cell, top_n

# --- Rules ---------------------------------------------------------------------


def _alert(title: Column, body: Column, severity: Column, rule: str, at: Column, ref: Column) -> Column:
    return F.struct(
        replay_safe_id(F.lit(rule), F.unix_micros(at), title, body).alias("id"), title.alias("title"), body.alias("body"),
        severity.alias("severity"), F.lit(rule).alias("rule_id"), at.alias("created_at"),
        ref.cast("map<string,string>").alias("ref"),
    )


def _ref(**items: Column) -> Column:
    flat = []
    for k, v in items.items():
        flat += [F.lit(k), v.cast("string")]
    return F.create_map(*flat)


def alerts_from_events(events: DataFrame) -> DataFrame:
    """One alert per event of severity warn or above, with the event's own severity."""
    trace = F.coalesce(F.col("metadata.trace_id"), F.lit(""))
    alert = _alert(
        F.format_string("Elevated ingest severity (%s)", "event_type"),
        F.format_string("event_id=%s source_id=%s severity=%s trace=%s", "event_id", "source_id", "severity", trace),
        F.col("severity"), "ingest.severity_warn_or_above", F.col("ingested_at"),
        _ref(event_id=F.col("event_id"), source_id=F.col("source_id"), event_type=F.col("event_type")),
    )
    return events.where(F.col("severity").isin(S.SEVERITIES[1:])).select(alert.alias("a")).select("a.*")


def alerts_from_digests(digests: DataFrame, k: int | Column, at: str = "window_end") -> DataFrame:
    """Up to three alerts per digest: low freshness, low diversity, sparse selection."""
    kc = F.lit(k) if isinstance(k, int) else k
    when, n, fresh, diverse = F.col(at), F.col("selected_n"), F.col("freshness"), F.col("diversity")
    tail = F.format_string(" strategy=%d k=%d selected=%d", "strategy", kc, n)
    low_fresh = _alert(
        F.lit("Digest freshness below threshold"), F.concat(F.format_string("freshness=%.3f", fresh), tail), F.lit("warn"),
        "digest.low_freshness", when, _ref(freshness=F.format_string("%.4f", fresh), strategy=F.col("strategy")),
    )
    low_diverse = _alert(
        F.lit("Digest diversity below threshold"), F.concat(F.format_string("diversity=%.3f", diverse), tail), F.lit("info"),
        "digest.low_diversity", when, _ref(diversity=F.format_string("%.4f", diverse), strategy=F.col("strategy")),
    )
    sparse = _alert(
        F.lit("Digest selection unexpectedly sparse"),
        F.format_string("requested k=%d but only %d events matched filters/strategy", kc, n), F.lit("warn"),
        "digest.sparse_selection", when, _ref(k=kc, selected=n),
    )
    is_sparse = (kc > S.SPARSE_MIN_K) & (n > 0) & (n < F.floor(kc / S.SPARSE_DIVISOR))
    raised = F.array(
        F.when(fresh < S.LOW_FRESHNESS, low_fresh), F.when(diverse < S.LOW_DIVERSITY, low_diverse), F.when(is_sparse, sparse)
    )
    return digests.select(F.explode(F.array_compact(raised)).alias("a")).select("a.*")


def alerts_from_decisions(decisions: DataFrame, at: str = "ingested_at") -> DataFrame:
    """One alert per decision that needs operator review."""
    label = F.coalesce(blank_to_null(trimmed(F.col("response.classification"))), F.col("guardrails"))
    shown = F.when(blank_to_null(trimmed(F.col("response.classification"))).isNull(), F.col("guardrails")).otherwise(
        F.col("response.classification"))
    alert = _alert(
        F.lit("AI suggestion requires operator review"),
        F.concat(F.lit("event_id="), F.col("event_id"), F.lit(" classification="), shown,
                 F.lit(" — acknowledge via operator resolve endpoint.")),
        F.lit("warn"), "operator.review_required", F.col(at), _ref(event_id=F.col("event_id"), classification=shown),
    )
    return decisions.where(F.col("operator_review") & label.isNotNull()).select(alert.alias("a")).select("a.*")


def alerts_from_actions(actions: DataFrame, at: str = "acted_at") -> DataFrame:
    """One alert per operator action; an override is a warning."""
    alert = _alert(
        F.format_string("Operator recorded %s", "action"),
        F.concat(F.lit("operator_id="), F.col("operator_id"), F.lit(" event_id="), F.col("event_id"),
                 F.lit(" — tamper-evident audit append succeeded.")),
        F.when(F.col("action") == "override", "warn").otherwise("info"), "operator.resolution_recorded", F.col(at),
        _ref(event_id=F.col("event_id"), operator_id=F.col("operator_id"), action=F.col("action")),
    )
    return actions.select(alert.alias("a")).select("a.*")


def audit_transitions(checks: DataFrame) -> DataFrame:
    """Checks (tenant, checked_at, valid) at which a chain turned from valid to invalid.

    A chain counts as valid before its first check. Rows are one per scheduled check and tenant.
    """
    before = F.lag("valid", 1, True).over(Window.partitionBy("tenant").orderBy("checked_at"))
    return checks.withColumn("_before", before).where(~F.col("valid") & F.col("_before")).drop("_before")


def alerts_from_audit(checks: DataFrame) -> DataFrame:
    """Critical alert when a chain becomes invalid."""
    broken = audit_transitions(checks)
    error = F.col("verify_err") if "verify_err" in checks.columns else F.lit(None).cast("string")
    alert = _alert(
        F.lit("Audit chain integrity failure"), F.coalesce(blank_to_null(error), F.lit("audit chain verification failed")),
        F.lit("critical"), "platform.audit_chain_invalid", F.col("checked_at"), F.create_map(),
    )
    return broken.select(alert.alias("a")).select("a.*")


# --- Throttle --------------------------------------------------------------------


def throttle_key() -> Column:
    """The rule, plus the event when the alert names one."""
    event = F.element_at("ref", F.lit("event_id"))
    return F.when(present(event), F.concat(F.col("rule_id"), F.lit("|evt|"), event)).otherwise(F.col("rule_id"))


def _kept_path(times: np.ndarray, start: int, gap: int) -> np.ndarray:
    """Greedy walk over sorted times from index ``start``."""
    nxt = np.searchsorted(times, times + gap, side="left")
    kept = []
    i = start
    while i < len(times):
        kept.append(i)
        i = nxt[i]
    return times[np.array(kept, dtype=np.int64)]


def _by_block(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str, int, pd.DataFrame]]]:
    """(key, block, rows) of the whole blocks of rows sorted by key, block and time; a list per batch.

    The last block of a batch may go on in the next one, so it waits for that.
    """
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        keys, blocks = pdf["key"].to_numpy(), pdf["block"].to_numpy()
        edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist()]
        if len(edges) > 1:
            yield [(keys[i], blocks[i], pdf.iloc[i:j]) for i, j in zip(edges, edges[1:])]
        rest = pdf.iloc[edges[-1]:]
    if rest is not None and len(rest):
        yield [(rest["key"].iloc[0], rest["block"].iloc[0], rest)]


def _pieces(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block of sorted times does with its entry state: (last entry, last kept time) of each piece."""
    nxt = np.searchsorted(times, times + gap, side="left")
    # the last alert kept before the block is older than its first time, so its gap ends less than one gap after it
    reach = np.searchsorted(times, times[0] + gap, side="left")
    last = np.arange(min(reach + 1, len(times)))
    entries = times[last]
    while True:
        step = nxt[last]
        more = step < len(times)
        if not more.any():
            break
        last = np.where(more, step, last)
    exits = times[last]
    ends = np.append(exits[1:] != exits[:-1], True)  # entries that lead to the same exit form one piece
    return entries[ends], exits[ends]


def _block_summaries(gap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks in _by_block(batches):
            found = [(key, block, *_pieces(rows["us"].to_numpy(), gap)) for key, block, rows in blocks]
            yield pd.DataFrame(found, columns=["key", "block", "upto", "exits"])

    return summarize


def _entry_states(gap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Walk over a key's block summaries: the entry state of every block that keeps an alert."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        earliest, states = np.iinfo(np.int64).min, []
        for key, block, upto, exits in zip(pdf["key"], pdf["block"], pdf["upto"], pdf["exits"]):
            piece = np.searchsorted(upto, earliest, side="left")
            if piece < len(upto):
                states.append((key, block, earliest))
                earliest = int(exits[piece]) + gap
        return pd.DataFrame(states, columns=["key", "block", "earliest"])

    return walk


def _resolve_block(gap: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def resolve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["us"].to_numpy())
        first = int(np.searchsorted(times, rows["earliest"].iloc[0], side="left"))
        return pd.DataFrame({"key": key[0], "us": _kept_path(times, first, gap)})

    return resolve


def _throttle_few(rows: DataFrame, gap: int) -> DataFrame:
    """Fold per key over a bounded, sorted array; returns kept (key, us)."""
    times = rows.groupBy("key").agg(F.sort_array(F.collect_set("us")).alias("times"))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate(
        "times", start,
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return times.select("key", F.explode(kept).alias("us"))


def _throttle_many(rows: DataFrame, gap: int, block_rows: int) -> DataFrame:
    """Block-wise exact throttle for keys with many alerts; returns kept (key, us).

    Blocks hold ``block_rows`` different times, however dense a key is. A task takes its blocks one after the other out of
    its sorted rows, so small blocks cost no call of their own; only blocks that keep an alert are resolved.
    """
    times = rows.select("key", "us").distinct().withColumn("_cell", time_cell(F.col("us")))
    placed = positions(times, ["key"], "_cell", [F.col("us").asc()], "_at")
    cut = placed.select("key", "us", F.floor(F.col("_at") / block_rows).cast("long").alias("block"))
    by_block = cut.repartition("key", "block").sortWithinPartitions("key", "block", "us")
    summary = by_block.mapInPandas(_block_summaries(gap), "key string, block long, upto array<bigint>, exits array<bigint>")
    entry = summary.groupBy("key").applyInPandas(_entry_states(gap), "key string, block long, earliest long")
    # grouped: AQE may turn this join into a broadcast, and would then leave out a mere repartition by its keys
    return cut.join(entry, ["key", "block"]).groupBy("key", "block").applyInPandas(_resolve_block(gap), "key string, us long")


def throttle_alerts(
    alerts: DataFrame, seconds: float = S.THROTTLE_SECONDS, key: Column | None = None, few: int = 1000,
    block_rows: int = 100_000,
) -> DataFrame:
    """Alerts kept by the greedy throttle; of alerts with equal key and time the smallest id is kept.

    Alerts without a key or time are kept: nothing says that they repeat, and they suppress nothing.
    Keys with at most ``few`` alerts use the array fold, larger ones blocks of ``block_rows`` times.
    """
    gap = int(seconds * 1_000_000)
    block = max(64 * gap, 1)
    every = (
        alerts.withColumn("key", throttle_key() if key is None else key)
        .withColumn("us", micros(F.col("created_at"))).withColumn("block", F.floor(F.col("us") / block).cast("long"))
    )
    placed = F.col("key").isNotNull() & F.col("us").isNotNull()
    keyed, bare = every.where(placed), every.where(~placed)
    # totals per key from the small table of blocks, so that no join is on the key alone
    blocks = keyed.groupBy("key", "block").agg(F.count(F.lit(1)).alias("_in"))
    blocks = blocks.withColumn("_n", F.sum("_in").over(Window.partitionBy("key"))).drop("_in")
    sized = keyed.join(blocks, ["key", "block"])
    single, several = sized.where(F.col("_n") == 1), sized.where(F.col("_n") > 1)
    times = several.select("key", "us", "block", "_n")
    kept = _throttle_few(times.where(F.col("_n") <= few), gap).unionByName(
        _throttle_many(times.where(F.col("_n") > few), gap, block_rows)
    )
    first = top_n(several.join(kept, ["key", "us"], "left_semi"), ["key", "us"], [F.col("id").asc()], 1, salt_by="id")
    return single.unionByName(first.select(single.columns)).select(*alerts.columns).unionByName(bare.select(*alerts.columns))


def alerts_newest_first(alerts: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest alerts."""
    return alerts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def severity_at_least(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(severity_rank(F.col("severity")) >= S.SEVERITIES.index(severity))
