"""Digest selection: k events per group, balancing recency and source coverage.

All strategies share one shape. Some events are *seeds* (chosen source-latest events); the digest is
the first k rows by (seed first, newest first, event_id). Input must hold one row per event_id
(see ``reports.dedup_events``).

How a large group is handled: the newest event per source and the newest k events are cut per map
task before their shuffles; ranks among the source-latest rows come from ``rank_band``, which only
ranks rows of the few time cells that touch the wanted band. The last window sees at most 2k rows
per group.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import content_fingerprint, micros, severity_rank
from auditweave.functions.ranking import (
    GROUP, expand_group, hash_cell, rank_band, time_cell, top_n, with_group,
)

LATEST, LATEST_PER_SOURCE, HYBRID, MIN_DIVERSITY, MIN_DIVERSITY_RANDOM, PREFERRED = range(1, 7)

Limit = int | Column


def newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("event_id").asc()]


def _cap(k: Limit, k_max: int | None) -> int:
    if isinstance(k, int):
        return k
    if k_max is None:
        raise ValueError("k_max is required when k is a column")
    return k_max


def _as_col(k: Limit) -> Column:
    return F.lit(k) if isinstance(k, int) else k


def _top(df: DataFrame, keys: Sequence[str], k: Limit, k_max: int | None) -> DataFrame:
    if isinstance(k, int):
        return top_n(df, keys, newest_first(), k)
    return top_n(df, keys, newest_first(), _cap(k, k_max), rank="_r").where(F.col("_r") <= k).drop("_r")


# --- Suppression --------------------------------------------------------------


def mark_shown(events: DataFrame, shown: DataFrame | None) -> DataFrame:
    """Flag events whose id is in ``shown`` (duplicates in ``shown`` are harmless)."""
    if shown is None:
        return events.withColumn("is_shown", F.lit(False))
    ids = shown.select(F.col("event_id")).distinct().withColumn("_hit", F.lit(True))
    return events.join(ids, "event_id", "left").withColumn("is_shown", F.col("_hit").isNotNull()).drop("_hit")


def suppress(events: DataFrame, shown: DataFrame) -> DataFrame:
    """Drop events that were already shown."""
    return events.join(shown.select("event_id"), "event_id", "left_anti")


def recently_shown(shown: DataFrame, as_of: Column, seconds: int = 60, max_ids: int | None = None) -> DataFrame:
    """Ids shown in the last ``seconds``; with ``max_ids`` only so many, the most recently shown."""
    last = shown.groupBy("event_id").agg(F.max("shown_at").alias("shown_at"))
    in_window = last.where(
        (micros(F.col("shown_at")) > micros(as_of) - seconds * 1_000_000) & (F.col("shown_at") <= as_of)
    )
    return in_window if max_ids is None else in_window.orderBy(F.col("shown_at").desc(), F.col("event_id")).limit(max_ids)


# --- Source-latest rows ---------------------------------------------------------


def _latest_per_source(events: DataFrame) -> DataFrame:
    return top_n(events, [GROUP, "source_id"], newest_first(), 1)


def latest_per_source(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest event of every source in every group (smallest event_id on equal timestamps)."""
    return _latest_per_source(with_group(events, by)).drop(GROUP)


def source_rank_band(events: DataFrame, by: Sequence[str], skip: Column, take: Column, cell_micros: int) -> DataFrame:
    """Source-latest rows at positions skip+1..skip+take of their group, oldest first."""
    latest = _latest_per_source(with_group(events, by)).withColumn("_cell", time_cell(micros(F.col("timestamp")), cell_micros))
    order = [F.col("timestamp").asc(), F.col("event_id").desc()]
    return rank_band(latest, [GROUP], "_cell", order, skip, take).drop(GROUP, "_cell")


def sources_to_drop(diversity: float | Column) -> Column:
    """How many source-latest rows a diversity percentage gives up, in double arithmetic truncated to int."""
    d = diversity if isinstance(diversity, Column) else F.lit(float(diversity))
    share = F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(100.0), d)) / F.lit(100.0)
    return (F.col("_n").cast("double") * share).cast("int")


# --- Kernel --------------------------------------------------------------------


def _fill(events: DataFrame, seeds: DataFrame, k: Limit, k_max: int | None) -> DataFrame:
    """Seeds plus the newest other events, k per group.

    The newest k events are enough to fill from: if s of them are seeds, k - s others remain.
    """
    pool = _top(events, [GROUP], k, k_max).withColumn("_seed", F.lit(0))
    both = seeds.withColumn("_seed", F.lit(1)).unionByName(pool)
    twin = Window.partitionBy(GROUP).orderBy(*newest_first(), F.col("_seed").desc())
    pick = Window.partitionBy(GROUP).orderBy(F.col("_seed").desc(), *newest_first())
    return (
        both.withColumn("_above", F.lag("event_id").over(twin))
        .where(F.col("_above").isNull() | (F.col("_above") != F.col("event_id")))
        .withColumn("_rn", F.row_number().over(pick))
        .where(F.col("_rn") <= _as_col(k))
        .drop("_above", "_rn", "_seed")
    )


def _diversity_seeds(
    events: DataFrame, k: Limit, diversity: float | Column, random_seed: int | None, cell_micros: int
) -> DataFrame:
    latest = _latest_per_source(events)
    if random_seed is None:
        cell = time_cell(micros(F.col("timestamp")), cell_micros)
        order = [F.col("timestamp").asc(), F.col("event_id").desc()]
        latest = latest.withColumn("_cell", cell)
    else:
        shuffled = F.sha2(F.concat_ws("~", F.lit(str(random_seed)), F.col("source_id")), 256)
        latest = latest.withColumn("_h", shuffled).withColumn("_cell", hash_cell(F.col("_h")))
        order = [F.col("_h")]
    return rank_band(latest, [GROUP], "_cell", order, sources_to_drop(diversity), _as_col(k)).drop("_cell", "_h")


def _select_latest(events, k, k_max=None, **_):
    return _top(events, [GROUP], k, k_max)


def _select_latest_per_source(events, k, k_max=None, **_):
    return _top(_latest_per_source(events), [GROUP], k, k_max)


def _select_hybrid(events, k, k_max=None, **_):
    return _fill(events, _top(_latest_per_source(events), [GROUP], k, k_max), k, k_max)


def _select_min_diversity(events, k, k_max=None, diversity=S.DEFAULT_DIVERSITY, cell_micros=1_000_000, **_):
    return _fill(events, _diversity_seeds(events, k, diversity, None, cell_micros), k, k_max)


def _select_min_diversity_random(
    events, k, k_max=None, diversity=S.DEFAULT_DIVERSITY, random_seed=0, cell_micros=1_000_000, **_
):
    return _fill(events, _diversity_seeds(events, k, diversity, random_seed, cell_micros), k, k_max)


def _select_preferred(
    events, k, k_max=None, diversity=S.DEFAULT_DIVERSITY, preferred=(), cell_micros=1_000_000, **_
):
    base = _select_min_diversity(events, k, k_max, diversity, cell_micros)
    if isinstance(preferred, Column):
        is_pref = F.coalesce(F.array_contains(preferred, F.col("source_id")), F.lit(False))
    elif preferred:
        is_pref = F.col("source_id").isin(list(preferred))
    else:
        return base
    candidate = top_n(events.where(is_pref), [GROUP], newest_first(), 1).withColumn("_cand", F.lit(1))
    both = base.withColumn("_cand", F.lit(0)).unionByName(candidate)
    group = Window.partitionBy(GROUP)
    own = F.col("_cand") == 0
    oldest = Window.partitionBy(GROUP, "_cand").orderBy(F.col("timestamp").asc(), F.col("event_id").desc())
    return (
        both.withColumn("_covered", F.max(F.when(own & is_pref, 1).otherwise(0)).over(group))
        .withColumn("_offered", F.max("_cand").over(group))
        .withColumn("_size", F.sum(F.when(own, 1).otherwise(0)).over(group))
        .withColumn("_age_rank", F.row_number().over(oldest))
        .where(
            F.when(own, (F.col("_covered") == 1) | (F.col("_offered") == 0) | (F.col("_age_rank") > 1))
            .otherwise((F.col("_covered") == 0) & (F.col("_size") > 0))
        )
        .drop("_cand", "_covered", "_offered", "_size", "_age_rank")
    )


# Name or number -> function(events with a group column, k, k_max, **options) -> selected rows.
STRATEGIES: dict[int | str, Callable[..., DataFrame]] = {
    LATEST: _select_latest,
    LATEST_PER_SOURCE: _select_latest_per_source,
    HYBRID: _select_hybrid,
    MIN_DIVERSITY: _select_min_diversity,
    MIN_DIVERSITY_RANDOM: _select_min_diversity_random,
    PREFERRED: _select_preferred,
}


def register_strategy(name: int | str, fn: Callable[..., DataFrame]) -> None:
    """Add a selection strategy: ``fn(events, k=…, k_max=…, **options)``, grouped by the column ``_g``."""
    STRATEGIES[name] = fn


# --- Public selection -------------------------------------------------------------


def select_events(
    events: DataFrame, strategy: int | str, k: Limit, by: Sequence[str] = (), shown: DataFrame | None = None,
    k_max: int | None = None, late: bool = False, **options,
) -> DataFrame:
    """Selected events per group; columns of ``events`` unchanged.

    With ``late`` the selection runs on ids, sources and times only and the chosen rows are fetched
    afterwards: the right choice for a wide stored table, whose payloads are then never shuffled.
    """
    if late:
        narrow = events.select(*dict.fromkeys(["event_id", "source_id", "timestamp", *by]))
        return fetch_events(events, select_events(narrow, strategy, k, by, shown, k_max, **options))
    if isinstance(k, int) and k < 0:
        raise ValueError("k must be non-negative")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if isinstance(k, int) and k == 0:
        return events.limit(0)
    kept = events if shown is None else suppress(events, shown)
    # by-columns travel inside the group column only, so that branches shuffle the same columns
    kernel = {"event_id", "source_id", "timestamp"}
    inner = with_group(kept, by).drop(*[c for c in by if c not in kernel])
    picked = STRATEGIES[strategy](inner, k, k_max=k_max, **options)
    return picked.select(*[F.col(f"{GROUP}.{c}").alias(c) if c in by else F.col(c) for c in kept.columns])


def fetch_events(events: DataFrame, picked: DataFrame) -> DataFrame:
    """Full rows of selected ids."""
    return events.join(picked.select("event_id").distinct(), "event_id", "left_semi").select(*events.columns)


def select_latest(events, k, by=(), **kw):
    return select_events(events, LATEST, k, by, **kw)


def select_latest_per_source(events, k, by=(), **kw):
    return select_events(events, LATEST_PER_SOURCE, k, by, **kw)


def select_hybrid(events, k, by=(), **kw):
    return select_events(events, HYBRID, k, by, **kw)


def select_min_diversity(events, k, diversity=S.DEFAULT_DIVERSITY, by=(), **kw):
    return select_events(events, MIN_DIVERSITY, k, by, diversity=diversity, **kw)


def select_min_diversity_random(events, k, diversity=S.DEFAULT_DIVERSITY, random_seed=0, by=(), **kw):
    return select_events(events, MIN_DIVERSITY_RANDOM, k, by, diversity=diversity, random_seed=random_seed, **kw)


def select_preferred(events, k, diversity=S.DEFAULT_DIVERSITY, preferred=(), by=(), **kw):
    return select_events(events, PREFERRED, k, by, diversity=diversity, preferred=preferred, **kw)


# --- Scores and digests -------------------------------------------------------------


def group_stats(events: DataFrame, by: Sequence[str], shown: DataFrame | None, as_of: Column | None) -> DataFrame:
    """Per group over the unsuppressed input: rows, removed rows, sources, reference time, greatest age."""
    marked = with_group(mark_shown(events, shown), by)
    us = micros(F.col("timestamp"))
    ref = F.max(us) if as_of is None else F.max(micros(as_of))
    stats = marked.groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("input_n"),
        F.sum(F.col("is_shown").cast("long")).alias("removed_n"),
        F.count_distinct("source_id").alias("input_sources"),
        ref.alias("ref_us"),
        F.min(us).alias("_min_us"),
    )
    oldest = F.greatest(F.col("ref_us") - F.col("_min_us"), F.lit(0).cast("long"))
    return stats.withColumn("max_age_us", oldest).drop("_min_us")


def digest_scores(
    selected: DataFrame, events: DataFrame, by: Sequence[str] = (), shown: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """One row per input group: selected_n, freshness, diversity, redundancy.

    Ages run to ``as_of`` (constant within a group), by default to the group's newest event.
    """
    stats = group_stats(events, by, shown, as_of)
    chosen = with_group(selected, by).select(GROUP, "source_id", micros(F.col("timestamp")).alias("_us"))
    return expand_group(_scored(stats, chosen, [GROUP]), by)


def _scored(stats: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of the chosen rows (at most k per key) against their group's statistics, which are read once."""
    known = ["input_n", "removed_n", "input_sources", "ref_us", "max_age_us"]
    per = stats.join(chosen, list(keys), "left").groupBy(*keys, *known).agg(
        F.count("_us").alias("selected_n"),
        F.sum(F.greatest(F.col("ref_us") - F.col("_us"), F.lit(0).cast("long"))).alias("_age_us"),
        F.size(F.collect_set("source_id")).alias("_sources"),
    )
    n, max_age = F.col("selected_n"), F.col("max_age_us")
    fresh = F.when(n == 0, 0.0).when(max_age == 0, 1.0).otherwise(1.0 - F.col("_age_us") / (n * max_age))
    return per.select(
        *keys, n, fresh.alias("freshness"), (F.col("_sources") / F.col("input_sources")).alias("diversity"),
        (F.col("removed_n") / F.col("input_n")).alias("redundancy"), "input_n",
    )


def digest_records(
    selected: DataFrame, scores: DataFrame, strategy: int, by: Sequence[str] = (), window_end: Column | None = None
) -> DataFrame:
    """Digest rows: scores plus the selected events as an array, newest first (at most k per group)."""
    event = F.struct(*[F.col(f.name) for f in S.EVENT if f.name in selected.columns])
    sort_key = F.struct((-micros(F.col("timestamp"))).alias("o"), F.col("event_id").alias("i"), event.alias("e"))
    arrays = (
        with_group(selected, by).groupBy(GROUP)
        .agg(F.transform(F.sort_array(F.collect_list(sort_key)), lambda x: x["e"]).alias("selected_events"))
    )
    end = window_end if window_end is not None else F.current_timestamp()
    return (
        with_group(scores, by).join(arrays, GROUP, "left").drop(GROUP)
        .withColumn("strategy", F.lit(strategy))
        .withColumn("selected_events", F.coalesce("selected_events", F.array().cast(arrays.schema["selected_events"].dataType)))
        .withColumn("window_end", end)
    )


def curate(
    events: DataFrame, strategy: int = S.DEFAULT_STRATEGY, k: int = S.BATCH_K, by: Sequence[str] = (),
    shown: DataFrame | None = None, as_of: Column | None = None, window_end: Column | None = None, **options,
) -> DataFrame:
    """Suppress, select and score in one plan; one digest row per group of the input."""
    selected = select_events(events, strategy, k, by, shown, **options)
    scores = digest_scores(selected, events, by, shown, as_of)
    return digest_records(selected, scores, strategy, by, window_end)


def compare_strategies(
    events: DataFrame, k: int, by: Sequence[str] = (), shown: DataFrame | None = None,
    as_of: Column | None = None, strategies: Sequence[int] = (1, 2, 3, 4, 5, 6), **options,
) -> DataFrame:
    """Scores of several strategies over the same groups, one row per (group, strategy).

    The group key is extended by the strategy number, so the input statistics are computed once and
    the per-strategy plans share the source-latest and newest-k exchanges.
    """
    picked = None
    for s in strategies:
        one = select_events(events, s, k, by, shown, **options).withColumn("strategy", F.lit(s))
        picked = one if picked is None else picked.unionByName(one)
    chosen = with_group(picked, by).select(GROUP, "strategy", "source_id", micros(F.col("timestamp")).alias("_us"))
    grid = group_stats(events, by, shown, as_of).withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    return expand_group(_scored(grid, chosen, [GROUP, "strategy"]), by)


def digest_objective(scores: DataFrame, fresh: float = 1.0, diverse: float = 1.0, redundant: float = 1.0) -> DataFrame:
    """Weighted quality of a digest: reward freshness and diversity, charge redundancy."""
    value = fresh * F.col("freshness") + diverse * F.col("diversity") - redundant * F.col("redundancy")
    return scores.withColumn("objective", value)


def select_by_objective(
    events: DataFrame, k: int, by: Sequence[str] = (), fresh: float = 1.0, diverse: float = 1.0, redundant: float = 1.0,
    shown: DataFrame | None = None, as_of: Column | None = None,
) -> DataFrame:
    """The k events of each group with the greatest fresh * freshness + diverse * diversity - redundant * redundancy.

    Freshness is the mean of 1 - age / greatest age, diversity the share of the group's sources that are present, and
    redundancy the share of chosen events that were ``shown`` before (they may be chosen, at that price). ``gain`` is an
    event's part of the objective, so a digest's gains add up to its value.

    The maximum is exact: all but diversity is a sum over events, and diversity pays once for each source, which its best
    event may as well collect; so the k greatest gains win. ``diverse`` must not be negative. Among events that are all
    shown, or all not shown, gains fall with age, so the k newest of each and the newest of each source are candidates
    enough: they are cut per map task before the shuffle. Events without a time count as the oldest, without a source they
    add no source. Ties go to the newest event, then to the smallest event_id.
    """
    if diverse < 0:
        raise ValueError("diverse must not be negative")
    marked = with_group(mark_shown(events, shown), by).withColumn("_us", micros(F.col("timestamp")))
    stats = group_stats(events, by, shown, as_of).select(GROUP, "input_n", "input_sources", "ref_us", "max_age_us")
    by_age = [F.col("_us").desc_nulls_last() if fresh >= 0 else F.col("_us").asc_nulls_first(), F.col("event_id").asc()]
    best_first = lambda c: [F.col(c).desc(), F.col("_us").desc_nulls_last(), F.col("event_id").asc()]
    age = F.greatest(F.col("ref_us") - F.col("_us"), F.lit(0).cast("long"))
    freshness = F.when(F.col("_us").isNull(), 0.0).when(F.col("max_age_us") == 0, 1.0).otherwise(1.0 - age / F.col("max_age_us"))
    value = (fresh * freshness - redundant * F.col("is_shown").cast("int")) / F.least(F.col("input_n"), F.lit(k))
    valued = lambda rows: rows.join(stats, GROUP).withColumn("gain", value)
    newest = valued(top_n(marked, [GROUP, "is_shown"], by_age, k))
    leads = valued(top_n(marked.where(F.col("source_id").isNotNull()), [GROUP, "source_id", "is_shown"], by_age, 1))
    leads = top_n(leads, [GROUP, "source_id"], best_first("gain"), 1)
    leads = top_n(leads.withColumn("gain", F.col("gain") + diverse / F.col("input_sources")), [GROUP], best_first("gain"), k)
    rest = newest.join(leads.select(GROUP, "event_id"), [GROUP, "event_id"], "left_anti")
    return top_n(leads.unionByName(rest), [GROUP], best_first("gain"), k).select(*events.columns, "gain")


# --- Demotion, weights, roles ---------------------------------------------------------


def fingerprinted(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", content_fingerprint(F.col("source_id"), F.col("event_type"), F.col("payload")))


def mark_repeats(events: DataFrame, curated: DataFrame, last_n: int) -> DataFrame:
    """Flag events whose content equals one of the last ``last_n`` curated events."""
    recent = fingerprinted(curated).orderBy(*newest_first()).limit(last_n).select("fingerprint").distinct()
    recent = recent.withColumn("_hit", F.lit(1))
    return (
        fingerprinted(events).join(recent, "fingerprint", "left")
        .withColumn("is_repeat", F.coalesce("_hit", F.lit(0))).drop("_hit")
    )


def demote_repeats(events: DataFrame, curated: DataFrame, last_n: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Newest k per group with repeats of curated content sorted last instead of dropped."""
    marked = with_group(mark_repeats(events, curated, last_n), by)
    return top_n(marked, [GROUP], [F.col("is_repeat").asc(), *newest_first()], k, rank="position").drop(GROUP)


def weighted_digest(events: DataFrame, weights: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Top k by operator weight, then recency.

    ``weights`` rows are (dimension, value, weight) with dimension event_type, source_id or severity;
    an event's weight is the sum of its matches, 0 if none.
    """
    weighted = events
    total = F.lit(0.0)
    for dim in ("event_type", "source_id", "severity"):
        w = (
            weights.where(F.col("dimension") == dim).groupBy(F.col("value").alias(dim))
            .agg(F.sum("weight").alias(f"_w_{dim}"))
        )
        weighted = weighted.join(w, dim, "left")
        total = total + F.coalesce(F.col(f"_w_{dim}"), F.lit(0.0))
    weighted = with_group(weighted.withColumn("weight", total), by)
    weighted = weighted.drop("_w_event_type", "_w_source_id", "_w_severity")
    return top_n(weighted, [GROUP], [F.col("weight").desc(), *newest_first()], k, rank="position").drop(GROUP)


def role_events(events: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per (role, event the role may see): as many rows as that are.

    Roles are expanded to one row per severity they accept, so the match is an equi-join on severity
    with the remaining conditions on top, not a cross join.
    """
    accepted = F.filter(
        F.array(*[F.lit(s) for s in S.SEVERITIES]),
        lambda s: severity_rank(s) >= F.coalesce(severity_rank(F.col("min_severity")), F.lit(-1)),
    )
    r = roles.select(
        F.col("name").alias("role"), F.col("digest_size").alias("k"), F.col("curation_strategy").alias("strategy"),
        F.col("diversity_percent").alias("diversity"), "event_types", "event_type_prefix", "sources",
        "preferred_sources", F.explode(accepted).alias("severity"),
    )
    def anywhere(lst, value):
        return F.col(lst).isNull() | (F.size(lst) == 0) | F.array_contains(F.col(lst), F.col(value))

    return (
        events.join(r, "severity")
        .where(anywhere("event_types", "event_type") & anywhere("sources", "source_id"))
        .where(F.col("event_type_prefix").isNull() | F.startswith(F.col("event_type"), F.col("event_type_prefix")))
        .drop("event_types", "event_type_prefix", "sources")
    )


def curate_roles(events: DataFrame, roles: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """One digest per role (and group), each with the role's own strategy, size and diversity.

    A role looks at type, severity and source only, and no digest needs more than its k newest events of each: events
    are reduced to these before they meet the roles. At most one pass per strategy in use, whatever the number of roles.
    """
    use = roles.agg(F.max("digest_size").alias("k"), F.collect_set("curation_strategy").alias("strategies")).first()
    if use["k"] is None:
        return role_events(events, roles).limit(0)
    seen = with_group(events, [*by, "event_type", "severity", "source_id"])
    needed = top_n(seen, [GROUP], newest_first(), use["k"]).drop(GROUP)
    out = None
    for s in sorted(use["strategies"]):
        mine = role_events(needed, roles.where(F.col("curation_strategy") == s))
        one = _select_for_roles(mine, s, by, use["k"], options)
        out = one if out is None else out.unionByName(one)
    return out


def _select_for_roles(mine: DataFrame, strategy: int, by: Sequence[str], k_max: int, options: dict) -> DataFrame:
    """Role-specific k and diversity travel in the group key, where the rank band can read them."""
    keys = ["role", *by, "k", "diversity"]
    return select_events(
        mine, strategy, F.col(f"{GROUP}.k"), keys, k_max=k_max, diversity=F.col(f"{GROUP}.diversity"),
        preferred=F.col("preferred_sources"), **options,
    )


def digest_params(requests: DataFrame) -> DataFrame:
    """Clean request parameters given as text: strategy outside 1..6 -> 4, diversity -> 80, k <= 0 -> 20."""
    strategy = F.expr("try_cast(trim(strategy) AS INT)")
    k = F.expr("try_cast(trim(k) AS INT)")
    diversity = F.expr("try_cast(trim(diversity) AS DOUBLE)")
    return (
        requests.withColumn("strategy", F.when(strategy.between(1, 6), strategy).otherwise(S.DEFAULT_STRATEGY))
        .withColumn("diversity", F.coalesce(diversity, F.lit(S.DEFAULT_DIVERSITY)))
        .withColumn("k", F.when(k > 0, k).otherwise(S.DEFAULT_K))
    )


def digest_selection_payload(digests: DataFrame, k: int, diversity: float) -> DataFrame:
    """Audit payload recorded for every digest."""
    body = F.to_json(F.struct(
        F.lit(float(diversity)).alias("diversity"), F.lit(k).alias("k"), F.col("selected_n"), F.col("strategy"),
    ))
    return digests.withColumn("kind", F.lit("digest_selection")).withColumn("payload", body)
