"""Selection, digest and score queries."""

from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.ranking import GROUP, top_n
from auditweave.operators import curate as C
from auditweave.operators import reports as R
from auditweave.plans.base import events, query, r9, rank_sql, table, us, with_ev
from auditweave.sources.packs import check_packs, pack_roles

BY = ["day"]
OUT = ["day", "event_id", "source_id"]
PREFERRED = ["user-3", "user-7"]


def rows(df):
    return df.select(*OUT, us("timestamp"))


# --- SQL building blocks ------------------------------------------------------


def latest_sql(src: str = "ev") -> str:
    """Newest row per (day, source)."""
    return (f"latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, source_id ORDER BY us DESC, event_id) AS lr "
            f"FROM {src}) WHERE lr = 1)")


def seeds_sql(k: int, d: float, order: str = "us ASC, event_id DESC") -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY {order}) AS ra, count(*) OVER (PARTITION BY day) AS ns FROM latest),
seeds AS (SELECT day, event_id FROM ranked
  WHERE ra > trunc(ns::DOUBLE * (1 - {d}::DOUBLE / 100)) AND ra <= trunc(ns::DOUBLE * (1 - {d}::DOUBLE / 100)) + {k})"""


def fill_sql(k: int, src: str = "ev") -> str:
    return f"""picked AS (
  SELECT * FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.day ORDER BY (s.event_id IS NOT NULL) DESC, e.us DESC, e.event_id) AS rn
    FROM {src} e LEFT JOIN seeds s ON e.day = s.day AND e.event_id = s.event_id) WHERE rn <= {k})"""


def top_sql(k: int, src: str = "ev", name: str = "picked") -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us DESC, event_id) AS rn "
            f"FROM {src}) WHERE rn <= {k})")


HYBRID_SEEDS = lambda k: (
    f"seeds AS (SELECT day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us DESC, event_id) AS r "
    f"FROM latest) WHERE r <= {k})")


def preferred_sql(names: list[str], src: str = "ev", base: str = "picked") -> str:
    lst = ", ".join(f"'{n}'" for n in names)
    return f"""cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us DESC, event_id) AS cr
    FROM {src} WHERE source_id IN ({lst})) WHERE cr = 1),
oldest AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us ASC, event_id DESC) AS age_rank,
    max(CASE WHEN source_id IN ({lst}) THEN 1 ELSE 0 END) OVER (PARTITION BY day) AS covered FROM {base}),
swapped AS (
  SELECT CASE WHEN swap THEN c.event_id ELSE o.event_id END AS event_id, o.day,
         CASE WHEN swap THEN c.source_id ELSE o.source_id END AS source_id,
         CASE WHEN swap THEN c.us ELSE o.us END AS us
  FROM (SELECT *, covered = 0 AND age_rank = 1 AND EXISTS (SELECT 1 FROM cand c WHERE c.day = oldest.day) AS swap FROM oldest) o
  LEFT JOIN cand c ON o.day = c.day)"""


ROWS = "SELECT day, event_id, source_id, us FROM "

SCORES = """stats AS (SELECT day, count(*) AS input_n, sum(CASE WHEN {shown} THEN 1 ELSE 0 END) AS removed_n,
    count(DISTINCT source_id) AS input_sources, max(us) AS ref, max(us) - min(us) AS max_age FROM ev GROUP BY day),
per AS (SELECT p.day, count(*) AS selected_n, sum(s.ref - p.us) AS age, count(DISTINCT p.source_id) AS srcs
    FROM {picked} p JOIN stats s ON p.day = s.day GROUP BY p.day),
scores AS (SELECT s.day, coalesce(selected_n, 0) AS selected_n,
    round(CASE WHEN selected_n IS NULL THEN 0.0 WHEN max_age = 0 THEN 1.0
          ELSE 1.0 - age::DOUBLE / (selected_n * max_age)::DOUBLE END, 9) AS freshness,
    round(coalesce(srcs::DOUBLE / input_sources, 0.0), 9) AS diversity,
    round(removed_n::DOUBLE / input_n, 9) AS redundancy
  FROM stats s LEFT JOIN per ON s.day = per.day)"""


def scores_sql(picked: str = "picked", shown: str = "FALSE") -> str:
    return SCORES.format(picked=picked, shown=shown)


def score_cols():
    return ["day", "selected_n", r9("freshness"), r9("diversity"), r9("redundancy")]


# --- Strategies ------------------------------------------------------------------


@query("select_latest", with_ev(top_sql(20), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_latest(events(spark, sf), 20, BY))


@query("select_latest_whole_table", with_ev("SELECT event_id, source_id, us FROM ev ORDER BY us DESC, event_id LIMIT 40"))
def _(spark, sf):
    return C.select_latest(events(spark, sf), 40).select("event_id", "source_id", us("timestamp"))


@query("select_latest_per_source", with_ev(latest_sql(), top_sql(20, "latest"), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_latest_per_source(events(spark, sf), 20, BY))


@query("select_hybrid", with_ev(latest_sql(), HYBRID_SEEDS(200), fill_sql(200), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_hybrid(events(spark, sf), 200, BY))


@query("select_hybrid_few", with_ev(latest_sql(), HYBRID_SEEDS(20), fill_sql(20), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_hybrid(events(spark, sf), 20, BY))


@query("select_min_diversity", with_ev(latest_sql(), seeds_sql(20, 80), fill_sql(20), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_min_diversity(events(spark, sf), 20, 80, by=BY))


@query("select_min_diversity_large", with_ev(latest_sql(), seeds_sql(200, 35.5), fill_sql(200), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_min_diversity(events(spark, sf), 200, 35.5, by=BY))


@query("select_min_diversity_per_tenant", with_ev(
    latest_sql("(SELECT *, tenant || '/' || day AS g FROM ev)").replace("PARTITION BY day, source_id", "PARTITION BY g, source_id"),
    seeds_sql(15, 60).replace("day", "g"), fill_sql(15, "(SELECT *, tenant || '/' || day AS g FROM ev)").replace("e.day", "e.g").replace("s.day", "s.g"),
    "SELECT tenant, day, event_id, source_id, us FROM picked"))
def _(spark, sf):
    picked = C.select_min_diversity(events(spark, sf), 15, 60, by=["tenant", "day"])
    return picked.select("tenant", *OUT, us("timestamp"))


@query("select_min_diversity_random", with_ev(
    latest_sql(), seeds_sql(20, 60, "sha256('42~' || source_id)"), fill_sql(20), ROWS + "picked"))
def _(spark, sf):
    return rows(C.select_min_diversity_random(events(spark, sf), 20, 60, 42, by=BY))


@query("select_preferred", with_ev(latest_sql(), seeds_sql(20, 80), fill_sql(20), preferred_sql(PREFERRED), ROWS + "swapped"))
def _(spark, sf):
    return rows(C.select_preferred(events(spark, sf), 20, 80, PREFERRED, by=BY))


@query("latest_per_source", with_ev(latest_sql(), ROWS + "latest"))
def _(spark, sf):
    return rows(C.latest_per_source(events(spark, sf), BY))


@query("source_rank_asc", with_ev(
    latest_sql(), "ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, event_id DESC) AS ra, "
    "count(*) OVER (PARTITION BY day) AS ns FROM latest)",
    "SELECT day, event_id, source_id, us FROM ranked WHERE ra > trunc(ns::DOUBLE * 0.5) AND ra <= trunc(ns::DOUBLE * 0.5) + 10"))
def _(spark, sf):
    skip = (F.col("_n").cast("double") * F.lit(0.5)).cast("int")
    return rows(C.source_rank_band(events(spark, sf), BY, skip, F.lit(10), 1_000_000))


@query("fill_rank", with_ev(
    latest_sql(), HYBRID_SEEDS(40), fill_sql(40),
    "SELECT day, event_id, (SELECT count(*) FROM seeds s WHERE s.day = p.day AND s.event_id = p.event_id) AS seed, us FROM picked p"))
def _(spark, sf):
    ev = events(spark, sf)
    picked = C.select_hybrid(ev, 40, BY)
    seeds = C.select_latest_per_source(ev, 40, BY).select("day", "event_id", F.lit(1).cast("long").alias("seed"))
    return picked.join(seeds, ["day", "event_id"], "left").select(
        "day", "event_id", F.coalesce("seed", F.lit(0).cast("long")).alias("seed"), us("timestamp"))


# --- Suppression, scores, digests ---------------------------------------------------

SHOWN = top_sql(20, name="shown")
KEPT = "kept AS (SELECT * FROM ev WHERE event_id NOT IN (SELECT event_id FROM shown))"


def shown_ids(ev):
    """What a newest-20 digest per day has already shown."""
    return C.select_latest(ev, 20, BY).select("event_id")


@query("suppress", with_ev(SHOWN, KEPT, ROWS + "kept"))
def _(spark, sf):
    ev = events(spark, sf)
    return rows(C.suppress(ev, shown_ids(ev)))


@query("curate", with_ev(
    SHOWN, KEPT, latest_sql("kept"), seeds_sql(40, 80), fill_sql(40, "kept"),
    scores_sql(shown="event_id IN (SELECT event_id FROM shown)"),
    "SELECT p.day, p.event_id, p.us, s.selected_n, s.freshness, s.diversity, s.redundancy FROM picked p JOIN scores s ON p.day = s.day"))
def _(spark, sf):
    ev = events(spark, sf)
    digests = C.curate(ev, C.MIN_DIVERSITY, 40, BY, shown_ids(ev), diversity=80, window_end=F.lit(None).cast("timestamp"))
    flat = digests.select(*score_cols(), F.explode("selected_events").alias("e"))
    return flat.select("day", "e.event_id", F.unix_micros("e.timestamp").alias("us"), "selected_n", "freshness", "diversity", "redundancy")


@query("digest_scores", with_ev(
    SHOWN, KEPT, latest_sql("kept"), seeds_sql(20, 80), fill_sql(20, "kept"),
    scores_sql(shown="event_id IN (SELECT event_id FROM shown)"), "SELECT * FROM scores"))
def _(spark, sf):
    ev = events(spark, sf)
    shown = shown_ids(ev)
    picked = C.select_min_diversity(ev, 20, 80, by=BY, shown=shown)
    return C.digest_scores(picked, ev, BY, shown).select(*score_cols())


@query("freshness_score", with_ev(top_sql(20), scores_sql(), "SELECT day, freshness FROM scores"))
def _(spark, sf):
    ev = events(spark, sf)
    return C.digest_scores(C.select_latest(ev, 20, BY), ev, BY).select("day", r9("freshness"))


@query("diversity_score", with_ev(latest_sql(), top_sql(60, "latest"), scores_sql(), "SELECT day, diversity FROM scores"))
def _(spark, sf):
    ev = events(spark, sf)
    return C.digest_scores(C.select_latest_per_source(ev, 60, BY), ev, BY).select("day", r9("diversity"))


@query("redundancy_score", with_ev(SHOWN, """counts AS (SELECT day, count(*) AS n,
    sum(CASE WHEN event_id IN (SELECT event_id FROM shown) THEN 1 ELSE 0 END) AS removed FROM ev GROUP BY day)""",
    "SELECT day, round(removed::DOUBLE / n, 9) AS redundancy FROM counts"))
def _(spark, sf):
    ev = events(spark, sf)
    stats = C.expand_group(C.group_stats(ev, BY, shown_ids(ev), None), BY)
    return stats.select("day", F.round(F.col("removed_n") / F.col("input_n"), 9).alias("redundancy"))


@query("digest_records", with_ev(
    top_sql(20), scores_sql(),
    "arrays AS (SELECT day, string_agg(event_id, ',' ORDER BY us DESC, event_id) AS ids FROM picked GROUP BY day)",
    "SELECT s.day, 1 AS strategy, s.selected_n, s.freshness, s.diversity, s.redundancy, a.ids FROM scores s JOIN arrays a ON s.day = a.day"))
def _(spark, sf):
    d = C.curate(events(spark, sf), C.LATEST, 20, BY, window_end=F.lit(None).cast("timestamp"))
    ids = F.array_join(F.transform("selected_events", lambda e: e["event_id"]), ",").alias("ids")
    return d.select("day", "strategy", "selected_n", r9("freshness"), r9("diversity"), r9("redundancy"), ids)


@query("digest_selection_summary", with_ev(
    top_sql(20), "SELECT day, 'digest_selection' AS kind, '{\"diversity\":80.0,\"k\":20,\"selected_n\":' || count(*) || ',\"strategy\":1}' AS payload FROM picked GROUP BY day"))
def _(spark, sf):
    ev = events(spark, sf)
    scores = C.digest_scores(C.select_latest(ev, 20, BY), ev, BY).withColumn("strategy", F.lit(1))
    return C.digest_selection_payload(scores, 20, 80.0).select("day", "kind", "payload")


def _tagged(strategy: int, name: str) -> str:
    return f"SELECT {strategy} AS strategy, day, event_id, source_id, us FROM {name}"


def compare_sql(k: int, d: float) -> list[str]:
    """Rows of all six strategies, every step under its own name."""
    named = lambda text, a, b: text.replace(a, b)
    rnd = "sha256('7~' || source_id)"
    return [
        latest_sql(),
        top_sql(k, name="p1"), top_sql(k, "latest", "p2"),
        named(HYBRID_SEEDS(k), "seeds AS", "seeds3 AS"),
        named(named(fill_sql(k), "picked AS", "p3 AS"), "seeds s", "seeds3 s"),
        named(named(seeds_sql(k, d), "ranked", "ranked4"), "seeds AS", "seeds4 AS"),
        named(named(fill_sql(k), "picked AS", "p4 AS"), "seeds s", "seeds4 s"),
        named(named(seeds_sql(k, d, rnd), "ranked", "ranked5"), "seeds AS", "seeds5 AS"),
        named(named(fill_sql(k), "picked AS", "p5 AS"), "seeds s", "seeds5 s"),
        preferred_sql(PREFERRED, base="p4"),
        "allp AS (" + " UNION ALL ".join(_tagged(i, n) for i, n in enumerate(["p1", "p2", "p3", "p4", "p5", "swapped"], 1)) + ")",
        """stats AS (SELECT day, count(*) AS input_n, count(DISTINCT source_id) AS input_sources, max(us) AS ref,
    max(us) - min(us) AS max_age FROM ev GROUP BY day)""",
        """cmp AS (SELECT p.day, p.strategy, count(*) AS selected_n,
    1.0 - sum(s.ref - p.us)::DOUBLE / (count(*) * max(s.max_age))::DOUBLE AS freshness,
    count(DISTINCT p.source_id)::DOUBLE / max(s.input_sources) AS diversity
  FROM allp p JOIN stats s ON p.day = s.day GROUP BY p.day, p.strategy)""",
    ]


@query("compare_strategies", with_ev(
    *compare_sql(30, 70),
    "SELECT day, strategy, selected_n, round(freshness, 9) AS freshness, round(diversity, 9) AS diversity, 0.0::DOUBLE AS redundancy FROM cmp"))
def _(spark, sf):
    out = C.compare_strategies(events(spark, sf), 30, BY, diversity=70, preferred=PREFERRED, random_seed=7)
    return out.select("day", "strategy", "selected_n", r9("freshness"), r9("diversity"), r9("redundancy"))


@query("digest_quality_trend", with_ev(
    *compare_sql(30, 70),
    """SELECT substr(day, 1, 7) || '-w' || CAST(CAST(floor((CAST(substr(day, 9, 2) AS INTEGER) - 1) / 7) AS INTEGER) AS VARCHAR) AS period, strategy,
    round(avg(freshness), 9) AS freshness, round(avg(diversity), 9) AS diversity, 0.0::DOUBLE AS redundancy, count(*) AS digests
  FROM cmp GROUP BY 1, 2"""))
def _(spark, sf):
    scores = C.compare_strategies(events(spark, sf), 30, BY, diversity=70, preferred=PREFERRED, random_seed=7)
    week = F.floor((F.substring("day", 9, 2).cast("int") - 1) / 7).cast("int").cast("string")
    out = R.digest_quality_trend(scores, F.concat(F.substring("day", 1, 7), F.lit("-w"), week))
    return out.select("period", "strategy", r9("freshness"), r9("diversity"), r9("redundancy"), "digests")


@query("digest_objective", with_ev(
    SHOWN, KEPT, latest_sql("kept"), top_sql(20, "latest"), scores_sql(shown="event_id IN (SELECT event_id FROM shown)"),
    "SELECT day, round(0.5 * freshness + 0.3 * diversity - 0.2 * redundancy, 6) AS objective FROM scores"))
def _(spark, sf):
    ev = events(spark, sf)
    shown = shown_ids(ev)
    scores = C.digest_scores(C.select_latest_per_source(ev, 20, BY, shown=shown), ev, BY, shown)
    return C.digest_objective(scores, 0.5, 0.3, 0.2).select("day", F.round("objective", 6).alias("objective"))


@query("select_by_objective", with_ev(
    SHOWN, "m AS (SELECT *, CASE WHEN event_id IN (SELECT event_id FROM shown) THEN 1 ELSE 0 END AS seen FROM ev)",
    "st AS (SELECT day, count(*) AS n, count(DISTINCT source_id) AS s, max(us) AS ref, max(us) - min(us) AS span FROM ev GROUP BY day)",
    """v AS (SELECT m.*, s, (0.5::DOUBLE * (CASE WHEN span = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (ref - us) / span END) - 0.2::DOUBLE * seen) / least(st.n, 20) AS v
      FROM m JOIN st USING (day))""",
    "b AS (SELECT *, row_number() OVER (PARTITION BY day, source_id ORDER BY v DESC, us DESC, event_id) AS r FROM v)",
    "g AS (SELECT *, v + CASE WHEN r = 1 THEN 0.3::DOUBLE / s ELSE 0 END AS gain FROM b)",
    """SELECT day, event_id, us, seen = 1 AS is_shown, round(gain, 9) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY gain DESC, us DESC, event_id) AS k FROM g)
    WHERE k <= 20"""))
def _(spark, sf):
    ev = events(spark, sf)
    shown = shown_ids(ev)
    best = C.select_by_objective(ev, 20, BY, 0.5, 0.3, 0.2, shown)
    seen = shown.select("event_id", F.lit(True).alias("is_shown")).distinct()
    return best.join(seen, "event_id", "left").select("day", "event_id", us("timestamp"), F.coalesce("is_shown", F.lit(False)).alias("is_shown"), r9("gain"))


# --- Declared extensions ----------------------------------------------------------------

LAST_US = "1706572800000000"  # 2024-01-30 00:00:00 UTC


@query("suppress_recent", with_ev(
    f"shown AS (SELECT event_id, us FROM ev WHERE us <= {LAST_US} AND us > {LAST_US} - 604800000000)",
    "SELECT day, event_id, source_id, us FROM ev WHERE event_id NOT IN (SELECT event_id FROM shown)"))
def _(spark, sf):
    ev = events(spark, sf)
    at = F.timestamp_micros(F.lit(int(LAST_US)))
    shown = C.recently_shown(ev.select("event_id", F.col("timestamp").alias("shown_at")), at, 604800)
    return rows(C.suppress(ev, shown))


@query("suppress_fingerprint", with_ev(
    "fp AS (SELECT *, sha256(source_id || '~' || event_type || '~' || payload) AS f FROM ev)",
    top_sql(20, "fp", "curated"),
    "recent AS (SELECT DISTINCT f FROM (SELECT f FROM curated ORDER BY us DESC, event_id LIMIT 500))",
    "marked AS (SELECT *, CASE WHEN f IN (SELECT f FROM recent) THEN 1 ELSE 0 END AS is_repeat FROM fp)",
    """SELECT day, event_id, is_repeat, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day
       ORDER BY is_repeat, us DESC, event_id) AS INTEGER) AS position FROM marked) WHERE position <= 25"""))
def _(spark, sf):
    ev = events(spark, sf)
    out = C.demote_repeats(ev, C.select_latest(ev, 20, BY), 500, 25, BY)
    return out.select("day", "event_id", "is_repeat", "position")


def nation_weights(spark, sf):
    """Operator weights from the dimension tables: event types and severities by region, sources by customer."""
    cust = table(spark, sf, "customer").select(
        F.lit("source_id").alias("dimension"), F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("value"),
        F.round(F.col("c_acctbal") / 1000, 2).alias("weight"))
    ev_types = table(spark, sf, "events").groupBy("event_type").agg((F.count(F.lit(1)) % 10).cast("double").alias("weight")).select(
        F.lit("event_type").alias("dimension"), F.col("event_type").alias("value"), "weight")
    return cust.unionByName(ev_types)


@query("weighted_digest", with_ev(
    "w AS (SELECT 'user-' || CAST(c_custkey AS VARCHAR) AS source_id, sum(round(c_acctbal / 1000, 2)) AS sw FROM customer GROUP BY 1)",
    "tw AS (SELECT event_type, CAST(count(*) % 10 AS DOUBLE) AS w FROM events GROUP BY event_type)",
    "weighted AS (SELECT e.*, (0.0 + coalesce(tw.w, 0)) + coalesce(w.sw, 0) AS weight FROM ev e LEFT JOIN w ON e.source_id = w.source_id LEFT JOIN tw ON e.event_type = tw.event_type)",
    """SELECT day, event_id, round(weight, 6) AS weight, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day
       ORDER BY weight DESC, us DESC, event_id) AS INTEGER) AS position FROM weighted) WHERE position <= 20"""))
def _(spark, sf):
    out = C.weighted_digest(events(spark, sf), nation_weights(spark, sf), 20, BY)
    return out.select("day", "event_id", F.round("weight", 6).alias("weight"), "position")


# Roles come from the nation table, so that each role's limits are data.
NATION_ROLES = """nroles AS (SELECT n_name AS role, CAST(3 + n_nationkey % 4 AS INTEGER) AS k,
    CAST(CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 6 END AS INTEGER) AS strategy,
    CAST(40 + n_nationkey AS DOUBLE) AS diversity,
    CASE n_nationkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE 'critical' END AS min_severity,
    CASE WHEN n_nationkey % 4 = 0 THEN 'c' END AS prefix FROM nation)"""


def nation_packs(spark, sf):
    """One pack per region with its nations as roles; AFRICA has no instruction and is refused."""
    n = F.col("n_nationkey")
    strategy = F.element_at(F.array(*[F.lit(i) for i in (1, 2, 3, 4, 6)]), (F.col("n_regionkey") + 1).cast("int"))
    min_sev = F.element_at(F.array(*[F.lit(s) for s in S.SEVERITIES]), (n % 4 + 1).cast("int"))
    role = F.struct(
        F.col("n_name").alias("name"), strategy.alias("curation_strategy"), (n + 40).cast("double").alias("diversity_percent"),
        (n % 4 + 3).cast("int").alias("digest_size"), min_sev.alias("min_severity"),
        F.array().cast("array<string>").alias("event_types"), F.when(n % 4 == 0, "c").alias("event_type_prefix"),
        F.array().cast("array<string>").alias("sources"),
        F.array(F.concat(F.lit("user-"), n.cast("string"))).alias("preferred_sources"),
    )
    etype = F.struct(
        F.lower("n_name").alias("name"), min_sev.alias("default_severity"), F.lit(3).alias("escalate_after_count"),
        F.lit(60).alias("escalate_within_seconds"), F.lit("critical").alias("escalated_severity"),
    )
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_regionkey", "r_name").agg(
        F.collect_list(role).alias("roles"), F.collect_list(etype).alias("event_types")
    ).select(
        F.concat(F.lit("packs/"), F.lower("r_name")).alias("path"),
        F.when(F.col("r_name") != "ASIA", F.col("r_name")).otherwise("").alias("name"), F.lit("").alias("description"),
        F.when(F.col("r_name") != "AFRICA", F.concat(F.lit("Watch "), F.col("r_name"))).alias("instruction"), "roles", "event_types",
    )


def nation_roles(spark, sf):
    return pack_roles(nation_packs(spark, sf))


ROLE_ROWS = f"""role_ev AS (SELECT e.*, r.role, r.k, r.strategy, r.diversity FROM ev e JOIN goodroles r
    ON {rank_sql('e.severity')} >= {rank_sql('r.min_severity')} AND (r.prefix IS NULL OR starts_with(e.event_type, r.prefix)))"""
GOOD_ROLES = "goodroles AS (SELECT r.* FROM nroles r JOIN nation n ON n.n_name = r.role JOIN region g ON g.r_regionkey = n.n_regionkey WHERE g.r_name <> 'AFRICA')"


@query("role_events", with_ev(
    NATION_ROLES, GOOD_ROLES, ROLE_ROWS, "SELECT role, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM role_ev GROUP BY role"))
def _(spark, sf):
    out = C.role_events(events(spark, sf), nation_roles(spark, sf))
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("curate_roles", with_ev(
    NATION_ROLES, GOOD_ROLES, ROLE_ROWS,
    "rlatest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, source_id ORDER BY us DESC, event_id) AS lr FROM role_ev) WHERE lr = 1)",
    """rranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY us, event_id DESC) AS ra,
      row_number() OVER (PARTITION BY role ORDER BY us DESC, event_id) AS rd, count(*) OVER (PARTITION BY role) AS ns FROM rlatest)""",
    """rseeds AS (SELECT role, event_id FROM rranked WHERE (strategy IN (2, 3) AND rd <= k) OR (strategy IN (4, 6)
      AND ra > trunc(ns::DOUBLE * (1 - diversity / 100)) AND ra <= trunc(ns::DOUBLE * (1 - diversity / 100)) + k))""",
    """rpicked AS (SELECT * FROM (SELECT e.*, (s.event_id IS NOT NULL) AS seed, row_number() OVER (PARTITION BY e.role
      ORDER BY (s.event_id IS NOT NULL) DESC, e.us DESC, e.event_id) AS rn
      FROM role_ev e LEFT JOIN rseeds s ON e.role = s.role AND e.event_id = s.event_id) WHERE rn <= k AND (strategy <> 2 OR seed))""",
    "pref AS (SELECT n_name AS role, 'user-' || CAST(n_nationkey AS VARCHAR) AS p FROM nation)",
    """rcand AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.role ORDER BY e.us DESC, e.event_id) AS cr
      FROM role_ev e JOIN pref ON pref.role = e.role AND pref.p = e.source_id WHERE e.strategy = 6) WHERE cr = 1)""",
    """rold AS (SELECT x.*, row_number() OVER (PARTITION BY x.role ORDER BY x.us, x.event_id DESC) AS age_rank,
      max(CASE WHEN x.source_id = pref.p THEN 1 ELSE 0 END) OVER (PARTITION BY x.role) AS covered
      FROM rpicked x JOIN pref ON pref.role = x.role)""",
    """SELECT o.role, CASE WHEN o.strategy = 6 AND o.covered = 0 AND o.age_rank = 1 AND c.event_id IS NOT NULL
      THEN c.event_id ELSE o.event_id END AS event_id FROM rold o LEFT JOIN rcand c ON o.role = c.role"""))
def _(spark, sf):
    return C.curate_roles(events(spark, sf), nation_roles(spark, sf)).select("role", "event_id")


@query("pack_roles", with_ev(
    NATION_ROLES, GOOD_ROLES,
    """SELECT CASE WHEN r_name = 'ASIA' THEN 'packs/asia' ELSE r_name END AS pack, role AS name, strategy, k AS digest_size, diversity, min_severity
    FROM goodroles JOIN nation ON n_name = role JOIN region ON r_regionkey = n_regionkey"""))
def _(spark, sf):
    return nation_roles(spark, sf).select(
        "pack", "name", F.col("curation_strategy").alias("strategy"), "digest_size", F.col("diversity_percent").alias("diversity"), "min_severity")


@query("pack_rejects", """SELECT 'packs/' || lower(r_name) AS path, r_name AS name, 'missing instruction' AS reason FROM region WHERE r_name = 'AFRICA'""")
def _(spark, sf):
    return check_packs(nation_packs(spark, sf)).where(F.col("reason").isNotNull()).select("path", "name", "reason")


def oldest(events, k, k_max=None, **_):
    """A strategy of one's own: the k oldest per group."""
    return top_n(events, [GROUP], [F.col("timestamp").asc(), F.col("event_id").asc()], k)


@query("registered_strategy", with_ev("""SELECT day, event_id, us FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, event_id) AS r FROM ev) WHERE r <= 15"""))
def _(spark, sf):
    C.register_strategy("oldest", oldest)
    return C.select_events(events(spark, sf), "oldest", 15, BY).select("day", "event_id", us("timestamp"))


@query("digest_params", """WITH req AS (SELECT l_orderkey, l_linenumber,
    CAST(l_linenumber AS VARCHAR) AS strategy, CASE WHEN l_returnflag = 'N' THEN 'many' ELSE CAST(CAST(l_quantity AS INTEGER) - 5 AS VARCHAR) END AS k,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS diversity FROM lineitem),
  cast_req AS (SELECT *, try_cast(strategy AS INTEGER) AS s, try_cast(k AS INTEGER) AS kk, try_cast(diversity AS DOUBLE) AS d FROM req)
  SELECT l_orderkey, l_linenumber, CASE WHEN s BETWEEN 1 AND 6 THEN s ELSE 4 END AS strategy,
         coalesce(d, 80.0::DOUBLE) AS diversity, CASE WHEN kk > 0 THEN kk ELSE 20 END AS k FROM cast_req""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    qty = F.col("l_quantity").cast("int")
    req = li.select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("strategy"),
        F.when(F.col("l_returnflag") == "N", "many").otherwise((qty - 5).cast("string")).alias("k"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(qty.cast("string")).alias("diversity"))
    return C.digest_params(req)
