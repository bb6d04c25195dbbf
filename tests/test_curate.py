"""Selection against the stated properties and against a plain Python model."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from auditweave.operators import curate as C
from tests.event_rows import at, event, ids, make_events


@pytest.fixture(scope="module")
def small(spark):
    """Five sources with four events each, event i being i seconds old."""
    rows, age = [], 1
    for s in range(1, 6):
        for _ in range(4):
            rows.append(event(age, f"s{s}", -age))
            age += 1
    return make_events(spark, rows).cache()


def scores(selected, events, shown=None):
    return C.digest_scores(selected, events, shown=shown, as_of=F.lit(at(0))).first()


def test_latest_is_newest_first(small):
    got = C.select_latest(small, 5).orderBy(*C.newest_first())
    assert ids(got) == [f"e{i:05d}" for i in range(1, 6)]


def test_latest_per_source_has_one_row_per_source(small):
    got = C.select_latest_per_source(small, 10)
    assert got.count() == 5 and got.select("source_id").distinct().count() == 5
    assert scores(got, small)["diversity"] >= 0.99


def test_hybrid_covers_all_sources(small):
    got = C.select_hybrid(small, 8)
    assert got.count() == 8 and got.select("source_id").distinct().count() == 5


def test_full_and_low_diversity(small):
    assert C.select_min_diversity(small, 10, 100).select("source_id").distinct().count() == 5
    assert scores(C.select_min_diversity(small, 10, 20), small)["freshness"] >= 0.5


def test_random_eviction_repeats_with_its_seed(small):
    a = sorted(ids(C.select_min_diversity_random(small, 5, 60, 42)))
    assert a == sorted(ids(C.select_min_diversity_random(small, 5, 60, 42)))
    assert any(sorted(ids(C.select_min_diversity_random(small, 5, 60, s))) != a for s in (1, 2, 3))


def test_preferred_source_is_injected(small):
    assert "s5" in {r["source_id"] for r in C.select_preferred(small, 3, 20, ["s5"]).collect()}
    assert sorted(ids(C.select_preferred(small, 3, 20, ["nobody"]))) == sorted(ids(C.select_min_diversity(small, 3, 20)))


def test_suppressed_ids_do_not_leak(spark, small):
    shown = spark.createDataFrame([("e00001",), ("e00002",), ("e00002",)], "event_id string")
    got = C.select_latest(small, 5, shown=shown)
    assert not {"e00001", "e00002"} & set(ids(got))
    assert scores(got, small, shown)["redundancy"] == pytest.approx(0.1)


def test_all_suppressed_group_still_scores(small):
    row = C.digest_scores(C.select_latest(small, 5, shown=small), small, shown=small).first()
    assert (row["selected_n"], row["freshness"], row["diversity"], row["redundancy"]) == (0, 0.0, 0.0, 1.0)


def test_bad_requests(small):
    with pytest.raises(ValueError):
        C.select_events(small, 99, 5)
    with pytest.raises(ValueError):
        C.select_latest(small, -1)
    assert C.select_min_diversity(small, 0, 80).count() == 0


def test_equal_times_score_one(spark):
    ev = make_events(spark, [event(i, f"s{i}", 0) for i in range(4)])
    assert scores(C.select_latest(ev, 2), ev)["freshness"] == 1.0


def test_null_group_keeps_its_rows(spark):
    ev = make_events(spark, [event(i, f"s{i % 3}", i, tenant=None if i % 2 else "t") for i in range(12)])
    ev = ev.withColumn("tenant", F.col("metadata.tenant_id"))
    got = C.select_min_diversity(ev, 3, 80, by=["tenant"])
    assert {r["tenant"]: r["count"] for r in got.groupBy("tenant").count().collect()} == {None: 3, "t": 3}
    assert C.digest_scores(got, ev, ["tenant"]).count() == 2


def test_custom_strategy(small):
    C.register_strategy("oldest", lambda ev, k, **_: C.top_n(ev, [C.GROUP], [F.col("timestamp").asc()], k))
    assert sorted(ids(C.select_events(small, "oldest", 2))) == ["e00019", "e00020"]


# --- Model ------------------------------------------------------------------------


def model(rows, strategy, k, d, preferred):
    """rows: (id, source, second). Direct reading of the rules, one group, no Spark."""
    newest = sorted(rows, key=lambda r: (-r[2], r[0]))
    latest = {}
    for r in newest:
        latest.setdefault(r[1], r)
    if strategy == 1:
        return newest[:k]
    by_age = sorted(latest.values(), key=lambda r: (-r[2], r[0]))
    if strategy == 2:
        return by_age[:k]
    if strategy == 3:
        out = by_age[:k]
    else:
        drop = int(len(latest) * (1 - min(max(d, 0), 100) / 100))
        out = by_age[::-1][drop:][:k]
    for r in newest:
        if len(out) >= k:
            break
        if r not in out:
            out = out + [r]
    if strategy == 6 and out and not any(r[1] in preferred for r in out):
        cand = [r for r in newest if r[1] in preferred]
        if cand:
            oldest = min(out, key=lambda r: (r[2], [-ord(c) for c in r[0]]))
            out = [r for r in out if r != oldest] + cand[:1]
    return out


@pytest.mark.parametrize("strategy", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("case", range(3))
def test_strategies_equal_the_model(spark, strategy, case):
    rng = random.Random(case * 10 + strategy)
    rows = [(f"e{i:05d}", f"s{min(int(rng.expovariate(0.15)), 40)}", rng.randrange(0, 400 if case else 30)) for i in range(300)]
    groups = {g: [r for i, r in enumerate(rows) if i % 3 % 2 == g] for g in (0, 1)}
    k, d = rng.choice([1, 4, 15, 60, 400]), rng.choice([0, 20, 35.5, 80, 100])
    preferred = ["s38", "s39", "s11"]
    data = [event(0, r[1], r[2], tenant=str(g), event_id=r[0]) for g, rs in groups.items() for r in rs]
    ev = make_events(spark, data).withColumn("tenant", F.col("metadata.tenant_id"))
    got = C.select_events(ev, strategy, k, ["tenant"], diversity=d, preferred=preferred, cell_micros=7_000_000)
    found = {g: sorted(r["event_id"] for r in got.where(F.col("tenant") == str(g)).collect()) for g in groups}
    assert found == {g: sorted(r[0] for r in model(rs, strategy, k, d, preferred)) for g, rs in groups.items()}


@pytest.mark.parametrize("bound", [500_000, 1])
def test_late_fetch_returns_the_same_rows(spark, small, monkeypatch, bound):
    monkeypatch.setattr(C.fetch_events, "__defaults__", (bound,))
    late = C.select_min_diversity(small, 8, 80, by=["event_type"], late=True)
    assert late.columns == small.columns
    assert sorted(late.collect()) == sorted(C.select_min_diversity(small, 8, 80, by=["event_type"]).collect())


def test_truncation_uses_double_arithmetic(spark):
    """5 sources at 80 percent drop 0, because 5 * (1 - 0.8) is just under 1."""
    ev = make_events(spark, [event(i, f"s{i}", i) for i in range(5)])
    assert sorted(ids(C.select_min_diversity(ev, 1, 80))) == ["e00000"]


def test_roles_get_their_own_digest(spark, small):
    from auditweave import schema as S
    roles = spark.createDataFrame([
        ("chief", 1, 0.0, 3, None, [], None, [], []),
        ("line", 6, 20.0, 3, "info", ["tick"], "t", [], ["s5"]),
        ("safety", 1, 0.0, 3, "error", [], None, [], []),
    ], S.ROLE)
    got = C.curate_roles(small, roles)
    rows = {(r["role"], r["event_id"], r["source_id"]) for r in got.collect()}
    assert {r[1] for r in rows if r[0] == "chief"} == {"e00001", "e00002", "e00003"}
    assert "s5" in {r[2] for r in rows if r[0] == "line"} and not [r for r in rows if r[0] == "safety"]


def naive_objective(chosen, rows, seen, k, weights):
    """rows: id -> (source, seconds); the value of a chosen set."""
    top, low = max(t for _, t in rows.values()), min(t for _, t in rows.values())
    fresh = sum(1 - (top - rows[i][1]) / (top - low) if top > low else 1 for i in chosen) / len(chosen)
    diverse = len({rows[i][0] for i in chosen}) / len({s for s, _ in rows.values()})
    return weights[0] * fresh + weights[1] * diverse - weights[2] * len(chosen & seen) / len(chosen)


def test_objective_selection_equals_trying_all_sets(spark):
    r, data, groups = random.Random(8), [], {}
    for g in range(40):
        rows = {f"g{g:02d}-{i}": (f"s{r.randrange(r.choice([1, 2, 5]))}", r.randrange(r.choice([1, 4, 50]))) for i in range(r.randint(1, 8))}
        groups[f"g{g:02d}"] = (rows, {i for i in rows if r.random() < 0.4})
        data += [event(0, s, t, event_type=f"g{g:02d}", event_id=i) for i, (s, t) in rows.items()]
    ev = make_events(spark, data)
    shown = spark.createDataFrame([(i,) for _, seen in groups.values() for i in seen], "event_id string")
    for k, weights in [(1, (1.0, 1.0, 1.0)), (3, (0.5, 0.3, 0.2)), (4, (0.1, 2.0, 0.7)), (3, (-1.0, 0.5, -0.4)), (20, (1.0, 0.0, 0.0))]:
        got = C.select_by_objective(ev, k, ["event_type"], *weights, shown).collect()
        for g, (rows, seen) in groups.items():
            mine = {x["event_id"]: x["gain"] for x in got if x["event_type"] == g}
            size = min(k, len(rows))
            best = max(naive_objective(set(c), rows, seen, k, weights) for c in combinations(rows, size))
            assert len(mine) == size and abs(sum(mine.values()) - best) < 1e-9
            assert abs(naive_objective(set(mine), rows, seen, k, weights) - best) < 1e-9


def test_objective_selection_edges(spark):
    ev = make_events(spark, [event(i, "s" if i else None, i) for i in range(3)]).withColumn("timestamp", F.when(F.col("event_id") != "e00002", F.col("timestamp")))
    got = {r["event_id"]: r["gain"] for r in C.select_by_objective(ev, 9).collect()}
    assert got == {"e00000": 0.0, "e00001": pytest.approx(4 / 3), "e00002": 0.0}
    assert C.select_by_objective(ev.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="negative"):
        C.select_by_objective(ev, 3, diverse=-1)
