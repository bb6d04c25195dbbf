import random
from collections import defaultdict

import pytest

from auditweave.llm import mixing
from tests.llm.conftest import text


def level(sizes):
    """Targets by sharing the excess again until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: rest * weight[s] / w for s in free} if free else {}
        above = [s for s in free if now[s] >= 3 * sizes[s]]
        if not above:
            return fixed | now
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_repeated_sharing(session, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 40, 1000, 90000]) for i in range(r.randint(1, 9))} | ({None: 77} if seed % 2 else {})
    rows = mixing.targets(session.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = level(sizes)
    assert {x.source: pytest.approx(want[x.source]) for x in rows} == {x.source: x.target for x in rows}


def test_words_taken_come_near_the_target_and_runs_agree(session):
    r = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", min(2000, int(r.paretovariate(1) * 10))) for i in range(3000)]
    df = session.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert sorted(got) == sorted(mixing.mix(df.repartition(7)).collect())
    taken, target = defaultdict(int), {}
    for x in got:
        assert 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
        target[x.source] = x.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 4000, s


def test_copies_of_documents_keep_their_rows(make):
    docs = make([(i, text(i, 5 + i % 40), f"s{i % 4}") for i in range(60)] + [(1, None, None), (None, "a b c", None), (7, "", "s1"), (7, "", "s1")])
    docs = docs.withColumnsRenamed({"lang": "_key"}).withColumn("copies", docs.n_chars).withColumn("_row", docs.source)
    taken = mixing.mix_documents(docs)
    assert taken.columns == docs.columns
    copies = mixing.mix(docs.select("doc_id", "source", mixing.words(docs.text).alias("size"))).collect()
    assert taken.count() == sum(x.copies for x in copies)
    before = {tuple(x) for x in docs.collect()}
    assert all(tuple(x) in before for x in taken.collect())


def test_empty_and_wordless(make):
    assert mixing.mix_documents(make([])).count() == 0
    assert mixing.mix_documents(make([(1, None), (2, "  ")])).count() == 0
