import random
import re

import numpy as np
import pytest

from auditweave.llm import minmax
from auditweave.llm.graph import components
from tests.llm.conftest import edited, text


def brute(rows, k, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(grams(t))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[ids[x]] for b in sets[ids[y]]):
                a, b = sorted((find(ids[x]), find(ids[y])))
                root[b] = a
    return {(i, len(grams(t)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in rows}


def check(make, rows, k, percent=80, partitions=3):
    got = {tuple(x) for x in minmax.near_duplicates(make(rows, partitions), k, percent).collect()}
    assert got == brute(rows, k, percent)
    return got


def test_shingles_and_signature():
    assert len(minmax.shingles("a b c d e", 4)) == 2 and len(minmax.shingles("A B\x0bc", 4)) == 1 and not len(minmax.shingles(" \n", 4))
    assert (minmax.shingles("Aé b", 2) == minmax.shingles("aé\tb", 2)).all() and (minmax.shingles("É b", 2) != minmax.shingles("é b", 2)).all()
    a, b = minmax.shingles(text(1, 900), 4), minmax.shingles(text(1, 800) + " " + text(2, 100), 4)
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = [(x == y).mean() for x, y in zip(minmax.min_max(a), minmax.min_max(b))]
    assert abs(np.mean(same) - real) < 0.12


def test_edge_texts(make):
    check(make, [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d"), (None, "a b"), (None, "a b"), (8, text(1, 50)), (8, text(1, 50)), (9, text(1, 50).upper())], 4)
    assert minmax.near_duplicates(make([]), 4).count() == 0


def test_copies_and_chains(make):
    rows, at = [], 0
    for g in range(6):
        base = text(g, 120)
        for c in range(8):
            base = edited(base, 100 * g + c, 0.02)  # each is like the one before, the last unlike the first
            rows.append((at, base))
            at += 1
    rows += [(at + i, text(1000 + i, 60)) for i in range(30)]
    random.Random(3).shuffle(rows)
    check(make, rows, 4)


def test_original_of_a_large_group_is_not_the_first(make):
    base = text(77, 200)
    rows = [(i, edited(base, i, 0.025)) for i in range(80)] + [(200, base)] + [(300 + i, text(i, 100)) for i in range(10)]
    check(make, rows, 4)


@pytest.mark.parametrize("percent", [45, 60])
def test_many_unlike_members_in_one_bucket(make, percent):
    """Texts that share a half: buckets are full of pairs that fail, and later leaders must find the rest."""
    shared = text(5, 60)
    rows = []
    for i in range(24):
        own = text(100 + i // 3, 45)
        rows.append((i, shared + " " + edited(own, i, 0.03 * (i % 3))))
    check(make, rows, 3, percent)


def test_rows_with_one_id_and_different_texts(make):
    base = text(70, 200)
    rows = [(i, edited(base, i, 0.03)) for i in range(30)] + [(i, edited(base, 100 + i, 0.03)) for i in range(0, 30, 3)]
    check(make, rows, 4)


def test_components_of_paths_and_stars(session):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250)]
    r = random.Random(1)
    r.shuffle(links)
    got = {x.id: x.root for x in components(session.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 250: 200, 300: 200}
