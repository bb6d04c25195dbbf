import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from auditweave.llm import simhash
from tests.llm.conftest import edited, text


def naive_fingerprint(value):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), value or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_roots(values, radius=3):
    """Root of each distinct value, by comparing all."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    return {v: find(v) for v in values}


def naive_rows(rows):
    marks = [naive_fingerprint(t) for _, t in rows]
    roots = naive_roots(marks)
    least = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[roots[m]] = min(i, least.get(roots[m], i))
    return sorted(repr((i, f"{m:016x}", least.get(roots[m]))) for (i, _), m in zip(rows, marks))


def near(seed, n):
    """Numbers in clusters whose members are a few bits from each other, beside lone ones."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        v = r.getrandbits(64)
        out.add(v)
        for _ in range(r.choice([0, 0, 1, 5])):
            for b in r.sample(range(64), r.randint(1, 4)):
                v ^= 1 << b
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_what_comparing_all_finds(seed):
    values = near(seed, 150)
    random.Random(seed).shuffle(values)
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        for radius in (0, 3, 9):
            assert sorted(tree.within(v, radius)) == [j for j in range(i) if (v ^ values[j]).bit_count() <= radius]
        tree.add(v)
    links = simhash.links_of(values, 3)
    assert len(links) < len(values) and all((a ^ b).bit_count() <= 3 for a, b in links)
    assert parts(naive_roots(values)) == parts(joined(values, links))


def joined(values, links):
    root = {v: v for v in values}
    find = lambda v: v if root[v] == v else find(root[v])
    for a, b in links:
        root[find(a)] = find(b)
    return {v: find(v) for v in values}


def parts(roots):
    out = {}
    for v, r in roots.items():
        out.setdefault(r, set()).add(v)
    return sorted(map(sorted, out.values()))


def test_blocks_cover_the_open_bits():
    for mask in (0, 0xFFFF, (1 << 64) - 8, (1 << 64) - 1):
        found = simhash.blocks(mask, 4)
        assert all(f & mask == mask and f != mask for f in found)
        union = 0
        for f in found:
            assert union & (f ^ mask) == 0
            union |= f ^ mask
        assert union | mask == (1 << 64) - 1


@pytest.mark.parametrize("largest", [80, 2048])
def test_shards_dealt_again_lose_no_pair(session, largest):
    # Many equal bits: shards of all depths are crowded.
    r = random.Random(largest)
    values = sorted({r.getrandbits(64) & 0x8000F000000001FF for _ in range(150)} | set(near(3, 80)) | {1 << b for b in range(64)})
    df = session.createDataFrame([(simhash._signed(v),) for v in values], "value long").repartition(3)
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.link_nodes(df, 3, largest).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert parts(joined(values, got)) == parts(naive_roots(values))


BASE = text(1, 400)
CASES = [(i, text(i, 1 + i % 70)) for i in range(60)] + [(100 + i, edited(BASE, i, 0.004 * (i % 4))) for i in range(40)] + [
    (None, None), (None, BASE), (200, None), (201, ""), (202, " \t\n"), (203, "ONE two"), (204, "one TWO"), (205, "É é É"), (206, "a b c " * 50), (206, "a b c " * 50),
    (207, "x"), (None, text(77, 50)), (208, text(4, 4000)), (209, text(4, 4000) + " end")]


def test_rows_against_brute_force(make, monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH", 64)
    assert [simhash.fingerprint(t or "") for _, t in CASES] == [naive_fingerprint(t) for _, t in CASES]
    docs = make(CASES).withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "value").withColumnRenamed("n_chars", "root")
    got = simhash.near_duplicates(docs, largest=50)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted(repr(tuple(x)) for x in got.collect()) == naive_rows(CASES)
    assert len({x.component_id for x in got.where(F.col("doc_id").between(100, 139)).collect()}) < 40


def test_empty_tables(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert [tuple(x) for x in simhash.near_duplicates(make([(None, None)])).collect()] == [(None, "0" * 16, None)]
