import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from auditweave.llm import suffixes
from auditweave.llm.hashing import Hashes
from tests.llm.conftest import edited, text


def brute(rows, length):
    """Kept bytes and removed ranges per row; rows with one doc_id and one text are one document."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, cover = set(), {}
    for known, i, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if s in seen:
                gone[p:p + length] = True
            seen.add(s)
        cover[known, i, t] = gone
    out = []
    for i, t in rows:
        gone = cover[i is not None, i or 0, t or ""]
        raw = (t or "").encode()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((i, bytes(b for b, g in zip(raw, gone) if not g), [tuple(e) for e in edges.reshape(-1, 2).tolist()], len(raw)))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((x.doc_id, bytes(x.data), [tuple(r) for r in x.runs], x.n_bytes)) for x in df.collect())


def test_hashes_and_extension():
    r = np.random.default_rng(1)
    data = np.concatenate([p := r.integers(97, 100, 300).astype(np.uint8), p])
    h = Hashes(data)
    assert h.of(np.array([0]), 50) == h.of(np.array([300]), 50)
    x, y = r.integers(0, 540, 500), r.integers(0, 540, 500)
    want = [next((k for k in range(60) if data[a + k] != data[b + k]), 60) for a, b in zip(x, y)]
    assert suffixes.common_extension(h, x, y, 60).tolist() == want


@pytest.mark.parametrize("bits", [64, 3])
def test_sort_with_and_without_collisions(bits):
    r = random.Random(5)
    for t in range(40):
        data = np.array([r.choice(b"ab" if t % 2 else b"abcdefgh") for _ in range(r.randint(60, 900))], dtype=np.uint8)
        data = np.concatenate([data, data[:len(data) // 2], data]) if t % 3 == 0 else data
        limit = r.choice([8, 9, 16, 31, 32, 50])
        places = len(data) - limit + 1
        starts = np.array(r.sample(range(places), min(places, r.randint(0, 400))), dtype=np.int64)
        order, same = suffixes.sort_suffixes(data, starts, limit, bits)
        content = [data[s:s + limit].tobytes() for s in starts]
        want = sorted(range(len(starts)), key=lambda i: (content[i], i))
        assert order.tolist() == want
        assert same.tolist() == [k > 0 and content[want[k]] == content[want[k - 1]] for k in range(len(want))]


def corpus(seed):
    r = random.Random(seed)
    base = [text(i, 60) for i in range(12)]
    rows = []
    for i in range(60):
        parts = [r.choice([text(1000 + i, r.randint(0, 30)), edited(r.choice(base), i, r.choice([0, 0.05])), r.choice(base)[r.randrange(80):]]) for _ in range(r.randint(0, 4))]
        rows.append((r.choice([i, i, i, 7, None]), " ".join(parts)))
    return rows + [(900, None), (901, ""), (902, "ab" * 400), (903, "x" * 500), (904, "é" * 120), (905, "é" * 120)] + rows[:3]


def no_ties(rows):
    """Rows that share a doc_id with another text are ordered by a hash: leave one of each."""
    first = {}
    return [(i, t) for i, t in rows if first.setdefault(i, t) == t]


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 100, 24), (2, 40, 12), (3, 12, 5)])
def test_equals_brute_force(make, seed, length, gram):
    rows = no_ties(corpus(seed))
    assert found(suffixes.dedup_bytes(make(rows, 5), length, gram)) == brute(rows, length)


def test_rows_with_one_id_and_edge_tables(make):
    rows = corpus(4)
    got = suffixes.dedup_bytes(make(rows).withColumnRenamed("lang", "place").withColumnRenamed("source", "mark").withColumnRenamed("n_chars", "again"), 30, 9)
    assert got.count() == len(rows)
    assert suffixes.dedup_bytes(make([]), 30, 9).count() == 0


def in_process(rows, length, gram, blocks):
    """The steps without Spark, so that their bounds can be made small."""
    tagged = [(i, int(hashlib.md5(t.encode()).hexdigest()[:4], 16), t.encode()) for i, t in rows]
    emitted = [b for k in range(blocks) for b in suffixes._emit_classes(tagged[k::blocks], length, gram)]
    rows_ = pa.Table.from_batches(emitted).sort_by([(c, "ascending") for c in ("key", "kind", "whole", "doc", "mark", "place")])
    met = pa.Table.from_batches(suffixes._meet(iter(rows_.to_batches(max_chunksize=37)))).to_pylist()
    texts = {i: t for i, _, t in tagged}
    spans = [(m["doc"], m["place"], m["number"]) for m in met if m["kind"] == suffixes.REMOVED]
    for kind, steps in ((suffixes.CLASS, [(suffixes._sort_classes(length), ("key",))]),
                        (suffixes.DEALT, [(suffixes._deal(length), ("key",)), (suffixes._first_of_dealt, ("x", "y", "doc", "mark", "place"))])):
        own = [m | {"piece": texts[m["doc"]][m["place"]:m["place"] + m["number"] + length - 1]} for m in met if m["kind"] == kind]
        if own:
            t = pa.Table.from_pylist(own)
            for step, by in steps:
                batches = t.sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=23)
                t = pa.Table.from_batches(step(iter(batches)))
            spans += [(m["doc"], m["place"], m["number"]) for m in t.to_pylist()]
    out = []
    for i, _, raw in tagged:
        runs = suffixes.removed_runs([{"start": s, "number": n} for d, s, n in spans if d == i], length)
        edges = [0, *(e for r in runs for e in r), len(raw)]
        out.append((i, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), runs, len(raw)))
    return sorted(map(repr, out)), {m["kind"] for m in met}


@pytest.mark.parametrize(("common", "limit", "stretch", "sorted_"), [(256, 20000, 1 << 19, 1 << 21), (2, 20000, 1 << 19, 50), (256, 3, 200, 1 << 21), (3, 4, 64, 300)])
def test_common_grams_and_small_bounds(monkeypatch, common, limit, stretch, sorted_):
    for name, value in (("COMMON", common), ("LIMIT", limit), ("STRETCH", stretch), ("SORTED", sorted_)):
        monkeypatch.setattr(suffixes, name, value)
    line = text(50, 14)
    rows = [(i, f"{text(200 + i, 12)} {line} {text(300 + i % 9, 12)}") for i in range(40)] + [(i + 100, t or "") for i, (_, t) in enumerate(corpus(6))]
    got, kinds = in_process(rows, 40, 12, 3)
    assert got == brute(rows, 40)
    assert (suffixes.DEALT in kinds) == (common < 256 or limit < 100)


def near_collision(start, bits=22):
    """Two texts that begin alike and whose hashes agree in so many bits."""
    seen = {}
    for i in range(1 << 20):
        t = f"{start} {i}"
        low = xxhash.xxh64_intdigest(t, 42) % (1 << bits)
        if low in seen:
            return seen[low], t
        seen[low] = t


def test_documents_without_an_id_or_with_one_id_stay_apart(make):
    """Texts whose hashes agree in 22 bits are not one document: a shared passage stays in one of them."""
    passage = text(70, 60)
    a, b = near_collision(passage)
    for ids in ((None, None), (7, 7)):
        got = {bytes(r.data).decode() for r in suffixes.dedup_bytes(make([(ids[0], a), (ids[1], b), (8, text(71, 60))])).collect()}
        assert len(got & {a, b}) == 1 and text(71, 60) in got
    # A real id equal to the number that stands for null.
    got = suffixes.dedup_bytes(make([(None, a), (suffixes.NULL_ID, "x"), (suffixes.NULL_ID, "x"), (9, b)])).collect()
    assert sorted(repr((r.doc_id, bytes(r.data) == a.encode())) for r in got) == sorted(map(repr, [(None, True), (suffixes.NULL_ID, False), (suffixes.NULL_ID, False), (9, False)]))
