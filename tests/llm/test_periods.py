import hashlib
import random
import zlib

import numpy as np
import pytest

from auditweave.llm import periods
from tests.llm.conftest import text


def naive_runs(words, least=periods.LEAST):
    """Every period, every maximal stretch, without those that have a smaller one."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda r: (r[0], r[2]))


def naive_rewritten(doc_id, value):
    words = (value or "").encode().split()
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def naive_row(doc_id, value):
    words = naive_rewritten(doc_id, value)
    runs = naive_runs(words)
    dropped = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def numbers(words):
    return np.unique(np.array(words), return_inverse=True)[1].astype(np.int32)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(400):
        words = []
        while len(words) < r.randint(1, 90):
            piece = [r.randint(0, r.choice([0, 1, 2, 6])) for _ in range(r.randint(1, 12))]
            words += piece * r.randint(1, 6)
            if r.random() < 0.3:
                words += words[r.randrange(len(words)):][:20]
        for least in (2, 5, 12):
            assert periods.runs_of(numbers(words), least) == naive_runs(words, least), (words, least)


def test_fibonacci_and_one_word():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    assert periods.runs_of(numbers(b), 2) == naive_runs(b, 2)
    assert periods.runs_of(numbers([3] * 5000)) == [(0, 5000, 1)]
    assert periods.runs_of(numbers(list(range(50)) * 300)) == [(0, 15000, 50)]


def test_texts_that_repeat_nothing_are_passed_over():
    texts = [text(1, 300).encode(), (text(2, 30) + " " + text(3, 6) + " x " + text(3, 6)).encode(), b"", b"a " * 6, b"a " * 7]
    hashes, own, _ = periods.word_hashes(texts)
    assert periods.may_repeat(hashes, own, len(texts), 6).tolist() == [False, True, False, False, True]


CASES = [(i, text(i, n)) for i, n in zip(range(150), [1, 2, 5, 11, 12, 13, 40, 90, 200, 333] * 15)] + [
    (None, "a " * 20), (200, None), (201, ""), (202, " \t\n "), (203, "é   x " * 9), (204, "ab\x0bcd\x0c" * 12), (205, "nul\x00 w " * 20), (206, "a " * 30),
    (206, "a " * 30), (206, "other"), (-7, "b c " * 9 + "b"), (207, (text(9, 14) + "\n") * 7), (208, " ".join(text(9, 500).split() * 2)), (209, text(4, 9000))]


def test_query_against_brute_force(make):
    docs = make([c for c in CASES if c[0] != 209])
    want = sorted(repr(naive_row(*c)) for c in CASES if c[0] != 209)
    assert sorted(repr(tuple(x)) for x in periods.digest(periods.periodic_runs(periods.with_planted_runs(docs))).collect()) == want
    rewritten = {repr((x.doc_id, x.text.encode().split())) for x in periods.with_planted_runs(docs).collect()}
    assert rewritten == {repr((i, naive_rewritten(i, t))) for i, t in CASES if i != 209}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in CASES if i is not None) > 10


def test_interface_and_clashing_columns(make):
    docs = make(CASES).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed").withColumnRenamed("n_chars", "n")
    got = {(x.doc_id, x.n_words): (x.runs, x.collapsed) for x in periods.periodic_runs(docs).collect()}
    assert got[(206, 30)] == ([(0, 30, 1)], "a") and got[(200, 0)] == ([], "") and got[(209, 9000)][0] == []
    assert got[(207, 98)] == ([(0, 98, 14)], text(9, 14))
    assert periods.digest(periods.periodic_runs(periods.with_planted_runs(docs))).count() == len(CASES)
    assert periods.digest(periods.periodic_runs(periods.with_planted_runs(make([])))).count() == 0
