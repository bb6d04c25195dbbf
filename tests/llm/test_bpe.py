import base64
import random

import public_tokenizers
import pytest
import tiktoken

from auditweave.llm import bpe
from auditweave.llm.cutting import chunks, stretches
from tests.llm.conftest import text

PATH = public_tokenizers.path(bpe.VOCABULARY)
ALPHABET = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "b", "é", "1", "٣", "!", "'s", "'ll", "中", "😀", "​", "the", "ing", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_merge_takes_the_leftmost_least_rank():
    r = random.Random(4)
    for _ in range(300):
        ranks = {bytes([c]): i for i, c in enumerate(b"abcd")}
        for _ in range(r.randint(0, 30)):
            new = r.choice(list(ranks)) + r.choice(list(ranks))
            ranks.setdefault(new, len(ranks))
        piece = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 60)))
        assert bpe.merge(piece, ranks) == naive(piece, ranks)


def test_long_matches(reference):
    codec = bpe.codec(PATH)
    for t in ("ab" * 3000 + "x" * 5000, "é" * 3000, " " * 4000 + "a", "\n" * 2000):
        assert codec.encode(t) == reference.encode_ordinary(t)


def test_random_texts_and_round_trip(reference):
    r, codec = random.Random(8), bpe.codec(PATH)
    for _ in range(3000):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30)))
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_cuts_join_to_the_text(monkeypatch):
    monkeypatch.setattr("auditweave.llm.cutting.STRETCH", 50)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 300)))
        assert "".join(chunks(t)) == t and "".join(stretches(t)) == t
        codec = bpe.codec(PATH)
        assert [i for s in stretches(t) for i in codec.encode(s)] == codec.encode(t)


def test_small_memory_gives_the_same_ids(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MATCHES", 3)
    monkeypatch.setattr(bpe, "CHUNKS", 2)
    t = text(3, 500)
    assert bpe.Codec(PATH).encode(t) == reference.encode_ordinary(t)


def test_tables(make, reference):
    cases = [(1, "Hello the world"), (2, None), (3, ""), (None, "ß " * 900), (3, ""), (4, text(1, 3000))]
    docs = make(cases).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    coded = bpe.encode_table(docs)
    assert sorted(map(repr, ((x.doc_id, x.ids) for x in coded.collect()))) == sorted(repr((i, reference.encode_ordinary(t or ""))) for i, t in cases)
    assert sorted(map(repr, ((x.doc_id, bytes(x.data)) for x in bpe.decode_table(coded).collect()))) == sorted(repr((i, (t or "").encode())) for i, t in cases)
    assert bpe.digests(make([])).count() == 0
    assert {x.n_tokens for x in bpe.digests(docs).where("doc_id IN (2, 3)").collect()} == {0}
