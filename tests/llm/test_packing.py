import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditweave.llm import packing
from auditweave.llm.base import shared_path
from tests.llm.conftest import text


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 200, 257, 50257, 70000, 2**31, 2**32])
def test_bits_and_random_access(vocabulary):
    r = np.random.default_rng(vocabulary)
    for n in (0, 1, 7, 8, 9, 4095, 4096, 4097, 9000):
        ids = r.integers(0, vocabulary, n).astype(np.uint32)
        shard = packing.Shard(packing.write_shard([5, None, 7], [n // 3, 0, n - n // 3], ids, vocabulary))
        assert shard.doc_ids == [5, None, 7] and (shard.ids() == ids).all()
        assert (shard.document(2) == ids[n // 3:]).all() and not len(shard.document(1))
        for first in (0, n // 2, max(0, n - 1)):
            assert (shard.ids(first, min(100, n - first)) == ids[first:first + 100]).all()
    assert len(packing.pack_bits(np.zeros(80, dtype=np.uint32), packing.width_of(vocabulary))) == 10 * packing.width_of(vocabulary)


def test_foreign_bytes_and_ids_are_refused():
    with pytest.raises(ValueError):
        packing.Shard(b"\0" * 64)
    with pytest.raises(ValueError):
        packing.write_shard([1], [1], np.array([9]), 9)


def test_documents_come_back_in_order(session, make, monkeypatch):
    cases = [(9, "Hello  the world\n <|endoftext|> x"), (2, None), (30, ""), (None, "ünïcode " * 50), (9, "another nine"), (9, "another nine")]
    cases += [(i, text(i, i % 90)) for i in range(100, 400)] + [(50, text(3, 60000))]
    path = shared_path(session, "t")
    packing.write_packed(make(cases).withColumnRenamed("lang", "part").withColumnRenamed("source", "shard"), path)
    got = packing.read_packed(session, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tokenizer.encode_special_tokens = True
    at = 0
    for x, (doc_id, t) in zip(got, sorted(cases, key=lambda c: (c[0] is not None, c[0] or 0, c[1] or "")), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_empty_table(session, make):
    path = shared_path(session, "t")
    packing.write_packed(make([]), path)
    assert packing.read_packed(session, path).count() == 0


def test_a_worker_with_little_memory_encodes_alike(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 5)
    texts = [text(i % 7, 80) for i in range(30)]
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    first = encoder.encode(texts)
    assert first == [encoder.encode([t])[0] for t in texts]
