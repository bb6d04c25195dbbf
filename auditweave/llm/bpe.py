"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

Every match of the pattern is merged on its own. A segment tree over its byte positions stores the rank of the pair that
starts at each live position; its root is the leftmost minimum, and a merge updates at most three positions (the merged
pair, the neighbour before it and the position that died), each in logarithmic time. So a match of any length takes
n log n steps.

Matches repeat, so each worker remembers the ids of short ones in a table of bounded size; the result does not depend on
it. Defined results: null and empty texts have no ids; repeated rows and null doc_ids are encoded each for itself.
"""

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditweave.llm.base import map_batches, query, table
from auditweave.llm.cutting import chunks, stretches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Unicode's White_Space, which is what the pattern's white space means, where the engine's own class may be wider.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
    r"\S", r"\P{White_Space}")
#: Longest text that a worker remembers, and its numbers of matches and of chunks.
LONGEST, MATCHES, CHUNKS = 48, 400_000, 250_000


def merge(piece: bytes, ranks: dict[bytes, int], longest: int = 1 << 30) -> list[int]:
    """Ids of one match: merge the leftmost pair of least rank until no pair has a rank.

    ``longest``: length of the longest token; longer candidates are not looked up.
    """
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    find = ranks.get
    # A leaf holds rank and position in one number, so the least is the leftmost of the least rank. Numbers of short
    # matches stay below 2^30, which Python handles fastest.
    shift = n.bit_length()
    place = (1 << shift) - 1
    none = 1 << 29 if shift <= 10 else 1 << shift + 32
    size = 1 << (n - 2).bit_length()
    leaves = [none] * size
    for i in range(n - 1):
        rank = find(piece[i:i + 2])
        if rank is not None:
            leaves[i] = rank << shift | i
    tree = [none] * size + leaves
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 2))  # the next live position
    before = list(range(-1, n))
    least = tree[1]
    while least != none:
        at = least & place
        gone = after[at]
        after[at] = end = after[gone]
        before[end] = at
        # The pair that starts here.
        rank = find(piece[at:after[end]]) if end < n and after[end] - at <= longest else None
        k = size + at
        tree[k] = none if rank is None else rank << shift | at
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                break
            tree[k] = a
            k >>= 1
        # The position that died, unless it started no pair.
        k = size + gone
        if gone < n - 1 and tree[k] != none:
            tree[k] = none
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
        # The pair before.
        left = before[at]
        if left >= 0:
            rank = find(piece[left:end]) if end - left <= longest else None
            k = size + left
            value = none if rank is None else rank << shift | left
            if tree[k] != value:
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if b < a:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
                    k >>= 1
        least = tree[1]
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:after[at]]])
        at = after[at]
    return ids


class _Remembered(dict):
    """Computes what it does not hold. Of short keys it remembers the last ones: a full table becomes the old one, and
    what is asked for again moves on to the new one."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Ids of texts and bytes of ids, by the ranks in a file of ``base64(token) rank`` lines."""

    def __init__(self, path: str, matches: int | None = None, chunks: int | None = None):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(PATTERN)
        self._piece = _Remembered(self._encode_piece, matches or MATCHES)
        self._chunk = _Remembered(self._encode_chunk, chunks or CHUNKS)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(merge(raw, self.ranks, self.longest))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._piece.__getitem__, self.pattern.findall(chunk))))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; nothing in it is a special token."""
        return list(chain.from_iterable(map(self._chunk.__getitem__, chunks(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha-256 of the decimal ids joined by a space, sha-256 of the decoded bytes."""
        n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for part in stretches(text):
            ids = self.encode(part)
            if ids:
                ids_hash.update(((" " if n else "") + " ".join(map(self.names.__getitem__, ids))).encode())
                bytes_hash.update(self.decode(ids))
                n += len(ids)
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, matches: int | None = None, chunks: int | None = None) -> Codec:
    """One codec for each file and worker."""
    return Codec(path, matches, chunks)


def forget() -> None:
    codec.cache_clear()


def encode_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its ids, one row per row of ``docs`` (doc_id, text)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def ids(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "ids": [codec(path).encode(t.as_py() or "") for t in batch["text"]]}

    return map_batches(docs.select("doc_id", "text"), ids, "doc_id long, ids array<int>")


def decode_table(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of its ids (doc_id, ids); null ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def texts(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "data": [codec(path).decode(x.as_py() or ()) for x in batch["ids"]]}

    return map_batches(coded.select("doc_id", "ids"), texts, "doc_id long, data binary")


def digests(docs: DataFrame, path: str | None = None, matches: int | None = None, chunks: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids of a long text are never held together.

    ``matches`` and ``chunks`` bound what a worker remembers (by default MATCHES and CHUNKS).
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, matches, chunks)
        found = [own.digest(t.as_py() or "") for t in batch["text"]]
        n, ids, data = zip(*found)
        return {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": data}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
