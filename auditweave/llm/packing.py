"""Token ids in fixed-width bit packing.

A shard is one byte string of documents in ascending doc_id order:

    magic "FWBP", version, bits per id, ids per block            4 x uint32
    documents, ids, blocks                                       3 x uint64
    doc_id (int64) and a flag for null doc_ids (uint8)           per document
    first id of each document and the end                        uint64, documents + 1
    byte offset of each block in the payload and the end         uint64, blocks + 1
    payload: ids of width bits, low bits first; every block starts at a byte

The width is the least number of bits that holds the vocabulary. A block's offset and the width give the place of any
id, so readers unpack any range with a few numpy operations, without the ids before it.

Shards are the rows of a Parquet dataset (part, shard, n_docs, n_ids, data), which Spark writes to any store and commits
task by task. Parts are ranges of doc_id in ascending order; a document is never split, so a shard holds about SHARD_IDS
ids or one longer document.

Defined results: null texts are empty and consist of the end id; null doc_ids come first; rows with one doc_id stay
together, in the order of their texts; an empty table gives an empty dataset. Other columns of the input are not read.
"""

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave.llm.base import map_batches, query, shared_path, table, worker_memory
from auditweave.llm.cutting import chunks, odd, stretches
from auditweave.llm.hashing import BASES, Hashes

TOKENIZER = "byte_bpe_50k.json"
END = 2
BLOCK = 4096
SHARD_IDS = 1 << 18
_HEAD = struct.Struct("<4sIIIQQQ")
#: Chunks a worker remembers (two tables of this size), and the longest of them.
CHUNKS, LONGEST = 700_000, 48


_MARK, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, low bits first, filled up to a byte."""
    n = len(ids)
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    groups = np.zeros((-(-n // 8), 8), dtype=np.uint64)
    groups.ravel()[:n] = ids
    out = np.zeros((len(groups), width + 5), dtype=np.uint8)  # eight ids fill width bytes
    for k in range(8):
        at, bit = divmod(k * width, 8)
        value = groups[:, k] << np.uint64(bit)
        for j in range(-(-(width + bit) // 8)):
            out[:, at + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :width].tobytes()[: -(-n * width // 8)]


def unpack_bits(data: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    """``n`` ids from the ``first`` on, of bytes packed by ``pack_bits``."""
    if width in (8, 16, 32):
        return np.frombuffer(data.tobytes(), dtype=f"<u{width // 8}", count=n, offset=first * width // 8).astype(np.uint32)
    bit = np.arange(first, first + n, dtype=np.int64) * width
    at = bit >> 3
    padded = np.concatenate([data[: -(-(first + n) * width // 8)], np.zeros(5, dtype=np.uint8)])
    value = np.zeros(n, dtype=np.uint64)
    for j in range(-(-(width + 7) // 8)):
        value |= padded[at + j].astype(np.uint64) << np.uint64(8 * j)
    return ((value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_shard(doc_ids: list, lengths: list[int], ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    if block % 8:
        raise ValueError("a block must hold a multiple of eight ids")
    width = width_of(vocabulary)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary")
    payload = pack_bits(ids, width)  # blocks of a multiple of eight ids end at a byte
    blocks = -(-len(ids) // block)
    offsets = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block * width // 8), np.uint64(len(payload)))
    return b"".join([
        _HEAD.pack(b"FWBP", 1, width, block, len(doc_ids), len(ids), blocks),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.cumsum([0, *lengths], dtype="<u8").tobytes(), offsets.astype("<u8").tobytes(), payload,
    ])


class Shard:
    """Reader of one shard: documents, their places, and any range of ids."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.block, docs, self.n_ids, blocks = _HEAD.unpack_from(data)
        if magic != b"FWBP" or version != 1:
            raise ValueError("not a shard of packed ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        values, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if gone else int(v) for v, gone in zip(values, nulls)]
        self.starts, self.offsets = take("<u8", docs + 1), take("<u8", blocks + 1)
        self.payload = np.frombuffer(data, dtype=np.uint8, offset=at)

    def ids(self, first: int = 0, n: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the shard; only their blocks are read."""
        n = self.n_ids - first if n is None else n
        if n <= 0:
            return np.zeros(0, dtype=np.uint32)
        inside = first % self.block
        low, high = self.offsets[first // self.block], self.offsets[-(-(first + n) // self.block)]
        return unpack_bits(self.payload[low:high], inside, n, self.width)

    def document(self, k: int) -> np.ndarray:
        first = int(self.starts[k])
        return self.ids(first, int(self.starts[k + 1]) - first)


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian uint32 bytes.

    No token crosses the cuts of ``chunks``, so each chunk needs to be encoded once while a worker remembers it. New
    chunks that start with their only space and end in a visible character are encoded as one text; every token that
    starts with a space starts a chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=0) + 1
        self.starts_chunk = np.zeros(self.size, dtype=bool)
        self.starts_chunk[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of chunks by the library: those with one space, at their start, and a visible end are one text."""
        plain = [c.rfind(b" ") == 0 and c[-1] > 32 and (c[-1] < 128 or not c.decode()[-1].isspace()) for c in new]
        together = list(compress(new, plain))
        known: list[bytes] = []
        if together:
            ids = np.frombuffer(self._encode([b"".join(together).decode()])[0], dtype="<u4")
            at = np.flatnonzero(self.starts_chunk[ids])
            if len(at) == len(together):
                data = ids.tobytes()
                edges = [*(at * 4).tolist(), len(data)]
                known = [data[a:b] for a, b in zip(edges, edges[1:])]
        if not known:
            return self._encode([c.decode() for c in new])
        alone = self._encode([c.decode() for c, p in zip(new, plain) if not p])
        if not alone:
            return known
        known, alone = iter(known), iter(alone)
        return [next(known if p else alone) for p in plain]

    def _ids_of(self, keys: list[bytes]) -> list[bytes]:
        """Ids of different chunks, from memory or the library."""
        young, old = self.young, self.old
        values = list(map(young.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            new = []
            for i in missing:
                known = old.get(keys[i])
                if known is None:
                    new.append(i)
                else:
                    values[i] = young[keys[i]] = known
            for k in range(0, len(new), 2000):
                part = new[k:k + 2000]
                for i, v in zip(part, self._learn([keys[i] for i in part])):
                    values[i] = young[keys[i]] = v
            for i in new:
                if len(keys[i]) > LONGEST:
                    del young[keys[i]]
            if len(young) > CHUNKS:
                self.old, self.young = young, {}
        return values

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Equal chunks are found by hash in arrays, so Python handles each different chunk once."""
        raw = [t.encode() for t in texts]
        joined = b"".join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        edges = np.cumsum([0, *map(len, raw)])
        # A chunk starts at each text and at each space in it, or, in texts with runs of white space, where it may.
        cuts = data == 32
        for i, t in enumerate(texts):
            if odd(t):
                cuts[edges[i]:edges[i + 1]] = False
                cuts[edges[i] + np.cumsum([0, *(len(c.encode()) for c in chunks(t)[:-1])])] = True
        # A mark between a letter and a space is a match of its own.
        if len(data) > 2:
            cuts[1:-1] |= _MARK[data[1:-1]] & _LETTER[data[:-2]] & (data[2:] == 32)
        filled = np.flatnonzero(np.diff(edges))
        cuts[edges[filled]] = True
        start = np.flatnonzero(cuts)
        if not len(start):
            return [b""] * len(texts)
        size = np.diff(np.append(start, len(data)))
        key = Hashes(data).of(start, size) + size.astype(np.uint64) * np.uint64(BASES[0])
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        # Equal hashes must come from equal lengths and sums of bytes; else the second hash tells chunks apart.
        plain = np.add.reduceat(data, start, dtype=np.uint64) << np.uint64(32) | size.astype(np.uint64)
        if (plain != plain[first][same]).any():
            other = Hashes(data, 1).of(start, size)
            _, first, same = np.unique(np.stack([key, other]), axis=1, return_index=True, return_inverse=True)
            same = same.ravel()
        begin, end = start[first].tolist(), (start + size)[first].tolist()
        values = self._ids_of([joined[a:b] for a, b in zip(begin, end)])
        table = np.frombuffer(b"".join(values), dtype="<u4")
        length = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) >> 2
        offset = np.cumsum(length) - length
        number = length[same]
        ends = np.cumsum(number)
        ids = table[np.repeat(offset[same] - (ends - number), number) + np.arange(ends[-1])].tobytes()
        # Ids before each text: those of the chunks that start before it.
        at = np.concatenate([[0], ends])[np.searchsorted(start, edges)] * 4
        return [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def write_packed(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encode ``docs`` (doc_id, text) and write its shards to ``path``, in ascending doc_id order."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    last = np.array([end], dtype="<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(__name__, encoder.cache_clear)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, data, held = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), dtype="<u4")
            row = write_shard(doc_ids, [len(d) // 4 for d in data], ids, encoder(tokenizer).size)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, number, len(doc_ids), len(ids), row), _SHARDS)], schema=_SHARDS)

        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for k in range(0, len(names), 256):
                pieces = [list(stretches(t or "")) for t in texts[k:k + 256]]
                flat = iter(encoder(tokenizer).encode([p for x in pieces for p in x]))
                for name, own in zip(names[k:k + 256], pieces):
                    ids = b"".join([next(flat) for _ in own]) + last
                    doc_ids.append(name)
                    data.append(ids)
                    held += len(ids) // 4
                    if held >= SHARD_IDS:
                        yield flush()
                        number, doc_ids, data, held = number + 1, [], [], 0
        if doc_ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, "part int, shard int, n_docs long, n_ids long, data binary").write.option("compression", "none").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a packed dataset: doc_id, start (ids before it), n_tokens and the crc32 of its ids.

    Only the counts of parts and shards are summed up in order; the data is read where it lies.
    """
    shards = spark.read.parquet(path)

    def documents(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32")}
        for part, number, data in zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), batch["data"]):
            shard = Shard(data.as_py())
            ids, starts = shard.ids().astype("<u4"), shard.starts.astype(np.int64).tolist()
            for doc_id, a, b in zip(shard.doc_ids, starts, starts[1:]):
                for k, v in zip(out, (part, number, doc_id, a, b - a, zlib.crc32(ids[a:b].data))):
                    out[k].append(v)
        return out

    counts = shards.select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    starts = counts.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("offset")).join(parts, "part")
    found = map_batches(shards.select("part", "shard", "data"), documents, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


@query("op4_packed_ids")
def op4_packed_ids(spark, sf_dir):
    path = shared_path(spark, "packed")
    write_packed(table(spark, sf_dir, "documents"), path)
    return read_packed(spark, path)
