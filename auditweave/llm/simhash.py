"""SimHash near-dedup with BK-trees.

A fingerprint bit is 1 where over half of the hashes of a text's k-word shingles (repeats included) have it. Texts with
fingerprints at most RADIUS bits apart are linked; classes are the connected components.

1. Equal fingerprints are one node, by partial aggregation, so groups of copies of any size cost one row.
2. Nodes are dealt to shards. If the open bits are cut into RADIUS + 1 blocks, two fingerprints within the radius agree in
   one block at least, so each node goes to one shard per block: those with the same bits there. A shard with more than
   LARGEST nodes is dealt again by the bits still open, and so on, until all are small; no pair is lost at any step.
3. Each shard has a BK-tree: a node's children are keyed by their Hamming distance to it. A new node first follows the
   edges within the radius of its own distance, which meets every earlier node within the radius, and is then hung in.
   As only components are asked for, a link is given only between nodes not yet connected within the shard: fewer links
   than nodes, however dense a shard is.
4. Components of the links are found by joins (``graph.py``).

Trees are not broadcast: together they grow with the corpus, so a tree and the nodes that search it meet by key instead,
at most LARGEST rows in one group. Only the table of masks is broadcast: with LARGEST = 2 ** 11, shards that leave 11 bits
open are small, which is so after six steps, so it has at most 4 ** 6 rows.

Defined results: null and empty texts and texts without words have the fingerprint zero and are linked like any other;
repeated rows are rows of their own; a null doc_id is linked like others but names no component unless no member has an
id (then null); an empty table gives no rows. Columns besides doc_id and text are not read, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm.base import cut, map_batches, query, table, worker_memory
from auditweave.llm.graph import components

SEED, RADIUS = 42, 3
#: Most nodes of one tree.
LARGEST = 2048
#: Shingles counted at a time.
STRETCH = 1 << 16
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, k: int = 3) -> int:
    """SimHash of the k-word shingles of ``text``, repeats included; of fewer words, of the whole sequence."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, STRETCH):
        m = min(STRETCH, n - i)
        pairs = zip(starts[i:i + m].tolist(), ends[i + k - 1:i + k - 1 + m].tolist())
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits in a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t or "", k) for t in batch["text"].to_pylist()], dtype=np.uint64)
        return {"doc_id": batch["doc_id"], "fingerprint": found.view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fingerprint long")


class BKTree:
    """Distinct numbers by Hamming distance: children of a node are keyed by their distance to it."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, value: int) -> None:
        if not self.nodes:
            self.nodes.append((value, {}))
            return
        at = 0
        while True:
            other, children = self.nodes[at]
            d = (value ^ other).bit_count()
            if d not in children:
                children[d] = len(self.nodes)
                self.nodes.append((value, {}))
                return
            at = children[d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes at most ``radius`` from ``value``."""
        open_ = [0] if self.nodes else []
        while open_:
            at = open_.pop()
            other, children = self.nodes[at]
            d = (value ^ other).bit_count()
            if d <= radius:
                yield at
            for edge in range(d - radius, d + radius + 1):
                if edge in children:
                    open_.append(children[edge])


def links_of(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect ``values`` (distinct) as all such links do, fewer than there are values."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, out = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                out.append((value, values[j]))
        tree.add(value)
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def blocks(mask: int, number: int) -> list[int]:
    """``mask`` with one more block of bits set, for each of ``number`` blocks of the bits it leaves open."""
    open_ = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(open_) * i // number for i in range(number + 1)]
    return [mask | sum(1 << b for b in open_[a:z]) for a, z in zip(cuts, cuts[1:]) if z > a]


def _dealt(spark: SparkSession, nodes: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """One row (mask, bits, value) for each shard of a node: of (mask, value), ``mask`` being one of ``masks``."""
    finer = [(_signed(m), _signed(f)) for m in masks for f in blocks(m, radius + 1)]
    if len(masks) == 1:
        rows = nodes.select(F.explode(F.array(*[F.lit(f).cast("long") for _, f in finer])).alias("finer"), "value")
    else:
        rows = nodes.join(F.broadcast(spark.createDataFrame(finer, "mask long, finer long")), "mask")
    rows = rows.select(F.col("finer").alias("mask"), F.col("value").bitwiseAND(F.col("finer")).alias("bits"), "value")
    return rows, sorted({f % (1 << 64) for _, f in finer})


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(__name__)
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            return [] if len(held) < 2 else links_of(held, radius)

        for batch in batches:
            found = []
            for mask, bits, value in zip(*(batch[c].to_pylist() for c in ("mask", "bits", "value"))):
                if (mask, bits) != key:
                    found += links()
                    key, held = (mask, bits), []
                held.append(value % (1 << 64))
            yield _pairs(found)
        yield _pairs(links())

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def link_nodes(values: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) that connect the distinct ``values`` (value) as all pairs within the radius do."""
    spark, masks = values.sparkSession, [0]
    waiting, found = values.select(F.lit(0).cast("long").alias("mask"), "value"), None
    while True:
        rows, masks = _dealt(spark, waiting, masks, radius)
        sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shards = cut(rows.join(sizes, ["mask", "bits"]), "shards")
        # Once all bits are set, a shard is one node, so the dealing ends.
        small = shards.where(F.col("n") <= largest).repartition("mask", "bits").sortWithinPartitions("mask", "bits", "value")
        links = cut(small.select("mask", "bits", "value").mapInArrow(_search(radius), "a long, b long"), "links")
        found = links if found is None else found.unionByName(links)
        waiting = shards.where(F.col("n") > largest).select("mask", "value")
        if waiting.isEmpty():
            return found.distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    signed = cut(fingerprints(docs, k), "fingerprints")
    nodes = cut(signed.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least")), "nodes")
    links = cut(link_nodes(nodes, radius, largest), "links")
    named = nodes.select("value", F.col("least").alias("component_id"))
    if not links.isEmpty():
        roots = components(links)
        rooted = nodes.join(roots.withColumnRenamed("id", "value"), "value", "left").withColumn("root", F.coalesce("root", "value"))
        rooted = cut(rooted, "rooted")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.select("value", "root").join(least, "root").select("value", "component_id")
    rows = signed.join(named.withColumnRenamed("value", "fingerprint"), "fingerprint")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op12_simhash_bk_trees")
def op12_simhash_bk_trees(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
