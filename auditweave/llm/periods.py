"""Periodic run detection by descending-LCP Kruskal.

A run is a maximal stretch of words with smallest period q, at least max(LEAST, 2 * q) words long. Per text:

1. Suffixes (of words) are sorted by prefix doubling; the ranks of all levels give the longest common prefix of
   neighbours.
2. Neighbours are united by decreasing common prefix, as Kruskal takes edges: a class is an ordered set of positions, and
   the smaller of two classes is inserted into the larger. Two positions that become neighbours in their class have
   exactly the current value l as their common prefix.
3. If their distance d is at most l, the words between them have period d; no smaller period fits, as a position of the
   class would then lie between the two. A pair that cannot be moved one word to the left seeds the run (start, l + d, d).

Every run is found once, at its start: that position and the one a period later share length - q >= q words. As
d <= l and l + d >= LEAST, only classes with at least (LEAST + 1) // 2 common words matter: texts that repeat no stretch
of so many words (by hash; equal stretches have equal hashes) have no runs and are not sorted.

One text is handled in one task, in memory proportional to its words times the logarithm of its longest repeat. Nothing is
shuffled.

Defined results: null and empty texts have no words and no runs; equal rows are handled alike, each for itself; a null
doc_id is carried (and its text never rewritten by ``with_planted_runs``); an empty table gives no rows. Columns besides
doc_id and text are not read, whatever their names.
"""

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import SPACE, map_batches, query, table, text_or_empty
from auditweave.llm.hashing import BASES, mix, word_hashes

#: Fewest words of a run.
LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def _levels(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ; shorter ones come first."""
    ranks, width = [words], 1
    while int(ranks[-1].max()) + 1 < len(words):
        last = ranks[-1].astype(np.int64)
        behind = np.zeros(len(words), dtype=np.int64)
        behind[:-width] = last[width:] + 1
        _, new = np.unique(last * (len(words) + 1) + behind, return_inverse=True)
        ranks.append(new.astype(np.int32))
        width *= 2
    return ranks


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the next; ``words`` are numbers from 0 without gaps."""
    ranks, n = _levels(words), len(words)
    order = np.argsort(ranks[-1], kind="stable")
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        open_ = np.flatnonzero(np.maximum(x, y) + width <= n)
        same = open_[ranks[level][x[open_]] == ranks[level][y[open_]]]
        common[same] += width
        x[same] += width
        y[same] += width
    return order, common


def _unite(large: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Both ordered sets in one, and its neighbours that come from different sets."""
    pairs, before = [], -1
    for k, p in enumerate(small):
        at = bisect_left(large, p)
        if at and large[at - 1] > before:
            pairs.append((large[at - 1], p))
        if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
            pairs.append((p, large[at]))
        before = p
    if len(small) * 16 > len(large):
        large = sorted(large + small)
    else:
        for p in small:
            insort(large, p)
    return large, pairs


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``words`` are numbers from 0 without gaps."""
    if len(words) < 2:
        return []
    order, common = sorted_suffixes(words)
    edges = np.flatnonzero(common >= max(1, (least + 1) // 2))
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent, classes, found = {}, {}, []

    def find(i: int) -> int:
        root = i
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(i, i)) != root:
            parent[i], i = root, up
        return root

    starts, value = order.tolist(), words.tolist()
    for e, l in zip(edges.tolist(), common[edges].tolist()):
        a, b = find(e), find(e + 1)
        large, small = classes.pop(a, None) or [starts[a]], classes.pop(b, None) or [starts[b]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        classes[a], pairs = _unite(large, small)
        for i, j in pairs:
            d = j - i
            if d <= l and l + d >= least and (i == 0 or value[i - 1] != value[j - 1]):
                found.append((i, l + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def may_repeat(words: np.ndarray, own: np.ndarray, texts: int, width: int) -> np.ndarray:
    """Which texts hold some stretch of ``width`` words twice, by hashes of all texts' words."""
    n = len(words) - width + 1
    out = np.zeros(texts, dtype=bool)
    if n < 2:
        return out
    inside = np.flatnonzero(own[:n] == own[width - 1:])
    total = own[inside].astype(np.uint64)
    for k in range(width):
        total = total * np.uint64(BASES[0]) + words[inside + k]
    # The number of the text is part of the hash, so only stretches of one text meet.
    total = mix(total)
    by_hash = np.argsort(total, kind="stable")
    again = by_hash[1:][total[by_hash][1:] == total[by_hash][:-1]]
    out[own[inside[again]]] = True
    return out


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int32)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [(t or "").encode() for t in batch["text"].to_pylist()]
        hashes, own, _ = word_hashes(texts)
        maybe = may_repeat(hashes, own, len(texts), max(1, (least + 1) // 2))
        out = {c: [] for c in ("n_words", "runs", "collapsed")}
        for text, twice in zip(texts, maybe.tolist()):
            words = text.split()
            runs = runs_of(_numbered(words), least) if twice else []
            out["n_words"].append(len(words))
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
            out["collapsed"].append(collapsed(words, runs).decode())
        return {"doc_id": batch["doc_id"]} | out

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten (by the crc32 of its id) is periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(text_or_empty(), f"[{SPACE}]+"), lambda w: w != "")
    hit = docs.select("doc_id", text_or_empty().alias("text"), F.floor(h / 10).alias("g"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("hit"))
    # Only the rows to be rewritten are split into words.
    split = hit.withColumn("w", F.when(F.col("hit"), words)).withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    sized = split.withColumn("a", F.col("g") % F.col("n"))
    sized = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rewritten = F.array_join(F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, rewritten).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    # The greatest of these structs is the longest run with the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    ranked = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return ranked.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
