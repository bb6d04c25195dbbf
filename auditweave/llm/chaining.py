"""Fuzzy repeated passages by collinear chaining of shared seeds.

1. Each text gives the hash and place of some of its K-word runs: of every WINDOW consecutive runs the one with the least
   hash (words in lower case A-Z). A hash that comes again within one block of WORDS words counts once there: two copies of
   a passage lie further apart, and periodic text needs no more.
2. Every hash has an owner, the smallest doc_id that has it, with its first place there. All other documents that have the
   hash match all their places with the owner's, so every copy of a passage gives one match per seed, never pairs of all.
3. The matches of one document with one owner are chained: each scores its words, a step costs the words it passes over
   in both texts, and the best predecessor (before it in both) comes from a Fenwick tree of prefix maxima over the
   owner's places. Chains are cut where a step is longer than GAP words.
4. Chains, also those of one match, are aligned on the words of both texts: exact runs are counted, the words between
   seeds are aligned by longest common subsequence, ends are extended while they match, and the stretches of at least
   PERCENT per cent equal words (of the longer side) are kept.
5. Stretches that touch or lie at most JOIN words apart form a passage; passages of at least WORDS words are reported.
   Their source is that of the longest stretch; stretches of short chains name it only where there is no other.

Defined results: null texts are empty; a null doc_id is the smallest; rows with one doc_id and different texts, or without
one, are told apart by a 64-bit hash of the text (``suffixes.rows_of``), do not match each other, and either may be the source of a later passage; repeated rows
both keep or lose a passage; texts of fewer than K words have no seeds; an empty table gives no rows. Only doc_id and
text are read; the other columns of documents are carried through.
"""

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import cut, query, table, worker_memory
from auditweave.llm.hashing import BASES, mix, word_hashes
from auditweave.llm.suffixes import NULL_ID, repeated_ids, rows_of

K, WINDOW = 5, 10
#: Longest step of a chain, least words of a stretch and of a passage, distance of joined stretches, in words.
GAP, STRETCH, WORDS, JOIN = 30, 15, 40, 4
PERCENT = 80
#: What a match scores, in words that a step may pass over.
SCORE = 8 * K
#: Bytes and words beside a chain that its ends may grow into, whichever is more; most cells of one alignment, bytes of
#: text handled at a time.
MARGIN, REACH, CELLS, BLOCK = 600, 100, 40_000, 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def seeds(texts: list[bytes], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and byte offset of the chosen k-word runs of all texts, in order; of equal runs of a text the first."""
    h, own, offset, _, first = places(texts, k, window)
    return h[first], own[first], offset[first]


def places(texts: list[bytes], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Hash, text number, byte offset and word number of the chosen k-word runs, in order; whether the run is the text's first such."""
    none = np.zeros(0, dtype=np.int64)
    words, own, offset = word_hashes(texts)
    n = len(words) - k + 1
    if n < 1:
        return none, none, none, none, none.astype(bool)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = total * np.uint64(BASES[0]) + words[i:n + i]
    runs = mix(total)
    inside = own[:n] == own[k - 1:]  # runs of one text
    bits = np.uint64(max(1, n.bit_length()))
    key = np.where(inside, runs >> bits << bits | np.arange(n, dtype=np.uint64), np.iinfo(np.uint64).max)
    # Least of each window, from windows of 1, 2, 4, ... runs.
    chosen = []
    if n >= window:
        least, width = key, 1
        while 2 * width <= window:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:n - window + 1], least[window - width:window - width + n - window + 1])
        whole = own[:n - window + 1] == own[window + k - 2:window + k - 2 + n - window + 1]
        chosen.append(least[whole])
    # Texts of fewer runs than a window have one window.
    first = np.flatnonzero(inside & np.concatenate([[True], own[1:n] != own[:n - 1]]))
    number = np.bincount(own[:n][inside], minlength=len(texts))[own[first]]
    for f, m in zip(first[number < window].tolist(), number[number < window].tolist()):
        chosen.append(key[f:f + m].min(keepdims=True))
    at = np.unique(np.concatenate(chosen)).astype(np.uint64) & np.uint64((1 << int(bits)) - 1) if chosen else none
    at = np.unique(at.astype(np.int64))
    at = at[np.lexsort((at, runs[at], own[at]))]
    block = (at - np.searchsorted(own, own[at])) // WORDS
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (runs[at][1:] == runs[at][:-1]) & (own[at][1:] == own[at][:-1])
    near = again & np.concatenate([[False], block[1:] == block[:-1]])
    at, first = at[~near], ~again[~near]
    order = np.argsort(at)
    at, first = at[order], first[order]
    return runs[at].view(np.int64), own[at], offset[at], at - np.searchsorted(own, own[at]), first


def chains(x: np.ndarray, y: np.ndarray, score: int = SCORE, gap: int = GAP) -> list[list[int]]:
    """Disjoint chains over matches (place x of a text, place y of the other), as lists of match numbers.

    ``x`` and ``y`` must be sorted by (x, y), in words. A match scores ``score``, a step costs one per word it passes in
    either text.
    """
    n = len(x)
    places = {v: r for r, v in enumerate(np.unique(y).tolist(), 1)}
    xs, ys = x.tolist(), y.tolist()
    size = len(places)
    tree_value, tree_at = [-1] * (size + 1), [-1] * (size + 1)
    sums, before = [0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches of one place cannot follow each other
            rank = places[ys[j]] - 1
            best, at = -1, -1
            while rank:
                if tree_value[rank] > best:
                    best, at = tree_value[rank], tree_at[rank]
                rank &= rank - 1
            gain = best - xs[j] - ys[j]
            sums[j] = score + max(0, gain)
            if gain > 0:
                before[j] = at
            j += 1
        for m in range(i, j):
            value, rank = sums[m] + xs[m] + ys[m], places[ys[m]]
            while rank <= size:
                if tree_value[rank] < value:
                    tree_value[rank], tree_at[rank] = value, m
                rank += rank & -rank
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: -sums[m]):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            if chain and (xs[chain[-1]] - xs[end] > gap or ys[chain[-1]] - ys[end] > gap):
                out.append(chain[::-1])
                chain = []
            chain.append(end)
            end = before[end]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence; of very long parts, the words at both ends only."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    if not a or not b or len(a) * len(b) > CELLS:
        return n
    row = [0] * (len(b) + 1)
    for v in a:
        last = 0
        for j, w in enumerate(b):
            above = row[j + 1]
            row[j + 1] = last + 1 if v == w else max(above, row[j])
            last = above
    return n + row[-1]


#: Places where two texts may meet again behind a difference, nearest first.
_DETOURS = sorted(((i, j) for i in range(4) for j in range(4) if i or j), key=lambda d: (d[0] + d[1], max(d)))


def _grow(a: list, b: list) -> tuple[int, int, int]:
    """(words, words of the longer side, equal words) that continue both sides.

    Equal words give a point each; where they differ, two equal words at most three words on go on, for two points a
    word passed. The best end counts; 6 points below it the search stops.
    """
    best, out, score, i, j, equal, longer = 0, (0, 0, 0), 0, 0, 0, 0, 0
    while i < len(a) and j < len(b) and score >= best - 6:
        if a[i] == b[j]:
            i, j, equal, longer, score = i + 1, j + 1, equal + 1, longer + 1, score + 1
            if score > best:
                best, out = score, (i, longer, equal)
            continue
        for x, y in _DETOURS:
            if a[i + x:i + x + 2] == b[j + y:j + y + 2] and len(a[i + x:i + x + 2]) == 2:
                i, j, longer, score = i + x, j + y, longer + max(x, y), score - 2 * max(x, y)
                break
        else:
            break
    return out


def words_of(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """Words in lower case, their starts and ends."""
    words = text.lower().split()
    if words and sum(map(len, words)) + len(words) - 1 == len(text.strip()):  # one character between any two
        at = text.find(text.split(None, 1)[0])
        starts = list(accumulate((len(w) + 1 for w in words[:-1]), initial=at))
        return words, starts, [a + len(w) for a, w in zip(starts, words)]
    found = [m.span() for m in _WORD.finditer(text)]
    return words, [a for a, _ in found], [b for _, b in found]


def align(
    raw: bytes, other: bytes, xs: list[int], ys: list[int], percent: int = PERCENT, whole: tuple[bool, bool, bool, bool] = (True,) * 4,
) -> list[tuple[int, int, int, int]]:
    """(start, end, words, equal words) of the similar stretches along a chain; offsets are bytes of ``raw``.

    ``xs`` and ``ys`` are the byte offsets of the chain's seeds in the two texts. ``whole`` tells whether each text begins
    and ends as its document does; where it was cut, the word at the cut may be a part and is left out.
    """
    def split(text: bytes, begins: bool, ends: bool):
        found = words_of(text)
        since = int(not begins and bool(found[0]) and found[1][0] == 0)
        to = len(found[0]) - int(not ends and bool(found[0]) and found[2][-1] == len(text))
        return [v[since:to] for v in found]

    a, a_start, a_end = split(raw, *whole[:2])
    b, b_start, _ = split(other, *whole[2:])
    a_at, b_at = {s: i for i, s in enumerate(a_start)}, {s: i for i, s in enumerate(b_start)}
    seeds_ = [(a_at[x], b_at[y]) for x, y in zip(xs, ys) if x in a_at and y in b_at]
    if not seeds_:
        return []
    steps = []  # (first word, words, words of the longer side, equal words)
    (x0, y0), (x1, y1) = seeds_[0], seeds_[-1]
    taken, longer, equal = _grow(a[:x0][::-1], b[:y0][::-1])
    if taken:
        steps.append((x0 - taken, taken, longer, equal))
    for (x, y), (u, v) in zip(seeds_, seeds_[1:]):
        steps.append((x, u - x, max(u - x, v - y), common_words(a[x:u], b[y:v])))
    taken, longer, equal = _grow(a[x1:], b[y1:])
    steps.append((x1, taken, longer, equal))
    out = []

    def best_stretches(lo: int, hi: int) -> None:
        best, first, last, total, start = 0, 0, -1, 0, lo
        for i in range(lo, hi):
            if total <= 0:
                total, start = 0, i
            total += 100 * steps[i][3] - percent * steps[i][2]
            if total > best:
                best, first, last = total, start, i
        if last < 0:
            return
        begin, end = steps[first][0], steps[last][0] + steps[last][1]
        if end - begin >= STRETCH:
            out.append((a_start[begin], a_end[end - 1], end - begin, sum(s[3] for s in steps[first:last + 1])))
            pending.extend([(lo, first), (last + 1, hi)])

    pending = [(0, len(steps))]
    while pending:
        best_stretches(*pending.pop())
    return out


_SEEDS = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("place", pa.int32()), ("word", pa.int32()), ("first", pa.bool_())])
_CHAINS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("source", pa.int64()), ("source_mark", pa.int64()),
                     ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64())), ("room_x", pa.int64()), ("room_y", pa.int64())])
_ALIGNED = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                      ("source", pa.int64()), ("words", pa.int64()), ("equal", pa.int64()), ("chained", pa.bool_())])


def _emit_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        h, own, offset, word, first = places(texts)
        doc, mark = (np.array(v, dtype=np.int64)[own] for v in (docs, marks))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((h, doc, mark, offset, word, first), _SEEDS)], schema=_SEEDS)

    worker_memory(__name__)
    docs, marks, texts, size = [], [], [], 0
    for batch in batches:
        for doc, mark, text in zip(batch["doc"].to_pylist(), batch["mark"].to_pylist(), batch["data"]):
            docs.append(doc), marks.append(mark), texts.append(text.as_py())
            size += len(texts[-1])
            if size >= BLOCK:
                yield flush()
                docs, marks, texts, size = [], [], [], 0
    if texts:
        yield flush()


def room(offset: int, word: int) -> int:
    """Bytes beside a chain that ends at this offset and word number: those of REACH words as long as the text's so far."""
    return max(MARGIN, REACH * int(offset) // max(1, int(word)))


def _emit_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over matches sorted by document, owner and place; one document's matches with one owner at a time."""
    names = ("doc", "mark", "source", "source_mark", "place", "word", "source_place", "source_word")

    def of(group: list[np.ndarray]) -> list[tuple]:
        x, word, y, source_word = group[4:]
        pair, found = [int(v[0]) for v in group[:4]], []
        for chain in chains(word, source_word):
            end = chain[-1]
            found.append((*pair, x[chain].tolist(), y[chain].tolist(), room(x[end], word[end]), room(y[end], source_word[end])))
        return found

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), _CHAINS)], schema=_CHAINS)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            rows = [np.concatenate(v) for v in zip(held, rows)]
        change = np.zeros(len(rows[0]) - 1, dtype=bool)
        for v in rows[:4]:
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        found = []
        for a, b in zip(edges, edges[1:]):
            found += of([v[a:b] for v in rows])
        held = [v[edges[-1]:] for v in rows]
        if found:
            yield batch_of(found)
    if held is not None and (found := of(held)):
        yield batch_of(found)


def _emit_aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = [batch[c].to_pylist() for c in ("doc", "mark", "source", "xs", "ys", "from_x", "from_y", "room_x", "room_y", "piece", "source_piece")]
        for doc, mark, source, xs, ys, from_x, from_y, room_x, room_y, piece, other in zip(*columns):
            cut_short = lambda text, at, first, beside: len(text) >= at[-1] - first + 2 * beside
            whole = (from_x == 0, not cut_short(piece, xs, from_x, room_x), from_y == 0, not cut_short(other, ys, from_y, room_y))
            for start, end, words, equal in align(piece, other, [x - from_x for x in xs], [y - from_y for y in ys], whole=whole):
                out.append((doc, mark, start + from_x, end + from_x, source, words, equal, xs[-1] - xs[0] >= 3 * STRETCH))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _ALIGNED)], schema=_ALIGNED)


def stretches(rows: DataFrame) -> DataFrame:
    """(doc, mark, start, end, source, words, equal, chained): similar stretches with the owner of their seeds, of ``rows_of``."""
    found = rows.select("doc", "mark", F.col("text").cast("binary").alias("data")).mapInArrow(
        _emit_seeds, "h long, doc long, mark long, place int, word int, first boolean")
    # Numbers only, so the aggregation hashes instead of sorting; a text has a hash first once. Of the texts of one doc_id
    # any may own a hash, but all of its columns come from the same: the one with the least mark.
    by = F.struct("doc", "mark")
    owners = found.where("first").groupBy("h").agg(F.min(by).alias("o"), F.max("doc").alias("last"),
                                                     F.min_by("place", by).alias("source_place"), F.min_by("word", by).alias("source_word"))
    owners = owners.select("h", F.col("o.doc").alias("source"), F.col("o.mark").alias("source_mark"), "source_place", "source_word", "last")
    owners = owners.where("last > source").drop("last")
    pair = ["doc", "mark", "source", "source_mark"]
    matches = found.drop("first").join(owners, "h").where("doc <> source").select(*pair, "place", "word", "source_place", "source_word")
    by_pair = matches.repartition("doc", "mark").sortWithinPartitions(*pair, "place", "source_place")
    linked = cut(by_pair.mapInArrow(_emit_chains, "doc long, mark long, source long, source_mark long, xs array<long>, ys array<long>, room_x long, room_y long"), "chains")
    first, last = lambda c: F.element_at(c, 1), lambda c: F.element_at(c, -1)
    linked = linked.select("*", F.greatest(first("xs") - F.col("room_x"), F.lit(0)).alias("from_x"),
                           F.greatest(first("ys") - F.col("room_y"), F.lit(0)).alias("from_y"))
    # A text is shorter than 2^31 bytes, but a place with its room may lie behind that.
    piece = lambda at, to, beside: F.substring(F.col("text").cast("binary"), (F.col(at) + 1).cast("int"), F.least(last(to) - F.col(at) + 2 * F.col(beside), F.lit((1 << 31) - 1)).cast("int"))
    # Both joins and the caller's share one exchange of the texts.
    texts = lambda doc, mark: rows.select(F.col("doc").alias(doc), F.col("mark").alias(mark), "text")
    with_source = linked.join(texts("source", "source_mark"), ["source", "source_mark"]).select(
        *[c for c in linked.columns], piece("from_y", "ys", "room_y").alias("source_piece"))
    with_both = with_source.join(texts("doc", "mark"), ["doc", "mark"]).select(
        "doc", "mark", "source", "xs", "ys", "from_x", "from_y", "room_x", "room_y", piece("from_x", "xs", "room_x").alias("piece"), "source_piece")
    return with_both.mapInArrow(_emit_aligned, "doc long, mark long, start long, end long, source long, words long, equal long, chained boolean")


def joined(raw: bytes, own: list[dict], least: int = WORDS, apart: int = JOIN) -> list[dict]:
    """Passages of one document from its stretches: start, end, n_words, similarity and source of the longest stretch."""
    out: list[dict] = []
    for s in sorted(own, key=lambda s: (s["start"], -s["end"], s["source"])):
        if out and (s["start"] <= out[-1]["end"] or len(raw[out[-1]["end"]:s["start"]].split()) <= apart):
            out[-1]["end"] = max(out[-1]["end"], s["end"])
            out[-1]["parts"].append(s)
        else:
            out.append({"start": s["start"], "end": s["end"], "parts": [s]})
    found = []
    for p in out:
        n = len(raw[p["start"]:p["end"]].split())
        if n >= least:
            longest = max(p["parts"], key=lambda s: (s["chained"], s["words"], -s["source"]))
            found.append({"start": p["start"], "end": p["end"], "n_words": n, "source": longest["source"],
                          "similarity": sum(s["equal"] for s in p["parts"]) / sum(s["words"] for s in p["parts"])})
    return found


def _own_stretches(rows: DataFrame) -> DataFrame:
    return stretches(rows).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end", "source", "words", "equal", "chained")).alias("own"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_words, similarity, source_id), one row per repeated passage of a document.

    The passage also stands, alike or edited, in the earlier document ``source_id``.
    """
    rows = rows_of(docs, repeated_ids(docs))
    own = _own_stretches(rows)
    names = ("doc_id", "start_byte", "end_byte", "n_words", "similarity", "source_id")
    schema = pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own_ in zip(batch["doc_id"].to_pylist(), batch["data"], batch["own"].to_pylist()):
                for p in joined(text.as_py(), own_):
                    source = None if p["source"] == NULL_ID else p["source"]
                    out.append((doc, p["start"], p["end"], p["n_words"], p["similarity"], source))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    found = rows.join(own, ["doc", "mark"]).select("doc_id", F.col("text").cast("binary").alias("data"), "own")
    return found.mapInArrow(run, "doc_id long, start_byte long, end_byte long, n_words long, similarity double, source_id long")


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without their repeated passages; the first document of a passage keeps it. Columns as in the input.

    A text that loses a passage has a line break in its place; n_chars, if there is such a column, is counted anew.
    """
    repeated = repeated_ids(docs)
    own = _own_stretches(rows_of(docs, repeated))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    # A null text passes as such where it loses nothing.
    rows = rows_of(docs, repeated, row, F.col("text").isNull().alias("absent")).withColumn("text", F.when(~F.col("absent"), F.col("text")))
    matched = rows.join(own, ["doc", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own_ in zip(batch["text"].to_pylist(), batch["own"].to_pylist()):
                found = joined(text.encode(), own_) if own_ else []
                if found:
                    raw = text.encode()
                    edges = [0, *(e for p in found for e in (p["start"], p["end"])), len(raw)]
                    parts = [raw[a:b].decode().strip() for a, b in zip(edges[::2], edges[1::2])]
                    text = "\n".join(p for p in parts if p)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string())], names=["row", "text"])

    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["row"].dataType)
    done = matched.select("row", "text", "own").mapInArrow(run, f"row struct<{kinds}>, text string")
    count = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return done.select(*[F.col("text") if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@query("op2_repeated_passages")
def op2_repeated_passages(spark, sf_dir):
    return passages(table(spark, sf_dir, "documents"))
