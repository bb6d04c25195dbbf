"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier.

Equal strings of LENGTH bytes must meet without every position being shuffled. Each of them names the GRAM bytes in it
with the least hash (the leftmost of equals); consecutive strings that name the same place form a class, one for about
40 bytes of text. Equal strings name the same gram at the same place, so only classes with one gram need to be compared:

1. Map tasks emit one row per class: hash of the gram, hash of the class's bytes, place. Classes that repeat within a
   task are settled there, so a passage shared by very many documents sends one row per task.
2. Rows meet by gram, sorted, in a pass that holds one gram at a time. Classes equal in all bytes are settled; where
   different classes share a gram, one class of each kind remains, and its bytes are fetched from its document.
3. The strings of these classes are sorted as suffixes: first by eight bytes, then by merge sort, all ties at once. Two
   suffixes are compared by their common extension, found by binary search over prefix polynomial hashes, and by the
   byte behind it. Neighbours are verified byte by byte; a group that a collision of hashes put out of order is sorted
   by its bytes instead. The first of equals, by document and start, stays; the others are removed.
4. A gram with very many different classes (a common line that differs in what follows) is not brought to one task:
   its strings are dealt by 128 bits of hash instead, each task sending one of those it holds twice.

The rows of one gram that step 2 holds are bounded by LIMIT; what exceeds it goes the way of step 4. Both ways are exact
at any size.

Defined results: null texts are empty; a null doc_id is smaller than all others; rows with one doc_id and one text are
the same document (neither is earlier); rows with one doc_id and different texts are ordered by a 64-bit hash of the text
(``mark``), which also tells rows without a doc_id apart. Matches never cross documents. Other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import cut, query, table, text_or_empty
from auditweave.llm.hashing import BASES, Hashes, mix

LENGTH, GRAM = 100, 24
#: Bytes hashed at a time, bytes a map task settles at a time, bytes sorted at a time.
STRETCH, BLOCK, SORTED = 1 << 19, 1 << 24, 1 << 21
#: Different classes of one gram in one block from which it counts as common, and most classes of a gram sorted together.
COMMON, LIMIT = 256, 20_000
#: Stands for a null doc_id; a real one of this value differs from it by its mark.
NULL_ID = -(1 << 63)
REMOVED, MARK, CLASS, DEALT = 0, 1, 2, 3


def common_extension(hashes: Hashes, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix, at most ``limit``, of the suffixes at x and y, by binary search over hashes."""
    found = np.zeros(len(x), dtype=np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        able = np.flatnonzero(found + step <= limit)
        a, b = x[able] + found[able], y[able] + found[able]
        able = able[hashes.of(a, step) == hashes.of(b, step)]
        found[able] += step
        step >>= 1
    return found


def sort_suffixes(data: np.ndarray, starts: np.ndarray, limit: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``limit`` (at least 8) bytes, and which equal the one before.

    Equal ones keep the order of ``starts``. ``bits`` weakens the hashes, for tests of collisions.
    """
    n = len(starts)
    if n < 2:
        return np.arange(n), np.zeros(n, dtype=bool)
    head = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | data[starts + k].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = head[order][1:] != head[order][:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    tied = np.flatnonzero(np.repeat(size, size) > 1)
    same = np.zeros(n, dtype=bool)
    if not len(tied):
        return order, same
    # From here on only ties: positions 0.. in ``tied``, groups with their first position and end.
    hashes = Hashes(data, bits=bits)
    size = size[size > 1]
    end = np.repeat(np.cumsum(size), size)
    begin = end - np.repeat(size, size)
    item = order[tied]

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = starts[a], starts[b]
        l = common_extension(hashes, x, y, limit)
        inside = np.minimum(l, limit - 1)
        return np.where(l < limit, data[x + inside] < data[y + inside], a < b)

    width = 1
    while width < size.max():
        live = np.flatnonzero(end - begin > width)
        b, e = begin[live], end[live]
        run = (live - b) // width
        own = b + run * width
        other = np.where(run % 2 == 0, np.minimum(own + width, e), own - width)
        stop = np.where(run % 2 == 0, np.minimum(own + 2 * width, e), own)
        low, high = other.copy(), stop.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            smaller = less(item[mid], item[live[open_]])
            low[open_[smaller]] = mid[smaller] + 1
            high[open_[~smaller]] = mid[~smaller]
        merged = item.copy()
        merged[np.minimum(own, other) + (live - own) + (low - other)] = item[live]
        item = merged
        width *= 2
    # Verification by bytes: neighbours must be in order. Where a collision of hashes misplaced one, bytes sort the group.
    pairs = np.flatnonzero(begin[1:] == begin[:-1])
    is_same = np.zeros(len(item), dtype=bool)
    # A collision may also have sent two items to one place.
    before = order[tied]
    a, b = np.lexsort((item, begin)), np.lexsort((before, begin))
    wrong, reach = [begin[a[item[a] != before[b]]]], np.arange(limit)
    for k in range(0, len(pairs), 1 << 15):
        part = pairs[k:k + (1 << 15)]
        x, y = (data[starts[item[p]][:, None] + reach] for p in (part, part + 1))
        differ = x != y
        at = differ.argmax(axis=1)
        some = differ[np.arange(len(part)), at]
        i = np.arange(len(part))
        is_same[part + 1] = ~some
        wrong.append(begin[part[np.where(some, x[i, at] > y[i, at], item[part] > item[part + 1])]])
    for b in np.unique(np.concatenate(wrong)).tolist():
        e = end[b]
        content = {i: data[starts[i]:starts[i] + limit].tobytes() for i in before[b:e].tolist()}
        item[b:e] = sorted(content, key=lambda i: (content[i], i))
        is_same[b + 1:e] = [content[p] == content[q] for p, q in zip(item[b:e].tolist(), item[b + 1:e].tolist())]
    order[tied] = item
    same[tied] = is_same
    return order, same


def _classes(data: np.ndarray, edges: np.ndarray, length: int, gram: int):
    """Classes of the strings inside the segments of ``data`` between ``edges``: first start, number, and two hashes."""
    n, w = len(data), length - gram + 1
    hashes = Hashes(data)
    grams = mix(hashes.of(np.arange(n - gram + 1), gram))
    place_bits = np.uint64(21)
    key = grams >> place_bits << place_bits | np.arange(len(grams), dtype=np.uint64)
    rows = np.concatenate([key, np.full(-len(key) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - length + 1
    least = np.minimum(behind[:strings], ahead[w - 1:w - 1 + strings])
    place = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    inside = np.zeros(strings, dtype=bool)
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        inside[a:max(a, b - length + 1)] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return (at,) * 4
    cut_here = np.flatnonzero((np.diff(place[at]) != 0) | (np.diff(at) != 1)) + 1
    first = at[np.concatenate([[0], cut_here])]
    number = np.diff(np.concatenate([[0], cut_here, [len(at)]]))
    whole = mix(hashes.of(first, number + length - 1) + number.astype(np.uint64) * np.uint64(BASES[1]))
    return first, number, grams[place[first]].view(np.int64), whole.view(np.int64)


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about STRETCH bytes; a long text comes in overlapping parts."""
    held, size = [], 0
    for d, text in enumerate(texts):
        for p in range(0, len(text) - length + 1, STRETCH):
            part = text[p:p + STRETCH + length - 1]
            held.append((d, p, part))
            size += len(part)
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _spans(doc: np.ndarray, mark: np.ndarray, place: np.ndarray, number: np.ndarray):
    """Consecutive strings of a document joined into one row."""
    order = np.lexsort((place, mark, doc))
    doc, mark, place, number = doc[order], mark[order], place[order], number[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (place[1:] != place[:-1] + number[:-1])
    at = np.flatnonzero(new)
    return doc[at], mark[at], place[at], np.add.reduceat(number, at) if len(at) else number


_ROWS = pa.schema([("key", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("number", pa.int32()), ("kind", pa.int8())])
_ROWS_DDL = "key long, whole long, doc long, mark long, place long, number int, kind byte"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v), f.type) for v, f in zip(columns, _ROWS)], schema=_ROWS)


def _scatter(doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((doc ^ mark).view(np.uint64) * np.uint64(BASES[0]) + place.view(np.uint64)).view(np.int64)


def _settle(groups: list[np.ndarray], doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by groups, document and place; which rows are the first of their group; which repeat an earlier place."""
    order = np.lexsort((place, mark, doc, *groups[::-1]))
    first = np.ones(len(order), dtype=bool)
    if len(order):
        same = np.ones(len(order) - 1, dtype=bool)
        for g in groups:
            same &= g[order][1:] == g[order][:-1]
        first[1:] = ~same
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
    d, m, p = doc[order], mark[order], place[order]
    return order, first, (d != d[lead]) | (m != m[lead]) | (p != p[lead])


def _emit_classes(docs: list[tuple[int, int, bytes]], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Step 1 for one block of documents (doc, mark, text)."""
    columns = [[] for _ in range(6)]
    for segment in _segments([t for _, _, t in docs], length):
        data = np.frombuffer(b"".join(s for _, _, s in segment), dtype=np.uint8)
        edges = np.cumsum([0, *(len(s) for _, _, s in segment)])
        first, number, grams, whole = _classes(data, edges, length, gram)
        if not len(first):
            continue
        own = np.searchsorted(edges, first, side="right") - 1
        base = np.array([p for _, p, _ in segment], dtype=np.int64) - edges[:-1]
        ids, marks = (np.array([docs[d][i] for d, _, _ in segment], dtype=np.int64) for i in (0, 1))
        for c, v in zip(columns, (grams, whole, ids[own], marks[own], base[own] + first, number)):
            c.append(v)
    if not columns[0]:
        return
    key, whole, doc, mark, place, number = (np.concatenate(c) for c in columns)
    order, first, repeats = _settle([key, whole], doc, mark, place)
    gone = order[repeats]
    d, k, p, m = _spans(doc[gone], mark[gone], place[gone], number[gone])
    yield _batch(_scatter(d, k, p), np.zeros_like(d), d, k, p, m, np.full(len(d), REMOVED))
    kept = order[first]
    key, whole, doc, mark, place, number = (v[kept] for v in (key, whole, doc, mark, place, number))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    kinds = np.diff(np.append(at, len(key)))
    common = np.repeat(kinds >= COMMON, kinds)
    yield _batch(np.where(common, _scatter(doc, mark, place), key), whole, doc, mark, place, number, np.where(common, DEALT, CLASS))
    marked = key[at[kinds >= COMMON]]
    zero = np.zeros_like(marked)
    yield _batch(marked, *[zero] * 5, np.full(len(marked), MARK))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 over rows sorted by key and kind."""
    held: list[np.ndarray] | None = None
    over = None  # the key in hand, once it has too many classes to be held

    def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        marked = np.unique(rows[0][rows[-1] == MARK])
        *rows, _ = (v[rows[-1] != MARK] for v in rows)
        key, whole, doc, mark, place, _ = rows
        order, first, repeats = _settle([key, whole], doc, mark, place)
        gone = order[repeats]
        yield _batch(*(v[gone] for v in rows), np.full(len(gone), REMOVED))
        kept = order[first]
        _, group, kinds = np.unique(key[kept], return_inverse=True, return_counts=True)
        common = np.isin(key[kept], marked)
        need = common | (kinds[group] > 1)
        kept, common = kept[need], common[need]
        yield _batch(*(v[kept] for v in rows), np.where(common, DEALT, CLASS))

    for batch in batches:
        rows = [batch[c].to_numpy(zero_copy_only=False) for c in _ROWS.names]
        straight = (rows[-1] == REMOVED) | (rows[-1] == DEALT)
        if over is not None:
            straight |= rows[0] == over
        if straight.any():
            out = [v[straight] for v in rows]
            yield _batch(*out[:-1], np.where(out[-1] == REMOVED, REMOVED, DEALT))
            rows = [v[~straight] for v in rows]
        if not len(rows[0]):
            continue
        over = None
        if held is not None:
            rows = [np.concatenate(v) for v in zip(held, rows)]
        last = np.searchsorted(rows[0], rows[0][-1])
        if last:
            yield from settle([v[:last] for v in rows])
        held = [v[last:] for v in rows]
        if len(held[0]) > LIMIT:
            out = [v[held[-1] != MARK] for v in held]
            yield _batch(*out[:-1], np.full(len(out[0]), DEALT))
            over, held = int(held[0][-1]), None
    if held is not None:
        yield from settle(held)


_SPANS = "doc long, mark long, place long, number int"
_SPAN_SCHEMA = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("number", pa.int32())])


def _span_batch(doc, mark, place, number) -> pa.RecordBatch:
    found = _spans(doc, mark, place, number)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, _SPAN_SCHEMA)], schema=_SPAN_SCHEMA)


def _strings(pieces: list[bytes], doc: np.ndarray, mark: np.ndarray, place: np.ndarray, length: int):
    """Buffer of the pieces, start of each string in it, its document, mark and place."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    number = sizes - length + 1
    own = np.repeat(np.arange(len(pieces)), number)
    inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return data, (np.cumsum(sizes) - sizes)[own] + inside, doc[own], mark[own], place[own] + inside


def _sort_classes(length: int):
    """Step 3 over pieces sorted by key."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        docs, marks, places, pieces = zip(*held)
        data, starts, doc, mark, place = _strings(list(pieces), *(np.array(v, dtype=np.int64) for v in (docs, marks, places)), length)
        by_place = np.lexsort((place, mark, doc))
        starts, doc, mark, place = starts[by_place], doc[by_place], mark[by_place], place[by_place]
        order, same = sort_suffixes(data, starts, length)
        lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        d, m, p = doc[order], mark[order], place[order]
        later = (d != d[lead]) | (m != m[lead]) | (p != p[lead])
        return _span_batch(d[later], m[later], p[later], np.ones(int(later.sum()), dtype=np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            for key, *row in zip(*(batch[c].to_pylist() for c in ("key", "doc", "mark", "place", "piece"))):
                if size >= SORTED and key != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                last, size = key, size + len(row[-1])
        if held:
            yield settle(held)

    return run


_DEALT_SCHEMA = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("gone", pa.bool_())])


def _deal(length: int):
    """Step 4, first half: one row per different string of a batch, and the strings that repeat within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "mark", "place"))
            data, starts, doc, mark, place = _strings(batch["piece"].to_pylist(), *places, length)
            x, y = (mix(Hashes(data, which).of(starts, length)).view(np.int64) for which in (0, 1))
            order, first, repeats = _settle([x, y], doc, mark, place)
            take = order[first | repeats]
            gone = repeats[first | repeats]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[take], y[take], doc[take], mark[take], place[take], gone)], schema=_DEALT_SCHEMA)

    return run


def _first_of_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4, second half, over rows sorted by hash, document and place: all but the first of equals are removed."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, doc, mark, place, gone = (batch[c].to_numpy(zero_copy_only=False) for c in _DEALT_SCHEMA.names)
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        if last is not None and (x[0], y[0]) == last[:2]:
            new[0] = False
        lead = np.cumsum(new) - 1  # -1: the first lies in a batch before
        heads = np.flatnonzero(new)
        leads = [np.where(lead < 0, last[2 + i] if last else 0, v[heads[np.maximum(lead, 0)]] if len(heads) else 0) for i, v in enumerate((doc, mark, place))]
        later = (doc != leads[0]) | (mark != leads[1]) | (place != leads[2])
        last = (x[-1], y[-1], *(v[-1] for v in leads))
        yield _span_batch(doc[later], mark[later], place[later], np.ones(int(later.sum()), dtype=np.int32))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, again) of the doc_ids of several rows. Mostly few or none; written, so Spark knows how many there are."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    return cut(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")


def rows_of(docs: DataFrame, repeated: DataFrame, *more: Column) -> DataFrame:
    """doc_id, doc, mark and text, and ``more`` columns of ``docs``.

    (doc, mark) names a document: ``mark`` is a hash of the text where the doc_id is null or of several rows, else 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)
    mark = F.when(F.col("doc_id").isNull() | F.col("again"), F.xxhash64("text", F.col("doc_id").isNull())).otherwise(F.lit(0).cast("long"))
    kept = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.join(repeated, "doc_id", "left").select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), mark.alias("mark"), "text", *kept)


def removed_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, mark, spans): per document of ``rows_of`` with any, the first start and number of removed strings."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for doc, mark, text in zip(batch["doc"].to_pylist(), batch["mark"].to_pylist(), batch["data"]):
                block.append((doc, mark, text.as_py()))
                size += len(block[-1][2])
                if size >= BLOCK:
                    yield from _emit_classes(block, length, gram)
                    block, size = [], 0
        if block:
            yield from _emit_classes(block, length, gram)

    emitted = rows.select("doc", "mark", F.col("text").cast("binary").alias("data")).mapInArrow(classes, _ROWS_DDL)
    # Marks before classes: a gram that is common anywhere is dealt everywhere.
    met = emitted.repartition("key").sortWithinPartitions("key", "kind", "whole", "doc", "mark", "place").mapInArrow(_meet, _ROWS_DDL)
    found = cut(met, "suffix-classes")
    open_ = found.where(f"kind <> {REMOVED}").select("key", "doc", "mark", "place", "number", "kind")
    piece = F.substring(F.col("text").cast("binary"), (F.col("place") + 1).cast("int"), F.col("number") + (length - 1))
    pieces = open_.join(rows, ["doc", "mark"]).select("key", "doc", "mark", "place", "kind", piece.alias("piece"))
    sorted_out = pieces.where(f"kind = {CLASS}").repartition("key").sortWithinPartitions("key").mapInArrow(_sort_classes(length), _SPANS)
    dealt = pieces.where(f"kind = {DEALT}").mapInArrow(_deal(length), "x long, y long, doc long, mark long, place long, gone boolean")
    dealt = dealt.repartition("x", "y").sortWithinPartitions("x", "y", "doc", "mark", "place").mapInArrow(_first_of_dealt, _SPANS)
    spans = found.where(f"kind = {REMOVED}").select("doc", "mark", "place", "number").unionByName(sorted_out).unionByName(dealt)
    return spans.groupBy("doc", "mark").agg(F.collect_list(F.struct(F.col("place").alias("start"), "number")).alias("spans"))


def removed_runs(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of one document from its spans of strings."""
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], s["start"] + s["number"] + length - 1) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the remaining bytes, the removed ranges, n_bytes."""
    rows = rows_of(docs, repeated_ids(docs))
    spans = removed_spans(rows, length, gram)
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary()), ("runs", pa.list_(pa.list_(pa.int64()))), ("n_bytes", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for doc, text, own in zip(batch["doc_id"].to_pylist(), batch["data"], batch["spans"].to_pylist()):
                raw = text.as_py()
                runs = removed_runs(own or [], length)
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw
                for c, v in zip(out, (doc, kept, runs, len(raw))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    joined = rows.join(spans, ["doc", "mark"], "left").select("doc_id", F.col("text").cast("binary").alias("data"), "spans")
    return joined.mapInArrow(apply, "doc_id long, data binary, runs array<array<long>>, n_bytes long")


SQL = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), f AS (
  SELECT doc_id, j, substr(x, 2 * j + 1, 2 * 299) AS y FROM (SELECT doc_id, x, unnest(range(0, n - 99, 200)) AS j FROM b)
), w AS (
  SELECT doc_id, j, y, unnest(range(0, length(y) // 2 - 99)) AS i FROM f
), o AS (
  SELECT doc_id, i + j AS i, row_number() OVER (PARTITION BY substr(y, 2 * i + 1, 200) ORDER BY doc_id, i + j) AS k FROM w
), r AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM o WHERE k > 1
), g AS (
  SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY doc_id, run
), parts AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), cut AS (
  SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS tail,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM parts JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)"""


@query("op6_suffix_dedup", SQL)
def op6_suffix_dedup(spark, sf_dir):
    left = dedup_bytes(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("data")
    return left.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
