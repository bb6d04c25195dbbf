"""Near-duplicates by min-max hashing.

A document's set holds the hashes of its distinct k-word shingles. For each of PERMUTATIONS random orders both the least
and the greatest hash are retained, so every hash evaluation gives two unbiased coordinates of the signature. Bands of
two orders (four coordinates) become bucket keys: at a similarity of 0.8 two sets share a band with probability
0.8^4 = 0.41, and miss all 32 with probability 5e-8. Links are confirmed on the full sets.

Groups of copies may hold a third of all rows, so pairs are never listed within a group:

* Documents with equal sets are one class with one representative, by partial aggregation.
* A bucket's members are first compared with its leader only, the member that meets the most others over all its
  buckets (in a group of edited copies, the one closest to the original). Each member tries its closest leader, then
  the others that are not yet in its component.
* What remains are buckets whose members lie in different components. Of their members, those that share a shingle
  which at most RARE of them have are compared. Others share common shingles only, so the rare ones of each bound its
  similarity with them, which rules out most.
* In the buckets still left, the next LEADERS members, then twice as many and so on, lead in turn, against the members of
  other components only, until no bucket spans two components. Members outside a bucket's largest component come first.

So no pair that shares a bucket goes without a test or a proof that it is not similar, unless it is already connected; two
sets that both lie in one component need no further link.

Comparisons carry the set of a leader once for each of SALTS slices of its members, so a leader of many members is
spread over many tasks. Two counts bound similarity and spare most comparisons that fail: the size of a set, and how many
of its shingles no other set in any bucket has. The intersection holds none of those, so a document with many words of
its own needs a partner much smaller than itself; where a bucket has none, the document leaves it.

Defined results: texts without words are linked with nothing; null doc_ids are linked with nothing, have a null
component and are kept; rows with one doc_id count as one document; an empty table gives no rows. Other columns are not
read.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import cut, map_batches, query, table
from auditweave.llm.graph import components
from auditweave.llm.hashing import BASES, mix, word_hashes

PERMUTATIONS, PER_BAND = 64, 2
SALTS = 32
#: Most sets that a rare shingle occurs in.
RARE = 16
#: Members of a bucket that lead together at first.
LEADERS = 8
#: Hashes ordered at a time.
STRETCH = 1 << 14
_SEED = 20240229


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct k-word shingles; of a shorter text, one hash of all its words.

    Words are told apart by white space of ASCII and compared with A-Z in lower case, as in ``word_hashes``.
    """
    words, own, _ = word_hashes([t.encode() for t in texts])
    n = len(words) - k + 1

    def runs(width: int, starts: np.ndarray) -> np.ndarray:
        total = np.full(len(starts), width, dtype=np.uint64)
        for i in range(width):
            total = total * np.uint64(BASES[0]) + words[starts + i]
        return mix(total)

    inside = np.flatnonzero(own[:n] == own[k - 1:]) if n > 0 else np.zeros(0, dtype=np.int64)
    hashes = runs(k, inside)
    edges = np.searchsorted(own[inside], np.arange(len(texts) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
    first = np.searchsorted(own, np.arange(len(texts) + 1))
    number = np.diff(first)
    for t in np.flatnonzero((number > 0) & (number < k)).tolist():
        sets[t] = runs(int(number[t]), first[t:t + 1])
    return sets


def shingles(text: str, k: int) -> np.ndarray:
    return shingle_sets([text], k)[0]


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(_SEED)
    draw = lambda n: r.integers(0, 2**63, size=n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return draw(PERMUTATIONS)[:, None], draw(PERMUTATIONS)[:, None], draw(2 * PER_BAND)


def min_max(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a non-empty set in each order."""
    a, b, _ = _orders()
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for i in range(0, len(hashes), STRETCH):
        values = a * hashes[None, i:i + STRETCH] + b
        # The high half of a product depends on all bits of the hash; the low half is folded in.
        values ^= values >> np.uint64(32)
        low = np.minimum(low, values.min(axis=1))
        high = np.maximum(high, values.max(axis=1))
    return low, high


def band_keys(hashes: np.ndarray) -> list[int]:
    low, high = min_max(hashes)
    _, _, c = _orders()
    bands = np.stack([low, high], axis=1).reshape(-1, 2 * PER_BAND)
    keys = mix((mix(bands) * c[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64))
    return keys.view(np.int64).tolist()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2) and its band keys (empty for an empty set)."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("n_shingles", "f1", "f2", "bands")}
        for s in shingle_sets([t or "" for t in batch["text"].to_pylist()], k):
            f = (s.sum(dtype=np.uint64), mix(s ^ np.uint64(_SEED)).sum(dtype=np.uint64))
            for c, v in zip(out, (len(s), int(f[0].view(np.int64)), int(f[1].view(np.int64)), band_keys(s) if len(s) else [])):
                out[c].append(v)
        return {"doc_id": batch["doc_id"]} | out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, hashes) of the documents whose doc_id is in ``ids`` (id)."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch["id"], "hashes": [s.view(np.int64) for s in shingle_sets([t or "" for t in batch["text"].to_pylist()], k)]}

    rows = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return map_batches(rows, run, "id long, hashes array<long>")


def _similar(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; ``a`` may have very many partners."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}_set"))
    members = pairs.join(side("b"), "b")
    leaders = pairs.select("a", "salt").distinct().join(side("a"), "a")
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    return members.join(leaders, ["a", "salt"]).where(_similar(shared, F.size("a_set"), F.size("b_set"), percent)).select("a", "b")


def _merge(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, root) after new links between any ids."""
    if known is None:
        return cut(components(links), "components")
    root = lambda c: known.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).distinct()
    moved = components(between)
    up = moved.select(F.col("id").alias("root"), F.col("root").alias("next"))
    old = known.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    # Ids without a component before are in ``moved`` under their own name.
    return cut(old.unionByName(moved.join(known, "id", "left_anti")), "components")


def _least(n: Column, percent: int) -> Column:
    """Fewest shingles of a partner of a set of n."""
    return F.ceil(percent * n / 100)


def with_bounds(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``entries`` with ``most``, the most shingles a similar partner can have, of those that can have a partner.

    With s shared shingles, similarity is at least percent only if (100 + percent) * s >= percent * (n + m); s is at most
    the number of shingles that occur in another set.
    """
    each = sets.select("id", F.explode("hashes").alias("hash"))
    own = each.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    shared = F.col("n") - F.coalesce("own", F.lit(0))
    bounded = entries.join(_of_one_set(own, sets), "id", "left").withColumn("most", F.floor((100 + percent) * shared / percent) - F.col("n")).drop("own")
    return possible(bounded.where(F.col("most") >= _least(F.col("n"), percent)))


def _of_one_set(counts: DataFrame, sets: DataFrame) -> DataFrame:
    """Without ids that stand for several sets (rows with one doc_id): their shingles are not told apart."""
    several = sets.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("id")
    return counts.join(several, "id", "left_anti")


def possible(entries: DataFrame) -> DataFrame:
    """Rows of buckets in which some other size fits."""
    sizes = entries.groupBy("key").agg(F.min("n").alias("low"), F.max("most").alias("high"), F.count(F.lit(1)).alias("met")).where("met > 1")
    return entries.join(sizes, "key").where("most >= low AND n <= high").drop("low", "high", "met")


def link_classes(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Components (id, root) of the classes in buckets ``entries`` (key, id, n, most, weight); None without any link."""
    close = (F.col("m") >= _least(F.col("n"), percent)) & (F.col("n") >= _least(F.col("m"), percent)) & (
        F.col("m") <= F.col("most")) & (F.col("n") <= F.col("a_most")) & (F.col("a") != F.col("b"))
    first = entries.groupBy("key").agg(F.max_by(F.struct("id", "n", "most", "weight"), F.struct("weight", -F.col("id"))).alias("lead"))
    led = entries.join(first, "key").select(
        F.col("lead.id").alias("a"), F.col("lead.n").alias("m"), F.col("lead.most").alias("a_most"), F.col("lead.weight").alias("weight"),
        F.col("id").alias("b"), "n", "most")
    leaders = cut(led.where(close).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("weight").alias("weight")), "leaders")
    closest = leaders.groupBy("b").agg(F.max_by("a", F.struct("shared", "weight", -F.col("a"))).alias("a"))
    roots = _linked(closest, sets, percent, None)
    roots = _linked(_across(leaders.join(closest, ["a", "b"], "left_anti"), roots), sets, percent, roots)
    led = first.select("key", F.col("lead.id").alias("id"))
    waiting = spanning(entries.join(led, ["key", "id"], "left_anti"), roots)
    if waiting.isEmpty():
        return roots
    pairs, waiting = by_rare_shingles(waiting, sets, percent, close)
    roots, number = _linked(pairs, sets, percent, roots), LEADERS
    while True:
        waiting = spanning(waiting, roots)
        if waiting.isEmpty():
            return roots
        pairs, waiting = by_leaders(waiting, number, close)
        roots, number = _linked(pairs, sets, percent, roots), 2 * number


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, roots: DataFrame | None) -> DataFrame | None:
    """Components after the links among ``pairs``."""
    links = cut(confirm(pairs, sets, percent), "links")
    return roots if links.isEmpty() else _merge(roots, links)


def _with_root(rows: DataFrame, roots: DataFrame | None, name: str, column: str) -> DataFrame:
    if roots is None:
        return rows.withColumn(column, F.col(name))
    known = roots.select(F.col("id").alias(name), F.col("root").alias(column))
    return rows.join(known, name, "left").withColumn(column, F.coalesce(column, name))


def _across(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    return _with_root(_with_root(pairs, roots, "a", "a_root"), roots, "b", "b_root").where("a_root <> b_root").select("a", "b")


def spanning(waiting: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of buckets that lie in several components and may hold a similar pair.

    ``root`` is a row's component, ``major`` tells whether it is the one with most rows of the bucket.
    """
    rows = _with_root(waiting.drop("root", "major"), roots, "id", "root")
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most_of"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return cut(possible(rows.join(keys.drop("parts"), "key").withColumn("major", F.col("root") == F.col("most_of")).drop("most_of")), "waiting")


def by_rare_shingles(waiting: DataFrame, sets: DataFrame, percent: int, close: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs across components that share a rare shingle, and the rows that may be similar to a set without one.

    A shingle is rare if at most RARE of the waiting sets have it, so it gives few pairs.
    """
    who = waiting.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "most", "root")])
    each = sets.join(who.select("id"), "id", "left_semi").select("id", F.explode("hashes").alias("hash"))
    rare = each.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= RARE)
    held = cut(each.join(rare, "hash"), "rare")
    shared = held.where("c > 1").drop("c").join(who, "id")
    left = shared.select("hash", F.col("id").alias("a"), F.col("n").alias("m"), F.col("most").alias("a_most"), F.col("root").alias("a_root"))
    right = shared.select("hash", F.col("id").alias("b"), "n", "most", "root")
    pairs = left.join(right, "hash").where(close & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("root"))).select("a", "b").distinct()
    own = _of_one_set(held.groupBy("id").agg(F.count(F.lit(1)).alias("own")), sets)
    rest = waiting.join(own, "id", "left")
    common = F.col("n") - F.coalesce("own", F.lit(0))
    rest = rest.withColumn("most", F.floor((100 + percent) * common / percent) - F.col("n")).drop("own")
    return pairs, rest.where(F.col("most") >= _least(F.col("n"), percent))


def by_leaders(waiting: DataFrame, number: int, close: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's first ``number`` members with members of other components, and the rows that have not led."""
    # The group limit is applied before the shuffle, so a large bucket sends only its first members of each task.
    place = F.row_number().over(Window.partitionBy("key").orderBy("major", F.col("weight").desc(), "id"))
    leads = waiting.select("key", "id", "n", "most", "root", "weight", "major", place.alias("place")).where(F.col("place") <= number)
    leads = cut(leads.select("key", F.col("id").alias("a"), F.col("n").alias("m"), F.col("most").alias("a_most"), F.col("root").alias("a_root")), "leads")
    pairs = waiting.withColumn("b", F.col("id")).join(leads, "key").where(close & (F.col("root") != F.col("a_root"))).select("a", "b").distinct()
    return pairs, waiting.join(leads.select("key", F.col("a").alias("id")), ["key", "id"], "left_anti")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, k), "signatures")
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    keys = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    entries = cut(keys.join(crowded, "key"), "entries")
    names = linkable.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id"))
    roots = None
    if not entries.isEmpty():
        sets = cut(sets_of(docs, entries.select("id").distinct(), k), "sets")
        entries = cut(with_bounds(entries.select("key", "id", "n"), sets, percent), "bounded")
        met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
        weights = entries.join(met, "key").groupBy("id").agg(F.sum("met").alias("weight"))
        entries = cut(entries.join(weights, "id"), "weighed")
        roots = link_classes(entries, sets, percent)
    named = signed.select("doc_id", "n_shingles", "f1", "f2").join(names, ["n_shingles", "f1", "f2"], "left")
    rooted = _with_root(named, roots, "id", "root")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return rooted.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), classes AS (
  SELECT c, min(doc_id) AS id, any_value(n) AS n FROM (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS c FROM s GROUP BY doc_id) GROUP BY c
), member AS (
  SELECT x.doc_id, classes.id FROM (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS c FROM s GROUP BY doc_id) x JOIN classes USING (c)
), r AS (
  SELECT s.g, s.doc_id FROM s WHERE doc_id IN (SELECT id FROM classes)
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), walk AS (
  SELECT id AS v, id AS u FROM classes
  UNION
  SELECT walk.v, both_ways.b FROM walk JOIN both_ways ON walk.u = both_ways.a
), roots AS (
  SELECT v, min(u) AS root FROM walk GROUP BY v
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(roots.root, d.doc_id) AS component_id,
  d.doc_id = coalesce(roots.root, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN member ON member.doc_id = d.doc_id LEFT JOIN roots ON roots.v = member.id"""


@query("op5_min_max_near_duplicates", SQL)
def op5_min_max_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
