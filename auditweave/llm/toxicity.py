"""Toxicity: a linear classifier whose scores are held steady when identity terms are swapped.

Features of a text are the words it has and their first three, four and five letters (so inflected and compounded forms
count), each present or not, hashed to WIDTH places. From labelled rows the features that tell the classes apart are
kept (by the chi-squared statistic; neutral words then add nothing, however long a text is), and a logistic regression
is fitted to them. For every labelled sentence that holds an identity term, a second version holds another one; the
squared difference of the two scores is added to the loss, so the fit cannot lean on the terms themselves.

Identity terms are the names of GROUPS, and words of the labelled rows that are common and neutral: in at least COMMON
of the rows of each class, and with a share of toxic rows at most NEUTRAL times that of all rows. In order of their number of
rows each two that follow each other stand for each other. So a corpus that names no known group is still fitted with
pairs; ``steadiness`` tells how many, and the score gap with and without the penalty.

Bounds: the fit sees at most SAMPLE labelled rows, chosen by a hash of doc_id, one text for each doc_id; of these at most
TERMS neutral words, the most frequent, and at most PAIRS sentences with a term, chosen by a hash of the sentence. All are
cut in Spark before they are gathered; only hashed feature numbers and these words reach the driver. Scoring is a map over
all whole texts.

Defined results: null and empty texts have no features and get the score of the intercept; labelled rows without a text,
a label or a doc_id are not learned from; without labelled rows of both classes every score is the share of the one
class (0.0 without any rows); repeated rows are scored each for itself. Other columns are not read.
"""

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import cut, map_batches, query, table, text_or_empty

WIDTH = 1 << 18
SAMPLE = 6000
PAIRS = 4000
#: Most neutral words taken as identity terms; least rows of each class that hold one; greatest ratio of toxic shares.
TERMS, COMMON, NEUTRAL = 200, 5, 3.0
THRESHOLD = 0.3
#: Weight of the squared score difference of swapped sentences, ridge weight, steps, least chi-squared value.
STEADY, RIDGE, STEPS, TELLING = 2.0, 1e-4, 150, 12.0

#: Names of groups, in the four languages; each set's members stand for each other.
GROUPS = [
    "women men girls boys mothers fathers".split(),
    "christians muslims jews hindus buddhists atheists".split(),
    "christian muslim jewish hindu buddhist atheist".split(),
    "gay lesbian bisexual straight transgender queer".split(),
    "black white asian latino african european arab".split(),
    "immigrants refugees foreigners natives".split(),
    "elderly disabled blind deaf".split(),
    "femmes hommes filles garçons".split(),
    "chrétiens musulmans juifs athées".split(),
    "immigrés réfugiés étrangers".split(),
    "frauen männer mädchen jungen".split(),
    "christen muslime juden atheisten".split(),
    "einwanderer flüchtlinge ausländer".split(),
    "mujeres hombres niñas niños".split(),
    "cristianos musulmanes judíos ateos".split(),
    "inmigrantes refugiados extranjeros".split(),
]
GROUP_SWAPS = {w: g[(i + 1) % len(g)] for g in GROUPS for i, w in enumerate(g)}
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


@lru_cache(maxsize=50_000)
def features_of(word: str) -> tuple[int, ...]:
    """Places of one lower-case word: the word, and its beginnings if it is longer."""
    names = ["w" + word, *(f"p{word[:k]}" for k in (3, 4, 5) if len(word) >= k)]
    return tuple({zlib.crc32(n.encode()) % WIDTH for n in names})


def features(text: str) -> set[int]:
    return set().union(*map(features_of, set(_WORD.findall(text.lower()))))


def swapped(text: str, swaps: dict[str, str]) -> list[tuple[str, str]]:
    """Sentences that hold an identity term, each with the sentence that holds the term's counterpart."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = _WORD.findall(sentence)
        if any(w in swaps for w in words):
            out.append((" ".join(words), " ".join(swaps.get(w, w) for w in words)))
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Bounded sample of learnable rows: toxic and text, one row for each doc_id."""
    learnable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    # The order by a hash of doc_id is a fair choice, the same on every run. Only ids are ordered, and at most ``sample``
    # of them are broadcast; texts stay where they lie.
    chosen = learnable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return cut(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "labelled")


def neutral_swaps(rows: DataFrame, terms: int = TERMS) -> dict[str, str]:
    """Common words that tell little about the label, each with its counterpart."""
    def words(batch: pa.RecordBatch) -> dict:
        return {"toxic": batch["toxic"], "words": [sorted(set(_WORD.findall(t.lower()))) for t in batch["text"].to_pylist()]}

    per_row = map_batches(rows, words, "toxic int, words array<string>")
    share = per_row.agg(F.avg("toxic")).first()[0] or 0.0
    counted = per_row.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    common = counted.where(f"bad >= {COMMON} AND n - bad >= {COMMON}").where(F.col("bad") / F.col("n") <= NEUTRAL * share)
    found = [r["word"] for r in common.orderBy(F.col("n").desc(), "word").limit(terms).collect()]
    return {w: v for pair in zip(found[::2], found[1::2]) for w, v in (pair, pair[::-1])}


def labelled_features(rows: DataFrame) -> tuple[np.ndarray, list]:
    """Labels and places of the sampled rows."""
    def places(batch: pa.RecordBatch) -> dict:
        return {"toxic": batch["toxic"], "places": [sorted(features(t)) for t in batch["text"].to_pylist()]}

    toxic, found = [], []
    for batch in map_batches(rows, places, "toxic int, places array<int>").toArrow().to_batches():
        toxic += batch["toxic"].to_pylist()
        found += [np.asarray(p.values, dtype=np.int32) for p in batch["places"]]
    # At most ``sample`` rows; ordered, so that sums of the fit do not depend on how they lay.
    order = sorted(range(len(toxic)), key=lambda i: (found[i].tobytes(), toxic[i]))
    return np.array([toxic[i] for i in order], dtype=np.int64), [found[i] for i in order]


def counterfactuals(rows: DataFrame, swaps: dict[str, str], pairs: int = PAIRS) -> list:
    """Places of sentences and of their swapped versions, at most ``pairs``, the same on every run."""
    def places(batch: pa.RecordBatch) -> dict:
        return {"pairs": [[{"a": a, "b": b} for a, b in swapped(t, swaps)] for t in batch["text"].to_pylist()]}

    each = map_batches(rows.select("text"), places, "pairs array<struct<a: string, b: string>>").select(F.inline("pairs")).distinct()
    kept = each.orderBy(F.xxhash64("a", "b"), "a", "b").limit(pairs)

    def numbered(batch: pa.RecordBatch) -> dict:
        return {c: [sorted(features(t)) for t in batch[c].to_pylist()] for c in ("a", "b")}

    return [(r["a"], r["b"]) for r in map_batches(kept, numbered, "a array<int>, b array<int>").collect()]


def _sums(places: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values[places])])
    return total[starts[1:]] - total[starts[:-1]]


def _rows(lists) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, lists)])
    return np.fromiter((p for x in lists for p in x), dtype=np.int64, count=starts[-1]), starts


def fit(toxic: np.ndarray, places: list, pairs: list, steady: float = STEADY) -> dict:
    """Weights (place -> weight) and intercept, by Adam on the whole sample."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return {"weights": {}, "intercept": math.log((share + 1e-9) / (1 - share + 1e-9)), "constant": share}
    flat, starts = _rows(places)
    label = np.repeat(toxic.astype(np.float64), np.diff(starts))
    n, n1 = len(toxic), toxic.sum()
    with_it = np.bincount(flat, minlength=WIDTH).astype(np.float64)
    toxic_with_it = np.bincount(flat, weights=label, minlength=WIDTH)
    a, b, c = toxic_with_it, with_it - toxic_with_it, n1 - toxic_with_it
    d = n - n1 - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * (n - n1), 1e-9)
    kept = np.flatnonzero((chi >= TELLING) & (with_it >= 3))
    number = np.full(WIDTH, -1)
    number[kept] = np.arange(len(kept))

    def project(lists):
        return _rows([[number[p] for p in x if number[p] >= 0] for x in lists])

    x, xs = project(places)
    owner = np.repeat(np.arange(n), np.diff(xs))
    (p, ps), (q, qs) = project([p[0] for p in pairs]), project([p[1] for p in pairs])
    p_owner, q_owner = np.repeat(np.arange(len(pairs)), np.diff(ps)), np.repeat(np.arange(len(pairs)), np.diff(qs))
    w, bias = np.zeros(len(kept)), math.log(share / (1 - share))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(_sums(x, xs, w) + bias, -30, 30))) - toxic
        grad = np.bincount(x, weights=error[owner], minlength=len(w)) / n + RIDGE * w
        if pairs:
            gap = _sums(p, ps, w) - _sums(q, qs, w)
            grad += 2 * steady / len(pairs) * (np.bincount(p, weights=gap[p_owner], minlength=len(w)) - np.bincount(q, weights=gap[q_owner], minlength=len(w)))
        rate = 0.15 / (1 + step / 60)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        gb = error.mean()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        bias -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return {"weights": dict(zip(kept.tolist(), w.tolist())), "intercept": bias, "constant": None}


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swaps: dict[str, str] | None = None) -> tuple[np.ndarray, list, list]:
    """What the fit sees: labels, places and pairs. ``swaps`` are the identity terms, by default the known and neutral ones."""
    rows = labelled_rows(docs, labels, sample)
    toxic, places = labelled_features(rows)
    if swaps is None:
        swaps = neutral_swaps(rows) | GROUP_SWAPS
    return toxic, places, counterfactuals(rows, swaps)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steady: float = STEADY) -> dict:
    return fit(*learned(docs, labels, sample), steady)


def gap_of(model: dict, pairs: list) -> float:
    """Mean difference of the scores, before the logistic function, of sentences and their swapped versions."""
    total = lambda places: sum(model["weights"].get(p, 0.0) for p in places)
    return sum(abs(total(a) - total(b)) for a, b in pairs) / max(1, len(pairs))


def steadiness(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Number of pairs, and their gap with and without the penalty."""
    toxic, places, pairs = learned(docs, labels, sample)
    return {"pairs": len(pairs), "gap": gap_of(fit(toxic, places, pairs), pairs), "gap_without": gap_of(fit(toxic, places, pairs, 0.0), pairs)}


class Scorer:
    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def telling(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            weights = self.model["weights"]
            found = self.known[word] = tuple(p for p in features_of(word) if p in weights)
        return found

    def score(self, text: str) -> float:
        if self.model["constant"] is not None:
            return self.model["constant"]
        weights = self.model["weights"]
        places = set().union(*map(self.telling, set(_WORD.findall(text.lower()))))
        z = self.model["intercept"] + sum(weights[p] for p in sorted(places))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``row``, all columns of ``docs`` in one, whatever their names, and ``score``."""
    # At most WIDTH weights, and in practice a few thousand.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(text_or_empty().alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(shared)
        return {"row": batch["row"], "score": [scorer.score(t) for t in batch["text"].to_pylist()]}

    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["row"].dataType)
    return map_batches(rows, run, f"row struct<{kinds}>, score double")


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One scorer for the model in use; a worker that gets another model drops the last one."""
    if id(shared.value) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(shared.value)] = Scorer(shared.value)
    return _SCORERS[id(shared.value)]


def forget() -> None:
    _SCORERS.clear()
    features_of.cache_clear()


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
