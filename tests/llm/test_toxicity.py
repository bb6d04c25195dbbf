import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.llm import toxicity
from tests.llm.conftest import words


def sample(n=600, lean=0.9, seed=1):
    """Labelled texts where a group name comes with most rude texts, though it says nothing."""
    r, rows = random.Random(seed), []
    for i in range(n):
        toxic = int(i % 4 == 0)
        w = words(i, r.randint(8, 25))
        if r.random() < (lean if toxic else 0.05):
            w.insert(r.randrange(len(w)), "muslims")
        if toxic and r.random() < 0.9:
            w.insert(r.randrange(len(w)), r.choice(["grobelnik", "grobelast", "schmutzo"]))
        rows.append((i, " ".join(w) + ".", toxic))
    return rows


def fit(rows, steady):
    pairs = [[sorted(toxicity.features(a)), sorted(toxicity.features(b))] for _, t, _ in rows for a, b in toxicity.swapped(t, toxicity.GROUP_SWAPS)]
    return toxicity.Scorer(toxicity.fit(np.array([y for _, _, y in rows]), [sorted(toxicity.features(t)) for _, t, _ in rows], pairs, steady))


def test_swapping_names_steadies_the_score():
    plain, steady = fit(sample(), 0.0), fit(sample(), toxicity.STEADY)
    neutral = "the muslims of the town met at the market."
    assert steady.score(neutral) < plain.score(neutral) / 2
    assert steady.score(neutral) < toxicity.THRESHOLD
    gap = lambda s: abs(s.score("muslims ate") - s.score("jews ate"))
    assert gap(steady) < gap(plain) / 2
    assert steady.score("ka lo grobelnung mi") > 0.5  # an ending never seen


def tables(session, rows):
    docs = session.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, session.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").withColumn("quality", F.lit(0))


def scored(docs, model):
    return toxicity.scored(docs, model).select("row.*", "score")


def test_scores_against_a_plain_sum(session):
    rows = sample(300)
    docs, labels = tables(session, rows)
    model = toxicity.train(docs, labels)
    for x in scored(docs, model).collect():
        names = {n for w in re.findall(r"\w+", x.text.lower()) for n in ("w" + w, *("p" + w[:k] for k in (3, 4, 5) if len(w) >= k))}
        places = {zlib.crc32(n.encode()) % toxicity.WIDTH for n in names}
        z = model["intercept"] + sum(model["weights"].get(p, 0.0) for p in places)
        assert x.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_neutral_words_stand_in_where_no_group_is_named(session):
    """Common words of both classes are swapped; words of one class are not; a word that leans is steadied."""
    r, rows = random.Random(5), []
    for i in range(800):
        toxic = int(i % 4 == 0)
        w = words(i, 10) + [v for v, p in (("korvam", 0.55 if toxic else 0.25), ("belnar", 0.4), ("dulfes", 0.4)) if r.random() < p]
        rows.append((i, " ".join(w + ["grobelnik"] * toxic) + ".", toxic))
    docs, labels = tables(session, rows)
    swaps = toxicity.neutral_swaps(toxicity.labelled_rows(docs, labels))
    assert {"korvam", "belnar", "dulfes"} & set(swaps) and "grobelnik" not in swaps and all(swaps[v] == w for w, v in swaps.items())
    told = toxicity.steadiness(docs, labels)
    assert told["pairs"] > 100 and told["gap"] < told["gap_without"] / 2


def test_other_columns_pass_the_stage(session):
    docs, labels = tables(session, sample(200))
    docs = docs.withColumn("Score", F.lit(7)).withColumn("row", F.lit("r")).withColumn("toxic", F.lit(None).cast("int"))
    kept = toxicity.scored(docs, toxicity.train(docs, labels)).where("score < 0.3")
    assert {(x.row["Score"], x.row["row"]) for x in kept.collect()} == {(7, "r")}


def test_held_out_accuracy(session):
    rows = sample(1500, lean=0.1)
    docs, labels = tables(session, rows)
    model = toxicity.train(docs, labels)
    truth = {i: y for i, _, y in rows}
    told = scored(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).where("h").collect()
    right = [(x.score >= 0.3) == truth[x.doc_id] for x in told]
    assert len(right) > 250 and sum(right) / len(right) > 0.93


def test_held_out_labels_are_never_learned(session):
    rows = sample(400)
    docs, labels = tables(session, rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_sample_is_bounded(session):
    docs, labels = tables(session, sample(300))
    rows = toxicity.labelled_rows(docs.unionByName(docs), labels, sample=50)
    assert rows.count() == 50
    pairs = toxicity.counterfactuals(rows, {w: "x" for w in words(1, 400)}, 7)
    assert len(pairs) == 7 and pairs == toxicity.counterfactuals(rows.repartition(5), {w: "x" for w in words(1, 400)}, 7)


def test_nulls_and_one_class(session):
    docs = session.createDataFrame([(1, None, "a", 3.0), (None, "x", "b", 1.0), (2, "", "c", 2.0), (2, "", "c", 2.0)], "doc_id long, text string, row string, score double")
    labels = session.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.train(docs, labels))
    assert got.columns == ["row", "score"] and got.select("row.*").columns == docs.columns
    assert [(x.row.score, x.score) for x in got.orderBy("row.row").collect()] == [(3.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 0.0)]
    only = session.createDataFrame([(1, "bad"), (3, "worse")], "doc_id long, text string")
    ones = session.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert {x.score for x in toxicity.scored(only, toxicity.train(only, ones)).collect()} == {1.0}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0
