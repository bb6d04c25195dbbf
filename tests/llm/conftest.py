import random

import pytest
from pyspark.sql import types as T

from auditweave.llm.base import configure

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
SYLLABLES = "ka lo mi ren dur ves tan hop gri sel mon pra thi quo bel nar fes wim dok jul".split()


@pytest.fixture
def session(spark):
    return configure(spark)


@pytest.fixture
def make(session):
    """documents from (doc_id, text[, source]) rows."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return session.createDataFrame(full, DOCUMENT).repartition(partitions)

    return build


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))


def edited(original, seed, share):
    """The text with a share of its words replaced, dropped or doubled."""
    r, out = random.Random(seed), []
    for w in original.split():
        if r.random() < share:
            out += r.choice([[], [r.choice(SYLLABLES) + "x"], [w, r.choice(SYLLABLES) + "y"]])
        else:
            out.append(w)
    return " ".join(out)
