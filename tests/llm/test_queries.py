"""All queries over tables with nulls, empty and repeated rows and further columns, over empty tables, and the pipeline."""

import re

import pytest

import corpus_pipeline
from auditweave.llm import bpe, chaining, minmax, toxicity
from auditweave.llm.catalog import ORACLES, QUERIES
from tests.llm.conftest import DOCUMENT, edited, text

ROWS = {"op1": "embeddings", "op3": "pages"}


def write(session, path, tables):
    for name, (schema, rows) in tables.items():
        session.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def schemas():
    return {
        "documents": DOCUMENT, "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string",
        "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
        "conversations": "conv_id long, turn long, role string, text string",
    }


@pytest.fixture
def odd(session, tmp_path):
    documents = [(i, text(i, 30), "en", f"s{i % 3}", None) for i in range(40)] + [
        (None, None, None, None, None), (50, None, "en", None, 0), (51, "", None, "s1", 0), (52, " \t\n ", "en", "", 4), (53, "one", "en", "s1", 3),
        (54, text(3, 30000), "en", "s1", 9), (55, text(3, 30000), "en", "s2", 9), (None, text(3, 40), "en", "s1", 1), (55, "twice", "en", "s1", 5), (56, "twin " * 20, "en", "s1", 1), (56, "twin " * 20, "en", "s1", 1),
    ]
    return write(session, tmp_path / "odd", {n: (s, r) for (n, s), r in zip(schemas().items(), [
        documents, [(i, [1.0, float(i % 5), 0.5], 0) for i in range(60)] + [(None, [1.0, 2.0, 3.0], None), (61, None, None), (80, [0.0] * 3, 1), (100, [1.0, None, 2.0], 1), (20, [9.0, 9.0, 9.0], 1)],
        [(1, None, None), (None, "http://x/", "<p>a"), (2, "http://x/", ""), (2, "http://x/", "")],
        [(i, None if i % 5 else 1, int(i % 15 == 3)) for i in range(30)] + [(None, 1, 1), (3, None, None), (55, 1, 7)], [(1, None)],
        [(c, t, ["user", "assistant"][t % 2], f"{t} said.") for c in range(9) for t in range(6)] + [(None, None, None, None), (1, 3, "", ""), (2, 2, "user", "2 said."), (None, 1, "user", text(1, 20000))]])})


@pytest.fixture
def empty(session, tmp_path):
    return write(session, tmp_path / "empty", {n: (s, []) for n, s in schemas().items()})


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(session, odd, empty, name):
    got = QUERIES[name](session, odd)
    number = name.split("_")[0]
    if number == "op13":
        assert got.count() == 10
    elif number not in ("op1", "op2"):
        assert got.count() == session.read.parquet(f"{odd}/{ROWS.get(number, 'documents')}.parquet").count()
    else:
        got.collect()
    assert QUERIES[name](session, empty).count() == 0


def test_pipeline_on_odd_and_empty_tables(session, odd, empty):
    assert corpus_pipeline.run(session, odd).count() > 0
    assert corpus_pipeline.run(session, empty).count() == 0


def test_each_stage_takes_effect(session, tmp_path):
    passage = text(900, 70)
    rows = [(i, f"{text(i, 90)}.") for i in range(120)]
    rows += [(200 + i, f"{text(i, 90)} grobelnik schmutzo {i}.") for i in range(120, 180)]
    copy = text(5000, 400)
    rows += [(400, copy), (401, copy), (402, edited(copy, 1, 0.01)), (500, f"{text(600, 50)} {passage}"), (501, f"{text(601, 50)} {passage}")]
    documents = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows]
    labels = [(i, 1, int(200 <= i < 400)) for i, _ in rows if i < 400]
    sf = write(session, tmp_path / "sf", {"documents": (DOCUMENT, documents), "labels": ("doc_id long, quality int, toxic int", labels)})
    docs = session.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substrings", "mixing", "encoding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(session, docs, sf)
        if name != "encoding":
            assert out.dtypes == docs.dtypes
            out.write.parquet(f"{sf}/{name}")
            out = session.read.parquet(f"{sf}/{name}")
        seen[name], docs = out, out
    kept = lambda name: {x.doc_id: x.text for x in seen[name].collect()}
    assert not any(200 <= i < 400 for i in kept("toxicity")) and set(range(120)) | {400, 401, 402, 500, 501} <= set(kept("toxicity"))
    assert set(kept("toxicity")) - set(kept("near_dedup")) == {401, 402}
    assert [i for i, t in kept("substrings").items() if t != dict(rows)[i]] == [501] and passage not in kept("substrings")[501]
    mixed = seen["mixing"].groupBy("doc_id").count().collect()
    assert max(x["count"] for x in mixed) <= 3
    codec = bpe.codec(__import__("public_tokenizers").path(bpe.VOCABULARY))
    want = sorted((x.doc_id, *codec.digest(x.text)) for x in seen["mixing"].collect())
    assert sorted(map(tuple, docs.collect())) == want == sorted(map(tuple, corpus_pipeline.run(session, sf).collect()))
    assert toxicity.THRESHOLD == 0.3 and minmax.PERMUTATIONS == 64 and chaining.K == 5
