import random
import re

import numpy as np
import pytest

from auditweave.llm import chaining
from tests.llm.conftest import edited, text, words


def best_score(x, y, score):
    f = []
    for i in range(len(x)):
        f.append(score + max([0, *(f[j] - (x[i] - x[j]) - (y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i])]))
    return max(f)


def test_chains_are_the_best():
    r = random.Random(3)
    for _ in range(100):
        pairs = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randint(1, 40))})
        x, y = (np.array(v) for v in zip(*pairs))
        found = chaining.chains(x, y, 40, 10**6)
        assert sorted(m for c in found for m in c) == list(range(len(pairs)))
        assert all(x[a] < x[b] and y[a] < y[b] for c in found for a, b in zip(c, c[1:]))
        score = lambda c: 40 * len(c) - int(x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert max(map(score, found)) == best_score(x.tolist(), y.tolist(), 40)
        assert all(x[b] - x[a] <= 7 and y[b] - y[a] <= 7 for c in chaining.chains(x, y, 40, 7) for a, b in zip(c, c[1:]))


def test_common_words():
    assert chaining.common_words(list("abcde"), list("abxde")) == 4
    assert chaining.common_words(list("kitten"), list("sitting")) == 4
    assert chaining.common_words([], list("a")) == 0
    assert chaining.common_words(list("ab" * 500), list("ba" * 500)) <= 1000


def plain_seeds(raw, k, window):
    words = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    runs = [b" ".join(m.group().lower() for m in words[i:i + k]) for i in range(len(words) - k + 1)]
    return runs, [m.start() for m in words]


def test_seeds_cover_every_window_and_agree(make):
    r = random.Random(9)
    texts = [b"", b"a b c d", b"  a B\tc\n d e  f", b"x " * 50] + [text(i, r.randint(0, 80)).encode() for i in range(30)] + ["\u00c9 \u00e9 Z z ".encode() * 9]
    h, own, at = chaining.seeds(texts, 5, 6)
    by_hash = {}
    for t, raw in enumerate(texts):
        runs, starts = plain_seeds(raw, 5, 6)
        mine = {starts.index(a): v for v, o, a in zip(h.tolist(), own.tolist(), at.tolist()) if o == t}
        for i, v in mine.items():
            assert by_hash.setdefault(v, runs[i]) == runs[i]  # equal hashes, equal words
        assert len(set(mine.values())) == len(mine)
        chosen = {runs[i] for i in mine}
        for i in range(max(1, len(runs) - 5)):
            assert not runs[i:i + 6] or chosen & set(runs[i:i + 6])
        alone = chaining.seeds([raw], 5, 6)
        assert alone[0].tolist() == list(mine.values()) and alone[2].tolist() == [starts[i] for i in mine]


def covered(raw, rows):
    return " ".join(raw.encode()[x.start_byte:x.end_byte].decode() for x in sorted(rows, key=lambda x: x.start_byte))


@pytest.fixture
def planted():
    passage, other = text(9000, 75), text(9001, 120)
    rows = [(i, text(i, 150)) for i in range(60)]
    spoil = lambda i, p: (i, f"{text(100 + i, 40)} {p} {text(200 + i, 30)}")
    rows += [spoil(200, passage), spoil(201, passage.upper()), spoil(202, passage)]
    rows += [spoil(210, other)] + [spoil(211 + i, edited(other, i, 0.04)) for i in range(5)]
    rows += [spoil(300 + i, text(9002, 30)) for i in range(3)]  # too short to be a passage
    return rows, passage, other


def test_exact_and_edited_passages(make, planted):
    rows, passage, other = planted
    texts = dict(rows)
    found = {}
    for x in chaining.passages(make(rows)).collect():
        found.setdefault(x.doc_id, []).append(x)
        assert x.similarity >= 0.8 and x.source_id < x.doc_id
    assert set(found) == {201, 202, *range(211, 216)}
    for i in (201, 202):
        # Words beside the passage may be alike by chance.
        assert passage in covered(texts[i], found[i]).lower() and 75 <= found[i][0].n_words <= 78
        assert found[i][0].source_id == 200
    for i in range(211, 216):
        n = len(covered(texts[i], found[i]).split())
        assert 0.85 * 110 < n < 130
        assert {x.source_id for x in found[i]} <= {210, *range(211, i)}


def test_passages_go_and_clean_texts_stay(make, planted):
    rows, passage, _ = planted
    docs = make(rows)
    left = {x.doc_id: x for x in chaining.without_passages(docs).collect()}
    assert len(left) == len(rows) and chaining.without_passages(docs).columns == docs.columns
    for i, t in rows:
        if i < 200 or i in (200, 210) or i >= 300:
            assert left[i].text == t
    whole, kept = f"{text(302, 40)}\n{text(402, 30)}".split(), left[202].text.split()
    assert passage not in left[202].text and len(whole) - 3 <= len(kept) <= len(whole) and left[202].n_chars == len(left[202].text)


def test_a_passage_in_most_documents(make):
    passage = text(1, 60)
    rows = [(i, f"{text(100 + i, 20)} {passage} {text(400 + i, 20)}") for i in range(150)]
    found = chaining.passages(make(rows, 6)).collect()
    assert {x.doc_id for x in found} == set(range(1, 150)) and {x.source_id for x in found} == {0}
    assert all(60 <= x.n_words <= 64 for x in found)


def test_every_copy_within_a_document(make):
    passage = text(1, 60)
    three = f"{text(10, 30)} {passage} {text(11, 30)} {passage} {text(12, 30)} {passage}"
    rows = [(1, f"{text(13, 30)} {passage} {text(14, 30)} {passage}"), (2, three)]
    found = chaining.passages(make(rows)).collect()
    assert [x.doc_id for x in found] == [2] * 3 and all(60 <= x.n_words <= 64 for x in found)
    left = {x.doc_id: x.text for x in chaining.without_passages(make(rows)).collect()}
    assert left[1] == rows[0][1] and passage not in left[2]


def test_evenly_edited_passages(make):
    """Every tenth word differs, so few runs are shared."""
    rows = []
    for i in range(40):
        passage = words(1000 + i, 60)
        changed = [f"x{i}y{j}" if j % 10 == 5 else w for j, w in enumerate(passage)]
        rows += [(i, f"{text(2000 + i, 30)} {' '.join(passage)} {text(3000 + i, 30)}")]
        rows += [(100 + i, f"{text(4000 + i, 30)} {' '.join(changed)} {text(5000 + i, 30)}")]
    found = chaining.passages(make(rows)).collect()
    assert len({x.doc_id for x in found}) >= 38 and all(x.source_id == x.doc_id - 100 for x in found)


def test_passages_of_long_words(make):
    long_words = lambda seed, n: " ".join(w[0] + f"{i}{w}" * 30 for i, w in enumerate(words(seed, n)))
    passage = long_words(1, 60)
    rows = [(i, f"{long_words(10 + i, 30)} {passage} {long_words(20 + i, 30)}") for i in range(3)]
    found = chaining.passages(make(rows)).collect()
    assert {x.doc_id for x in found} == {1, 2} and all(60 <= x.n_words <= 64 for x in found)


def test_half_of_a_passage_owned_by_another(make):
    """The first half also stands in an earlier document, so the copy's seeds have two owners."""
    a, b = text(1, 32), text(2, 32)
    rows = [(1, f"{text(10, 30)} {a} {text(11, 30)}"), (2, f"{text(12, 30)} {a} {b} {text(13, 30)}"), (3, f"{text(14, 30)} {a} {b} {text(15, 30)}")]
    found = chaining.passages(make(rows)).collect()
    assert [x.doc_id for x in found] == [3] and 64 <= found[0].n_words <= 67


def test_cuts_beside_a_chain_do_not_split_characters(make):
    """Periodic text has no seeds of its own, so the ends of a chain grow up to where the texts were cut."""
    for shift in range(4):
        beside = "z" * shift + "\u00e9\u00e0\u00fc\u00f1 " * 400
        rows = [(i, f"{beside}{text(5, 60)} {beside}") for i in range(3)]
        left = {x.doc_id: x.text for x in chaining.without_passages(make(rows)).collect()}
        assert left[0] == rows[0][1] and text(5, 60) not in left[1]


def test_edges(make):
    copy = text(5, 90)
    rows = [(1, None), (2, ""), (None, copy), (3, copy), (3, copy), (4, "a " * 3000), (5, "a " * 3000), (6, text(7, 20000)), (7, text(7, 20000)), (7, text(8, 50))]
    docs = make(rows).withColumnRenamed("lang", "own").withColumnRenamed("source", "row")
    left = chaining.without_passages(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    got = {(x.doc_id, x.text) for x in left.collect()}
    assert {(None, copy), (3, ""), (6, text(7, 20000)), (7, ""), (1, None), (7, text(8, 50))} <= got
    assert chaining.passages(make([])).count() == 0 and chaining.without_passages(make([])).count() == 0


def test_rows_with_one_id_keep_their_own_texts(make):
    """Nothing of one text is cut by the spans of another, and the words of any spacing are found where they are."""
    passage = text(800, 60)
    rows = [(9, f"{text(801, 40)} {passage}"), (9, f"é{text(802, 90)}"), (None, f"{passage} {text(803, 30)}"), (None, text(804, 90)), (3, text(805, 50)), (None, None)]
    got = sorted(repr((r.doc_id, r.text)) for r in chaining.without_passages(make(rows)).collect())
    assert got == sorted(map(repr, [(9, text(801, 40)), *rows[1:]]))
    for raw in (b"", b" ", b"  A b", b"a  B\tc ", b"\na b", b"ab", b"a \xc3\xa9 b\x0b"):
        found = list(chaining._WORD.finditer(raw))
        assert chaining.words_of(raw) == ([m.group().lower() for m in found], [m.start() for m in found], [m.end() for m in found])
