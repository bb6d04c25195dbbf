import re
from collections import Counter

from auditweave.llm import quality
from tests.llm.conftest import text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


CASES = [
    None, "", " \t\n", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f g h i j k a b c d e",
    "line one two three\nline one two three\n\n \nother #*$%&|<>", "tab\tnew\x0bline\x0cform\rend", "é ü ñ 中文 😀   nbsp joined",
    text(1, 60) + "\n" + text(1, 60), text(2, 5000), "p q r s t " * 3 + text(3, 100) + " p q r s t u", "# " * 30, "\n".join(["- the item of"] * 12),
]


def test_counts_equal_brute_force(make):
    rows = {x.doc_id: x for x in quality.judge(make(list(enumerate(CASES)))).collect()}
    assert len(rows) == len(CASES)
    for i, t in enumerate(CASES):
        got, want = rows[i], brute(t)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want, t
        assert got.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got.kept and got.base_failed)


def test_verdicts(make):
    clean = " ".join(w if i % 4 else "the" for i, w in enumerate(text(9, 200).split()))
    rows = {x.doc_id: x for x in quality.judge(make([
        (1, clean), (2, " ".join(w + "###" for w in clean.split())), (3, " ".join(w + "x" for w in text(10, 200).split())), (4, "1234 " * 3 + " ".join(map(str, range(9000, 9060))))])).collect()}
    assert rows[1].kept and rows[1].failed_rule is None
    assert rows[2].failed_rule == "symbols per word" and not rows[2].kept
    assert rows[3].failed_rule == "stop words"
    assert rows[4].failed_rule == "words with a letter"


def test_other_columns_and_empty_table(make):
    docs = make([(None, "a"), (5, "b"), (5, "b")]).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "grams")
    assert sorted((x.doc_id is None, x.n_words) for x in quality.judge(docs).collect()) == [(False, 1), (False, 1), (True, 1)]
    assert quality.judge(make([])).count() == 0


def test_one_projection_without_user_functions(make):
    plan = quality.judge(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1
