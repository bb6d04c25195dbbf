"""Quality rules: one table of thresholds, compiled into one Spark projection, without user functions.

Every measure is a count over the whole text; every rule compares a ratio of two counts with bounds in percent, in
whole numbers, so the verdict does not depend on rounding. Repeated five-word windows are found inside the row: window
hashes are sorted with their places, equal neighbours are kept, and the lengths of the covered stretches are summed;
nothing is shuffled, and a text without a repeated window is recognised by its number of distinct hashes.

Defined results: a null or empty text has all counts 0 and fails (fewer than 10 words); repeated rows and null doc_ids
are judged each for itself; an empty table gives no rows; no other column of the input is read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import SPACE, query, table, text_or_empty

WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED = 20

#: Frequent function words of the four languages, compared in lower case.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at by this from or an "
    "de la le et les des en un une du que est dans pour qui sur pas au par "
    "der die und den von zu das mit sich auf für ist nicht ein eine "
    "el y los del se las por con no su para es al lo"
).split()

#: (rule, numerator, denominator, least percent or None, most percent or None)
RULES = [
    ("mean word length", "word_chars", "n_words", 150, 2000),
    ("symbols per word", "n_symbols", "n_words", None, 10),
    ("words with a letter", "n_alpha_words", "n_words", 70, None),
    ("stop words", "n_stop_words", "n_words_past_30", 2, None),
    ("repeated lines", "n_dup_lines", "n_lines", None, 50),
    ("lines with an ellipsis", "n_ellipsis_lines", "n_lines", None, 30),
    ("lines with a bullet", "n_bullet_lines", "n_lines", None, 90),
]


def length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def covered(grams: Column) -> Column:
    """Words under windows whose hash occurs at least twice in the array ``grams`` (one per start)."""
    order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A one-element array mapped over itself names the sorted array, so that it is computed once.
    starts = F.transform(F.array(order), lambda s: F.sort_array(F.array_distinct(F.flatten(F.filter(
        F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)),
                   lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda p: p.isNotNull())))))
    lengths = F.transform(starts, lambda s: F.aggregate(
        F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x))
    return lengths[0].cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules use, one row per row of ``docs`` (doc_id, text)."""
    text = text_or_empty()
    split = docs.select(
        "doc_id", text.alias("text"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    at = lambda i: [F.col("words")[i + k] for k in range(WINDOW)]
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*at(i))))
    with_grams = split.select(
        "*", F.coalesce(grams, F.array().cast("array<long>")).alias("grams"))
    count = lambda c, test: F.size(F.filter(c, test)).cast("long")
    return with_grams.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        # Short texts may have no function word at all.
        F.greatest(F.size("words") - 30, F.lit(0)).cast("long").alias("n_words_past_30"),
        length_without(F.col("text"), f"[{SPACE}]+").alias("word_chars"),
        length_without(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), covered(F.col("grams"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        count(F.col("words"), lambda w: w.rlike(r"\p{L}")).alias("n_alpha_words"),
        count(F.col("words"), lambda w: F.lower(w).isin(STOP_WORDS)).alias("n_stop_words"),
        count(F.col("lines"), lambda l: l.rlike(rf"(\.\.\.|…)[{SPACE}]*$")).alias("n_ellipsis_lines"),
        count(F.col("lines"), lambda l: l.rlike(rf"^[{SPACE}]*[-*•]")).alias("n_bullet_lines"),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one condition; a denominator of 0 passes."""
    passed = F.lit(True)
    for _, part, whole, least, most in rules:
        if least is not None:
            passed &= 100 * F.col(part) >= least * F.col(whole)
        if most is not None:
            passed &= 100 * F.col(part) <= most * F.col(whole)
    return passed


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """measures plus base_failed, the first failed rule (null if none) and kept."""
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = F.coalesce(*[F.when(~verdict([r]), r[0]) for r in rules])
    return measures(docs).select("*", base.alias("base_failed"), failed.alias("failed_rule"), (~base & verdict(rules)).alias("kept"))


def sql(rules=RULES) -> str:
    """The same in DuckDB SQL, from the same table."""
    space = r"\x20\x09-\x0D"
    tests = [f"100 * {p} >= {lo} * {w}" for _, p, w, lo, _ in rules if lo is not None]
    tests += [f"100 * {p} <= {hi} * {w}" for _, p, w, _, hi in rules if hi is not None]
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, regexp_extract_all(text, '[^{space}]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines FROM t
), w AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM s
), g AS (
  SELECT r, i, array_agg(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS gram FROM w
), d AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE len(gram) = {WINDOW}
), c AS (
  SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS n FROM d WHERE n > 1
), rep AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM c GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, greatest(len(words) - 30, 0) AS n_words_past_30,
    CAST(length(regexp_replace(text, '[{space}]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
    len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{space}]*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[{space}]*[-*•]'))) AS n_bullet_lines
  FROM s LEFT JOIN rep USING (r)
), v AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM v"""


@query("op8_quality_rules", sql())
def op8_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
