"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Expected copies of a document are target / size of its source. Documents of a source are put in a fixed order, their
expected copies are summed up along it, one offset per source is added, and a document is taken once for every integer
the running sum crosses. The order goes by size class first, so that every stretch of the order has documents of like
size and the words taken come near the target, not only the number of documents.

The position in that order is found without bringing a source together: rows are counted per (source, size class,
bucket of doc_id); running sums over these counts, in two levels of at most a few hundred rows, give each cell its
first position, and only the rows of one cell are ranked with each other.

Defined results: a null text has size 0; null sources are one source, last in order; null and repeated doc_ids are
ordinary rows (each row is taken on its own); an empty table gives an empty mix; a source without words takes nothing.
Columns of the input may have any names: the operators work on their own narrow columns and join back by position.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import WORD, cut, query, table

#: Most copies of one document, and most multiple of a source's size.
MOST = 3
#: doc_ids of one size class are spread over so many cells (power of 16, as hex digits of a hash).
BUCKET_DIGITS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Length in binary digits and the first five digits: classes about 6 % wide, in the order of sizes."""
    return F.concat(F.lpad(F.length(F.bin(size)).cast("string"), 2, "0"), F.substring(F.bin(size), 1, 5))


def bucket(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BUCKET_DIGITS)


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same on every run."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Weights 1, 2, 3, 1, ... go by the code points of the source, null last. A target is the weight's share of all
    sizes, at most MOST times the source's size; the excess is shared again by weight. That is a common level
    (target = level * weight) for the sources below their bound: sources are walked in the order of bound / weight and
    stop at their bound while the level of the rest is above it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    walked = (
        weighed.withColumn("bound", MOST * F.col("source_size"))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("bounded", F.col("bound") * F.col("rest_weight") <= F.col("weight") * F.col("rest"))
    )
    # The first source that is not bounded has the level of all that follow.
    in_order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(~F.col("bounded"), F.col("rest") / F.col("rest_weight")), ignorenulls=True).over(in_order)
    return walked.select(
        "source", "source_size",
        F.when(F.col("bounded"), F.col("bound").cast("double")).otherwise(F.col("weight") * level).alias("target"),
    )


def mix(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size) -> with source_size, target and copies (0 to MOST), one row per input row."""
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.select("doc_id", "source", "size", key.alias("g"), size_class(F.col("size")).alias("class"), bucket(F.col("doc_id")).alias("bucket"))
    cells = rows.groupBy("g", "class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    cells = cut(cells, "mix-cells")
    classes = cells.groupBy("g", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    source_sizes = classes.groupBy("g").agg(F.sum("words").alias("source_size")).select(
        F.when(~F.col("g.none"), F.col("g.name")).alias("source"), "source_size")
    per_source = targets(source_sizes).select(key.alias("g"), "source_size", "target")
    by_class = Window.partitionBy("g").orderBy("class")
    by_bucket = Window.partitionBy("g", "class").orderBy("bucket")
    run = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    class_start = classes.withColumn("class_start", run(by_class)).select("g", "class", "class_start").join(per_source, "g")
    starts = cells.withColumn("cell_start", run(by_bucket)).join(class_start, ["g", "class"]).select(
        "g", "class", "bucket", (F.col("class_start") + F.col("cell_start")).alias("start"), "source_size", "target")
    in_cell = Window.partitionBy("g", "class", "bucket").orderBy("size", "doc_id")
    placed = rows.withColumn("place", F.row_number().over(in_cell)).join(starts, ["g", "class", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    place = F.col("start") + F.col("place")
    crossed = lambda k: F.floor(k * rate + offset(F.col("source"), seed))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.least(crossed(place) - crossed(place - 1), F.lit(MOST)).cast("int").alias("copies"),
    )


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns.

    Rows with one doc_id and one source share their text's fate only by their own size: copies are matched to rows by
    (doc_id, source, size) and their ordinal, so repeated rows are not multiplied.
    """
    # Columns of the input are carried as one struct: no name in it can clash with the names used here. The key is a
    # struct as well: structs with null fields are equal to each other, and window and join share its exchange.
    size = words(F.col("text"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct("doc_id", "source", size.alias("size")).alias("_key"),
        F.xxhash64("text").alias("_hash"),
    )
    rows = rows.withColumn("_ordinal", F.row_number().over(Window.partitionBy("_key").orderBy("_hash")))
    taken = mix(docs.select("doc_id", "source", size.alias("size")), seed).where("copies > 0").select(
        F.struct("doc_id", "source", "size").alias("_key"), "copies")
    taken = taken.withColumn("_ordinal", F.row_number().over(Window.partitionBy("_key").orderBy(F.col("copies").desc())))
    repeated = rows.join(taken, ["_key", "_ordinal"]).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return repeated.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS bound FROM sizes
), walked AS (
  SELECT *, bound / weight AS ratio,
    (SELECT sum(source_size) FROM sizes) - coalesce(sum(bound) OVER w, 0) AS rest,
    (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM weighed WINDOW w AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) AS level FROM walked
  WHERE NOT bound * rest_weight <= weight * rest ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN bound * rest_weight <= weight * rest THEN CAST(bound AS DOUBLE)
    ELSE CAST(weight AS DOUBLE) * (SELECT level FROM level) END AS target FROM walked
), ordered AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY lpad(CAST(length(bin(s.size)) AS VARCHAR), 2, '0') || left(bin(s.size), 5),
      left(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 2), s.size, s.doc_id NULLS FIRST) AS place,
    CASE WHEN t.source_size > 0 THEN least(t.target / CAST(t.source_size AS DOUBLE), 3.0::DOUBLE) ELSE 0::DOUBLE END AS rate,
    CAST(('0x' || left(md5('7:' || coalesce('s' || s.source, 'null')), 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(place * rate + off) - floor((place - 1) * rate + off), 3) AS BIGINT) * size AS taken
FROM ordered"""


@query("op7_mix_sources", SQL)
def op7_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
