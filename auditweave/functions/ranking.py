"""Top-n, rank bands and row positions that never sort one whole group in one task.

Plain ``row_number()`` over a group puts the group in a single task. That is fine after a
group limit (Spark prunes each map task to n rows before the shuffle), but not for ranks
deep inside a large group. For those, rows are counted per ordered *cell* (a slice of the
order, e.g. one second of event time); running totals over the small count table give each
cell its offset, and only rows of one cell are ranked together.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = "_g"
SALTS = 64


def with_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add one group column for ``by``. A struct compares nulls as equal, so null groups survive joins."""
    return df.withColumn(GROUP, F.struct(*[F.col(c) for c in by]) if by else F.lit(0))


def expand_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Turn the group column of an aggregate back into the ``by`` columns."""
    cols = [F.col(f"{GROUP}.{c}").alias(c) for c in by]
    return df.select(*cols, *[c for c in df.columns if c != GROUP])


def group_limit_threshold(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None,
    salt_by: str = "event_id",
) -> DataFrame:
    """First ``n`` rows per key in ``order`` (which must be total).

    Up to the optimizer's group-limit threshold each map task keeps n rows per key before the
    shuffle. Beyond it, rows are first cut to n per (key, salt) so that no task sorts a whole key;
    the salt hashes a row identifier, so a recomputed task salts the same way.
    """
    rn = rank or "_rn"
    if keys and n > group_limit_threshold(df):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_pre", F.row_number().over(w)).where(F.col("_pre") <= n).drop("_pre", "_salt")
    if not keys:
        df = df.orderBy(*order).limit(n)
        if rank is None:
            return df
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank else out.drop(rn)


def time_cell(us: Column, cell_micros: int = 1_000_000) -> Column:
    return F.floor(us / cell_micros)


def hash_cell(hex_hash: Column) -> Column:
    """65 536 even cells in the order of a hex hash."""
    return F.conv(F.substring(hex_hash, 1, 4), 16, 10).cast("long")


def cell_offsets(df: DataFrame, keys: Sequence[str], cell: str, band: int = 4096) -> DataFrame:
    """(keys, cell) with rows in the cell, rows of the key before it and rows of the key.

    Running totals go in two levels, over bands of ``band`` cells and inside each band, so that no task walks
    through all cells of a key.
    """
    counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_in_cell")).withColumn("_band", F.floor(F.col(cell) / band))
    bands = counts.groupBy(*keys, "_band").agg(F.sum("_in_cell").alias("_in_band"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over_key = Window.partitionBy(*keys)
    bands = bands.select(
        *keys, "_band", earlier("_in_band", over_key.orderBy("_band")).alias("_band_before"), F.sum("_in_band").over(over_key).alias("_n")
    )
    inside = earlier("_in_cell", Window.partitionBy(*keys, "_band").orderBy(cell))
    return (
        counts.withColumn("_inside", inside).join(bands, [*keys, "_band"])
        .withColumn("_before", F.col("_band_before") + F.col("_inside")).drop("_band", "_band_before", "_inside")
    )


def rank_band(
    df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[Column], skip: Column, take: Column
) -> DataFrame:
    """Rows at positions skip+1 .. skip+take of each key in ascending ``order``.

    ``skip`` may use ``_n``, the rows of the key. ``cell`` must be monotone in ``order``. Cells that
    cannot touch the band are dropped before any row is ranked.
    """
    cells = (
        cell_offsets(df, keys, cell)
        .withColumn("_skip", skip)
        .withColumn("_take", take)
        .where((F.col("_before") < F.col("_skip") + F.col("_take")) & (F.col("_before") + F.col("_in_cell") > F.col("_skip")))
        .select(*keys, cell, "_before", "_skip", "_take")
    )
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    pos = F.col("_before") + F.row_number().over(w)
    return (
        df.join(cells, [*keys, cell])
        .withColumn("_pos", pos)
        .where((F.col("_pos") > F.col("_skip")) & (F.col("_pos") <= F.col("_skip") + F.col("_take")))
        .drop("_before", "_skip", "_take", "_pos")
    )


def positions(
    df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[Column], name: str, per_key: DataFrame | None = None
) -> DataFrame:
    """0-based position of every row within its key, exact and without one task per key.

    Columns of ``per_key`` (one row per key, not all keys needed) are attached on the way: they join the
    small table of cells, not the rows.
    """
    offsets = cell_offsets(df, keys, cell).select(*keys, cell, "_before")
    if per_key is not None:
        offsets = offsets.join(per_key, list(keys), "left")
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    out = df.join(offsets, [*keys, cell]).withColumn(name, F.col("_before") + F.row_number().over(w) - 1)
    return out.drop("_before")
