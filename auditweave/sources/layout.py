"""Tables laid out by several columns at once, so that a filter on any one of them skips most files.

Each column's values are cut into ranges of about equally many rows, and rows are ordered by the interleaved bits of
their range numbers. A file then holds a small range of every column, and the statistics that Parquet keeps for files
and row groups let ``scan_events`` and ``scan_audit`` leave out the others.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 10_000


def range_cuts(df: DataFrame, columns: Sequence[str], bits: int, rows: int = SAMPLE_ROWS) -> dict[str, list]:
    """2^bits - 1 ordered cuts per column (none without values), from a random sample of at most ``rows`` rows.

    The cuts only say where rows are put; no result depends on them. A frequent value is several cuts, so range numbers
    stay shares of the rows and each of their bits halves the table.
    """
    sample = df.select(*columns).orderBy(F.rand(17)).limit(rows).collect()
    cuts = {}
    for i, column in enumerate(columns):
        values = sorted(r[i] for r in sample if r[i] is not None)
        cuts[column] = [values[len(values) * n // 2**bits] for n in range(1, 2**bits)] if values else []
    return cuts


def range_number(column: str, cuts: list) -> Column:
    """How many cuts are not above the value; 0 for null. A binary search over the ordered cuts."""
    if not cuts:
        return F.lit(0)
    ordered = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(2**b) for b in reversed(range(len(cuts).bit_length()))])
    passed = lambda n, step: F.get(ordered, n + step - 1) <= F.col(column)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(passed(n, step), n + step).otherwise(n))


def interleaved(numbers: Sequence[Column], bits: int) -> Column:
    """The bits of all numbers in turn, highest first, as one long.

    The bits of a number are looked up spread out, all at once, so that each number is computed once.
    """
    key = F.lit(0).cast("long")
    for i, n in enumerate(numbers):
        place = lambda bit: bit * len(numbers) + len(numbers) - 1 - i
        spread = [sum((v >> bit & 1) << place(bit) for bit in range(bits)) for v in range(2**bits)]
        key = key + F.get(F.array(*[F.lit(v).cast("long") for v in spread]), n.bitwiseAND(F.lit(2**bits - 1)))
    return key


def write_clustered(
    df: DataFrame, path: str, columns: Sequence[str], bits: int = 6, files: int | None = None, mode: str = "append",
) -> None:
    """Write ``df`` to ``path`` clustered by ``columns`` (up to ``63 // bits`` of them), in about ``files`` files.

    Without ``files`` Spark chooses their number. Rows that agree in all these columns are told apart by a hash of the
    row, so any number of them is spread over tasks. Null values share the first range.
    """
    if not columns or len(columns) * bits > 63:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit a key")
    cuts = range_cuts(df, columns, bits)
    # columns of their own: a sort computes expressions again with every comparison
    cell, spread = "_cell", "_spread"
    while {cell, spread} & {c.lower() for c in df.columns}:
        cell, spread = cell + "_", spread + "_"
    keyed = df.select("*", interleaved([range_number(c, cuts[c]) for c in columns], bits).alias(cell), F.xxhash64(*df.columns).alias(spread))
    order = [cell, *columns, spread]
    laid = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    laid.sortWithinPartitions(cell, *columns).drop(cell, spread).write.mode(mode).parquet(path)
