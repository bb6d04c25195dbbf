"""Registry of the training-data queries, shared input handling and lineage cuts."""

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: One word of a text: everything between these white-space characters.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: Rows in one Arrow batch; texts may be long, so batches stay small.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.session.timeZone": "UTC"}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its SQL where plain SQL can say the same."""

    def register(fn):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; the setting is made here only for a local session without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read from there, so later jobs start from files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


_MEMORY: dict[str, Callable[[], object]] = {}


def worker_memory(name: str, forget: Callable[[], object] | None = None) -> None:
    """Say that this Python worker now works for operator ``name``: what it remembers for another one is forgotten.

    Workers outlive their tasks, so tables that speed one operator up would otherwise stay in memory under the next.
    """
    for other in [n for n in _MEMORY if n != name]:
        _MEMORY.pop(other)()
    if forget:
        _MEMORY[name] = forget


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with one output table per input batch; ``fn`` returns column name -> values."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(fn.__module__, getattr(sys.modules.get(fn.__module__), "forget", None))
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
