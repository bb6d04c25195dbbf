"""Domain packs stored as rows: instructions, operator roles and event types."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import schema as S
from auditweave.functions.columns import blank_to_null, present


def read_packs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(S.PACK).format(fmt).load(path)


def check_packs(packs: DataFrame) -> DataFrame:
    """Add ``reason``: a pack without an instruction is refused. An empty name falls back to the path."""
    return packs.withColumn("name", F.coalesce(blank_to_null(F.col("name")), F.col("path"))).withColumn(
        "reason", F.when(~F.coalesce(present(F.col("instruction")), F.lit(False)), F.lit("missing instruction"))
    )


def pack_roles(packs: DataFrame) -> DataFrame:
    good = check_packs(packs).where(F.col("reason").isNull())
    return good.select(F.col("name").alias("pack"), F.explode("roles").alias("r")).select("pack", "r.*")


def pack_event_types(packs: DataFrame) -> DataFrame:
    good = check_packs(packs).where(F.col("reason").isNull())
    return good.select(F.col("name").alias("pack"), F.explode("event_types").alias("t")).select("pack", "t.*")


def pack_instructions(packs: DataFrame) -> DataFrame:
    return check_packs(packs).where(F.col("reason").isNull()).select(F.col("name").alias("pack"), "instruction")
