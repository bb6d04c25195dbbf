"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The older type of stored times has no statistics, so no filter on a time could skip files.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # A generated method above 8000 bytes is never compiled by the JVM and runs interpreted; such a
    # stage is better run operator by operator, whose methods are split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators assume. Partition counts and sizes are left to the cluster.

    A local session without ``spark.checkpoint.dir`` (a test) gets a folder of this machine; elsewhere the setting must
    be made.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if not checkpoint_dir(spark) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="auditweave-"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables and stream checkpoints, under ``spark.checkpoint.dir``."""
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
