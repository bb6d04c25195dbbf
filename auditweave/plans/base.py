"""Query registry and the driver tables mapped onto canonical events."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.columns import micros, resolve_tenant
from auditweave.operators.validate import metadata
from auditweave.session import configure, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where plain SQL can say the same, its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """A derived table written once per session to the shared folder, as audit logs are stored in practice.

    Without ``write`` a table that is not there yet is only computed, for a caller that goes over it once and writes it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED and not write:
        return build()
    if key not in _STORED:
        path = shared_folder(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_events(raw: DataFrame) -> DataFrame:
    """The driver's events table as canonical events, with the extra columns n, value, tenant and day."""
    text = lambda c: F.col(c).cast("string")
    error, purchase, high = F.col("event_type") == "error", F.col("event_type") == "purchase", F.col("value") >= 50
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.lpad(text("event_id"), 12, "0").alias("event_id"),
        F.concat(F.lit("user-"), text("user_id")).alias("source_id"),
        F.lit("synthetic").alias("source_type"), "event_type",
        F.when(error & high, "critical").when(error, "error").when(purchase & high, "warn").otherwise("info").alias("severity"),
        ts.alias("timestamp"),
        F.timestamp_micros(micros(ts) + F.col("event_id") % 5 * 1_000_000).alias("ingested_at"),
        F.col("props").alias("payload"),
        metadata(
            ingestion_pod=F.concat(F.lit("pod-"), (F.col("user_id") % 3).cast("string")),
            tenant_id=F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")),
        ).alias("metadata"),
        F.col("event_id").alias("n"), "value",
    ).withColumn("tenant", resolve_tenant(F.col("metadata.tenant_id"))).withColumn(
        "day", F.to_date("timestamp").cast("string")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_events(table(spark, sf_dir, "events"))


EVENT_COLUMNS = [
    "event_id", "source_id", "source_type", "event_type", "severity", "timestamp", "ingested_at", "payload", "metadata"
]


def us(name: str, alias: str | None = None) -> Column:
    return micros(F.col(name)).alias(alias or "us")


def r9(name: str) -> Column:
    return F.round(F.col(name), 9).alias(name)


# The same mapping in SQL, as the first common table expression of most oracles.
EV = """ev AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
         'user-' || CAST(user_id AS VARCHAR) AS source_id,
         'synthetic' AS source_type, event_type,
         CASE WHEN event_type = 'error' AND value >= 50 THEN 'critical'
              WHEN event_type = 'error' THEN 'error'
              WHEN event_type = 'purchase' AND value >= 50 THEN 'warn'
              ELSE 'info' END AS severity,
         ts, epoch_us(ts) AS us, epoch_us(ts) + (event_id % 5) * 1000000 AS ingested_us,
         props AS payload, 'pod-' || CAST(user_id % 3 AS VARCHAR) AS pod,
         'tenant-' || CAST(user_id % 4 AS VARCHAR) AS tenant,
         strftime(ts, '%Y-%m-%d') AS day, event_id AS n, value
  FROM events)"""

RANK = ("CASE {c} WHEN 'info' THEN 0 WHEN 'warn' THEN 1 WHEN 'error' THEN 2 WHEN 'critical' THEN 3 ELSE -1 END")


def rank_sql(column: str = "severity") -> str:
    return RANK.format(c=column)


def rfc_sql(us_expr: str) -> str:
    text = f"strftime(make_timestamp({us_expr}), '%Y-%m-%dT%H:%M:%S.%f')"
    return f"regexp_replace({text}, '\\.?0+$', '') || 'Z'"


def with_ev(*parts: str, recursive: bool = False) -> str:
    """``WITH ev, <further tables> <select>``: all but the last part are common table expressions."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([EV, *parts[:-1]]) + "\n" + parts[-1]
