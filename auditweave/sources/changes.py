"""Row changes of databases, already landed as tables, as canonical events."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.columns import json_string, render_binary
from auditweave.operators.validate import metadata, new_events


def filter_tables(df: DataFrame, allow: Sequence[str], schema_col: str = "schema", table_col: str = "table") -> DataFrame:
    """Rows of allowed ``schema.table`` names, ignoring case; an empty list allows all."""
    if not allow:
        return df
    names = [a.strip().lower() for a in allow if a.strip()]
    return df.where(F.lower(F.concat_ws(".", F.col(schema_col), F.col(table_col))).isin(names))


def table_list(text: str) -> list[str]:
    """Names of a comma-separated allow-list."""
    return [t.strip() for t in text.split(",") if t.strip()]


def check_mysql_changes(changes: DataFrame) -> DataFrame:
    """Add ``reason`` for batches that cannot be mapped (an update with an odd number of rows)."""
    odd = (F.col("action") == "update") & (F.size("rows") % 2 != 0)
    return changes.withColumn("reason", F.when(odd, F.lit("update with odd row count")))


def rendered_row(values: Column) -> Column:
    """JSON array of a row's binary values; nulls stay."""
    return F.to_json(F.transform(values, render_binary))


def normalize_mysql_changes(changes: DataFrame, source_id: Column, now: Column | None = None) -> DataFrame:
    """One event per changed row.

    ``changes``: schema, table, action, header_ts (seconds), log_file, log_pos, rows array<string>
    where each element is a row's values as a JSON array, or array<array<binary>> with the values as the
    database sent them, which are rendered as text or base64. Inserts carry ``row``, deletes ``before``,
    updates pair consecutive rows into ``before`` and ``after``. Unknown actions yield nothing.
    """
    good = check_mysql_changes(changes).where(F.col("reason").isNull())
    if dict(changes.dtypes)["rows"] == "array<array<binary>>":
        good = good.withColumn("rows", F.transform("rows", rendered_row))
    null = F.lit(None).cast("string")

    def one(before, after, row):
        return F.struct(before.alias("before"), after.alias("after"), row.alias("row"))

    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("rows") / 2).cast("int") - 1),
        lambda i: one(F.get("rows", 2 * i), F.get("rows", 2 * i + 1), null),
    )
    update = F.when(F.size("rows") >= 2, pairs)
    per_row = (
        F.when(F.col("action") == "insert", F.transform("rows", lambda r: one(null, null, r)))
        .when(F.col("action") == "delete", F.transform("rows", lambda r: one(r, null, null)))
        .when(F.col("action") == "update", update)
    )
    rows = good.select("*", F.posexplode(per_row).alias("ordinal", "change"))
    member = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), c)).otherwise("")
    payload = F.concat(
        F.lit('{"action":'), json_string(F.col("action")),
        member("after", F.col("change.after")),
        member("before", F.col("change.before")),
        F.lit(',"binlog":{"binlog_file":'), json_string(F.col("log_file")),
        F.lit(',"binlog_position":'), F.coalesce(F.col("log_pos").cast("string"), F.lit("null")), F.lit("}"),
        F.lit(',"database":'), json_string(F.col("schema")),
        member("row", F.col("change.row")),
        F.lit(',"table":'), json_string(F.col("table")), F.lit("}"),
    )
    at = F.current_timestamp() if now is None else now
    return new_events(
        rows, source_id, F.lit("mysql_cdc"), F.concat(F.lit("mysql.row."), F.col("action")),
        F.when(F.col("action") == "delete", "warn").otherwise("info"), payload,
        timestamp=F.when(F.col("header_ts") > 0, F.timestamp_seconds("header_ts")).otherwise(at),
        ingested_at=at, ordinal=F.concat_ws(":", "log_file", "log_pos", "ordinal"),
    )


def resolve_relations(changes: DataFrame, relations: DataFrame) -> DataFrame:
    """Attach the (schema, table) that a relation id had at the change; ids not yet described drop out.

    Each description holds from its own log position to the next one of the id.
    """
    following = Window.partitionBy("relation_id").orderBy("lsn")
    named = relations.groupBy("relation_id", "lsn").agg(F.max(F.struct("schema", "table")).alias("_rel"))
    versions = named.select("relation_id", F.col("lsn").alias("_from"), F.lead("lsn").over(following).alias("_to"), "_rel")
    held = (F.col("lsn") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("lsn") < F.col("_to")))
    return (
        changes.join(versions, "relation_id").where(held)
        .withColumn("schema", F.col("_rel.schema")).withColumn("table", F.col("_rel.table")).drop("_rel", "_from", "_to")
    )


def normalize_postgres_changes(changes: DataFrame, source_id: Column, now: Column | None = None) -> DataFrame:
    """One event per change: (op, schema, table, new_tuple, old_tuple as JSON text, lsn).

    Inserts carry the new tuple, updates the new tuple or else the old one, deletes the old one.
    """
    columns = (
        F.when(F.col("op") == "insert", F.col("new_tuple"))
        .when(F.col("op") == "update", F.coalesce("new_tuple", "old_tuple"))
        .when(F.col("op") == "delete", F.col("old_tuple"))
    )
    q = lambda c: json_string(F.col(c))
    payload = F.concat(
        F.lit("{"), F.when(columns.isNotNull(), F.concat(F.lit('"columns":'), columns, F.lit(","))).otherwise(""),
        F.lit('"op":'), q("op"), F.lit(',"schema":'), q("schema"), F.lit(',"table":'), q("table"), F.lit("}"),
    )
    return new_events(
        changes.where(F.col("op").isin("insert", "update", "delete")), source_id, F.lit("postgres_cdc"),
        F.lit("postgres.row_change"), F.lit("info"), payload,
        ingested_at=F.current_timestamp() if now is None else now, ordinal=F.col("lsn"),
        meta=metadata(ingestion_pod=F.lit("postgres-cdc")),
    )
