"""Small event tables for the tests."""

import datetime as dt

from auditweave import schema as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def event(i, source, seconds, severity="info", event_type="tick", tenant=None, payload="{}", event_id=None, ingested=None):
    return (
        event_id or f"e{i:05d}", source, "synthetic", event_type, severity, at(seconds),
        at(seconds if ingested is None else ingested), payload, (None, None, "1.0.0", tenant),
    )


def make_events(spark, rows):
    return spark.createDataFrame(rows, S.EVENT)


def ids(df):
    return [r["event_id"] for r in df.collect()]
