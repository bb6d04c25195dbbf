"""Source connector over landed change files, as a Spark data source with offsets.

A source system's log arrives as files below ``path``: one folder per split (a shard, a slot, a server), whose files are
never changed once they are there and whose names rise (``bin.000001``, ``segment=7/part-0``). The offset of a stream is
the newest file taken of each split and the number of files up to it; Spark keeps it in the query's checkpoint, so a
restarted query goes on behind the last committed batch, and a batch that failed is planned again from the same offsets.
Each group of ``filesPerPartition`` files is a partition of its own, read as a stream of lines.

A file that turns up at or before a split's offset would be passed over: planning raises instead. Splits may appear at any
time. Files and folders that begin with ``_`` or ``.`` are not looked at.

The driver and the executors must reach ``path`` through ``pyarrow.fs`` (local, HDFS, S3, GCS); only names pass through the
driver.
"""

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from auditweave.functions.columns import parse_json

#: split and file of a line, its number in the file, when the file landed, and the line.
ROW = "split string, file string, line long, landed_at timestamp, value string"
CHANGE = "schema string, table string, action string, header_ts long, log_file string, log_pos long, rows array<string>"
#: Lines of one Arrow batch.
BATCH = 10_000


@dataclass
class Files(InputPartition):
    split: str
    names: list[str]


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def landed(path: str) -> dict[str, list[str]]:
    """Names of the files of every split, in order."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = _open(path)
    root = root.rstrip("/")
    found: dict[str, list[str]] = {}
    for info in fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path[len(root) + 1:].split("/")
        if info.type == FileType.File and len(parts) > 1 and not any(p[0] in "_." for p in parts):
            found.setdefault(parts[0], []).append("/".join(parts[1:]))
    return {split: sorted(names) for split, names in sorted(found.items())}


def offset_of(files: dict[str, list[str]]) -> dict:
    return {split: {"file": names[-1], "files": len(names)} for split, names in files.items()}


def planned(files: dict[str, list[str]], start: dict, end: dict, per_partition: int) -> list[Files]:
    """Groups of the files behind ``start`` and up to ``end``."""
    out = []
    for split, to in end.items():
        since = start.get(split, {"file": "", "files": 0})
        names = [n for n in files.get(split, []) if n <= to["file"]]
        before = sum(n <= since["file"] for n in names)
        if before != since["files"] or len(names) != to["files"]:
            raise ValueError(f"files of split {split} do not fit its offset: {before} up to {since}, {len(names)} up to {to}")
        new = names[before:]
        out += [Files(split, new[i:i + per_partition]) for i in range(0, len(new), per_partition)]
    return out


def lines(path: str, part: Files | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # an empty plan is read as one partition without a description
        return
    fs, root = _open(path)
    for name in part.names:
        place = f"{root.rstrip('/')}/{part.split}/{name}"
        at = fs.get_file_info(place).mtime
        with fs.open_input_stream(place) as raw:
            held, first = [], 0
            for line in io.BufferedReader(raw, 1 << 20):
                held.append(line.rstrip(b"\r\n").decode(errors="replace"))
                if len(held) == BATCH:
                    yield _batch(part.split, name, first, at, held)
                    held, first = [], first + len(held)
            if held:
                yield _batch(part.split, name, first, at, held)


def _batch(split: str, name: str, first: int, at, values: list[str]) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([
        pa.array([split] * n), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()),
        pa.array([at] * n, pa.timestamp("us", "UTC")), pa.array(values)], names=["split", "file", "line", "landed_at", "value"])


class _Reader:
    def __init__(self, options: dict):
        self.path, self.per_partition = options["path"], int(options.get("filesPerPartition", 1))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return lines(self.path, partition)


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        files = landed(self.path)
        return planned(files, {}, offset_of(files), self.per_partition)


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return offset_of(landed(self.path))

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return planned(landed(self.path), start, end, self.per_partition)


class ChangeLogSource(DataSource):
    """Format ``change_log``: lines of the landed files below ``path``, as a table or a stream."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def read_change_log(spark: SparkSession, path: str, stream: bool = False, files_per_partition: int = 1) -> DataFrame:
    """Lines of a change log with their place (see ROW)."""
    spark.dataSource.register(ChangeLogSource)
    reader = (spark.readStream if stream else spark.read).format("change_log")
    return reader.option("filesPerPartition", files_per_partition).load(path)


def decode_changes(log: DataFrame) -> DataFrame:
    """Row changes of the lines, as ``normalize_mysql_changes`` takes them, with ``reason`` for undecodable lines."""
    parsed = parse_json(log, "value", CHANGE)
    return parsed.withColumn("reason", F.when(F.col("bad_json"), F.lit("bad json"))).drop("bad_json")


def connector_stats(query: StreamingQuery) -> dict:
    """Operational statistics of a running or finished connector query."""
    progress = [json.loads(p.json) for p in query.recentProgress]
    ends = [p["sources"][0]["endOffset"] for p in progress if p["sources"]]
    end = ends[-1] if ends and ends[-1] else {}
    return {
        "events_emitted": sum(p["numInputRows"] for p in progress), "errors_seen": int(query.exception() is not None),
        "last_event_at": max((p["timestamp"] for p in progress if p["numInputRows"]), default=None),
        "healthy": query.exception() is None, "offsets": json.loads(end) if isinstance(end, str) else end,
    }
