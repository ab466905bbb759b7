"""A Spark data source for DBN files of market-by-order records, plain or compressed with Zstandard.

A file is one partition, read as a stream: a task holds a few MB of it, however long the day is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the file format
MAGIC, ZSTD_MAGIC = b"DBN", b"\x28\xb5\x2f\xfd"
MBO_TYPE = 0xA0
UNDEFINED_PRICE, UNDEFINED_TIME = 2**63 - 1, 2**64 - 1
RECORD = np.dtype([
    ("words", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8"), ("order_id", "<u8"),
    ("price", "<i8"), ("size", "<u4"), ("flags", "u1"), ("channel_id", "u1"), ("action", "S1"), ("side", "S1"), ("ts_recv", "<u8"),
    ("ts_in_delta", "<i4"), ("sequence", "<u4"),
])

SCHEMA = (
    "file string, seq long, ts_ns long, instrument string, instrument_id long, publisher_id int, action string, side string, "
    "order_id long, price_nanos long, size long, flags int, sequence long"
)
CHUNK = RECORD.itemsize << 16


def mbo_records(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(market-by-order records, their places among all records, number of all whole records, bytes that these take) of the
    start of data. Each record begins with its length in words of four bytes."""
    whole, width = np.frombuffer(data, np.uint8), RECORD.itemsize
    n = len(data) // width
    if not n or (whole[: n * width : width] != width // 4).any():
        n = 0
    starts, where = list(range(0, n * width, width)), n * width
    while where < len(data) and where + 4 * data[where] <= len(data):
        if data[where] < 4:
            raise ValueError("a record is shorter than its header")
        starts.append(where)
        where += 4 * data[where]
    begin = np.array(starts, np.int64)
    at = np.flatnonzero((whole[begin] == width // 4) & (whole[begin + 1] == MBO_TYPE)) if starts else np.zeros(0, np.int64)
    rows = whole[begin[at][:, None] + np.arange(width)].view(RECORD).ravel() if len(at) else np.zeros(0, RECORD)
    return rows, at, len(starts), where


def as_arrow(rows: np.ndarray, seq: np.ndarray, file: str, label: str | None) -> pa.RecordBatch:
    """The rows in the columns of SCHEMA; undefined prices and times are null, a label replaces the instrument's number."""
    n = len(rows)
    ids = rows["instrument_id"].astype(np.int64)
    text = lambda c: pa.array(c.astype("U1").tolist(), pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * n, pa.string()), pa.array(seq, pa.int64()), pa.array(rows["ts_recv"].astype(np.int64), mask=rows["ts_recv"] == UNDEFINED_TIME),
            pa.array([label] * n if label else ids.astype(str).tolist(), pa.string()), pa.array(ids), pa.array(rows["publisher_id"].astype(np.int32)),
            text(rows["action"]), text(rows["side"]), pa.array(rows["order_id"].astype(np.int64)),
            pa.array(rows["price"].astype(np.int64), mask=rows["price"] == UNDEFINED_PRICE), pa.array(rows["size"].astype(np.int64)),
            pa.array(rows["flags"].astype(np.int32)), pa.array(rows["sequence"].astype(np.int64)),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def batches(stream, file: str, label: str | None, chunk: int = CHUNK, strict: bool = True) -> Iterator[pa.RecordBatch]:
    """The records of an opened, decompressed file. ValueError where it is no such file or ends within a record; if not strict,
    what comes before the damage."""
    head = stream.read(8)
    if head[:3] != MAGIC or len(head) < 8:
        if strict:
            raise ValueError(f"{file} is no DBN file")
        return
    left = int.from_bytes(head[4:], "little")
    while left and (skipped := len(stream.read(min(left, chunk)))):
        left -= skipped
    rest, seq = b"", 0
    while more := stream.read(chunk):
        data = rest + more
        rows, at, n, used = mbo_records(data)
        if len(rows):
            yield as_arrow(rows, at + seq, file, label)
        seq, rest = seq + n, data[used:]
    if (rest or left) and strict:
        raise ValueError(f"{file} ends within a record")


@dataclass
class OneFile(InputPartition):
    file: str


class DbnReader(DataSourceReader):
    def __init__(self, path: str, label: str | None, strict: bool = True):
        self.path, self.label, self.strict = path, label, strict

    def _open(self, path: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri("file://" + path)

    def partitions(self) -> list[OneFile]:
        from pyarrow.fs import FileSelector, FileType

        fs, path = self._open(self.path)
        if "*" in path:
            found = [x.path for x in fs.get_file_info(FileSelector(path.rsplit("/", 1)[0])) if fnmatch(x.path, path)]
        elif (info := fs.get_file_info(path)).type == FileType.Directory:
            found = [x.path for x in fs.get_file_info(FileSelector(path, recursive=True)) if x.path.endswith((".dbn", ".dbn.zst"))]
        else:
            found = [path] if info.type == FileType.File else []
        if not found:
            raise FileNotFoundError(self.path)
        return [OneFile(x) for x in sorted(found)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open(self.path)
        with fs.open_input_stream(partition.file) as raw:
            begin = raw.read(4)
        with fs.open_input_stream(partition.file) as raw:
            if begin == ZSTD_MAGIC:
                import zstandard

                raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from batches(raw, partition.file, self.label, strict=self.strict)


class DbnSource(DataSource):
    """format("dbn"): path is a file, a folder or a pattern; option instrument labels all rows; option mode is FAILFAST (a
    damaged file fails the job) or PERMISSIVE (it gives the records before the damage)."""

    @classmethod
    def name(cls) -> str:
        return "dbn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DbnReader:
        return DbnReader(self.options["path"], self.options.get("instrument"), self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE")


def read_dbn(spark: SparkSession, path: str, instrument: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """The market-by-order records below path; of damaged files what can be read if the mode is PERMISSIVE. seq is a record's place in its file, records of other kinds counted."""
    spark.dataSource.register(DbnSource)
    reader = spark.read.format("dbn").option("mode", mode)
    return (reader.option("instrument", instrument) if instrument else reader).load(path)


def as_mbo(records: DataFrame, tick: float = 0.01) -> DataFrame:
    """Records of one file an instrument as order-book events (MBO_SCHEMA); records without a time go, a null price is zero.
    Prices are numbers of ticks, so prices between two ticks are rounded to the nearer: choose a tick that divides them."""
    return records.where("ts_ns IS NOT NULL").select(
        "seq", F.expr("ts_ns div 1000").alias("ts_us"), "instrument", "action", "side", "order_id",
        F.coalesce(F.round(F.col("price_nanos") / F.lit(tick * 1e9)).cast("long"), F.lit(0).cast("long")).alias("price_ticks"), "size",
    )
