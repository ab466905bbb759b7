"""Helpers that the training-data operators share: Arrow maps over a text column, shared-folder tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "__tl_text"
#: Bytes of text that one call of a text function gets at most (a single longer text still goes as one).
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master it may be unset; then it is set here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = Path(tempfile.mkdtemp(prefix="ticklattice-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def as_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/ticklattice/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a computation needs for a while: written like as_table, and deleted by drop() or clear() once no later step
    reads them, so that the shared folder does not grow with the number of rounds."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/ticklattice/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                _, path = self.paths.pop(id(t))
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        self.drop(*[t for t, _ in self.paths.values()])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_asset(path: str) -> bytes:
    """A vocabulary file (a few MB), read once on the driver and broadcast, so that executors need no copy on their disks."""
    return Path(urlparse(path).path).read_bytes()


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices that hold about `limit` bytes of that column's text."""
    col = batch.column(column)
    if col.nbytes <= limit or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), column, limit)
    yield from slices(batch.slice(half), column, limit)


def map_text(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    factory: Callable[[], Callable[[list[str]], Sequence[Sequence | pa.Array]]],
) -> DataFrame:
    """The columns `keep` of df, each row's with new columns computed from its whole text (null text: empty).

    factory() runs once a task and returns a function from a list of texts to one sequence a field. A kept column whose
    name equals a new field's (case ignored) is replaced by it. Narrow: no shuffle, a lost task is simply run again.
    """
    new = {n.lower() for n, _ in fields}
    keep = [c for c in keep if c.lower() not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(TEXT))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    types = [_arrow_type(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for big in batches:
            at = big.num_columns - 1
            for part in slices(big, at):
                if part.num_rows:
                    out = fn(part.column(at).to_pylist())
                    arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], *arrays], names=names)

    return src.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in t.fields])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(),
    }[type(t)]


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids whose CRC-32, taken of the id as text, is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of the graph with the undirected edges (u, v), by large-star and
    small-star rounds: a star of parents shrinks to its least node in a logarithmic number of rounds, and no round makes
    more rows than twice the edges. Each round is a table in the shared folder, so lineage stays short, and the one before
    is deleted; the only figures that come to the driver are a count and two sums.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.table(_down(edges.select(F.col("u"), F.col("v"))), "cc")
    seen = None
    while True:
        now = e.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = scratch.table(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, scratch.table(_down(small.unionByName(least.select("u", F.col("m").alias("v")))), "cc")
        scratch.drop(before, large)
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _down(e: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node; loops go."""
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
