"""Market-by-order events: the adapter over the events table, and readers of stored events and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklattice.params import FEATURES

MBO_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("instrument", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("side", T.StringType()), T.StructField("order_id", T.LongType()),
    T.StructField("price_ticks", T.LongType()), T.StructField("size", T.LongType()),
])
FEATURE_SCHEMA = T.StructType(
    [T.StructField("timestamp_ns", T.LongType()), T.StructField("instrument", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mbo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as order-book events: two instruments, five event types as actions, users as orders."""
    e = table(spark, sf_dir, "events")
    bid = F.floor(F.col("user_id") / 2) % 2 == 0
    step = F.lit(25) * F.floor(F.col("value") / 10)
    return e.select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(F.col("user_id") % 2 == 0, "SPOT").otherwise("FUT").alias("instrument"),
        F.when(F.col("event_type").isin("signup", "view"), "A").when(F.col("event_type") == "purchase", "M")
        .when(F.col("event_type") == "error", "C").otherwise("T").alias("action"),
        F.when(bid, "B").otherwise("A").alias("side"),
        F.col("user_id").alias("order_id"),
        F.when(bid, F.lit(400000) - step).otherwise(F.lit(400025) + step).cast("long").alias("price_ticks"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("long") + 1).alias("size"),
    )


def read_mbo(spark: SparkSession, path: str) -> DataFrame:
    """Stored events, partitioned by date and instrument if they were written so; only records of the right kind."""
    df = spark.read.parquet(path)
    return df.where("rtype = 'MBO'") if "rtype" in df.columns else df


def read_features(spark: SparkSession, paths: list[str], corrupt: str | None = None) -> DataFrame:
    """Feature CSV files of several dates, one table with the date (yyyyMMdd) that a file's path has, else null; a path named
    twice is read once; the schema is never inferred. Lines that don't fit give nulls where they don't, and stand whole in the
    column `corrupt` if it is named."""
    schema = T.StructType([*FEATURE_SCHEMA.fields, *([T.StructField(corrupt, T.StringType())] if corrupt else [])])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader
    date = F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|[^0-9])((?:19|20)[0-9]{6})(?![0-9])", 1)
    return reader.csv(list(dict.fromkeys(paths)), header=True).withColumn("date", F.when(date != "", date))


def write_features(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The feature table in header order, a folder for each date, if there are dates, and instrument."""
    dates = ["date"] if "date" in df.columns else []
    out = df.select(*dates, F.col("instrument").alias("asset"), "timestamp_ns", "instrument", *FEATURES)
    out.write.mode("overwrite").partitionBy(*dates, "asset").option("header", True).format(kind).save(path)


def contract_filter(df: DataFrame, instrument: str, column: str, keep) -> DataFrame:
    """Without that instrument's rows of other contracts; the clock must be derived before."""
    return df.where(~((F.col("instrument") == instrument) & (F.col(column) != keep)))


def session_bounds(dates: DataFrame, start_us: int = 48_600_000_000, end_us: int = 72_000_000_000) -> DataFrame:
    """date (yyyyMMdd) with the session's first and last nanosecond; 13:30 to 20:00 by default."""
    day = F.unix_micros(F.to_timestamp("date", "yyyyMMdd"))
    return dates.select("date", ((day + start_us) * 1000).alias("start_ns"), ((day + end_us) * 1000).alias("end_ns"))
