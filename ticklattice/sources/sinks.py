"""Where results go: feature tables, labelled tables, metrics, reports, Granger tables, and any callable as a receiver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ticklattice.params import FEATURES, Params

METRICS = "regimes int, aic double, bic double, log_likelihood double, silhouette double, davies_bouldin double, calinski_harabasz double"


def counted(df: DataFrame, name: str = "records") -> tuple[DataFrame, Observation]:
    """df, and an observation whose `records` is the number of rows that went through it once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records")), seen


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first n events in replay order."""
    return events.orderBy("ts_us", "seq").limit(n)


def latest(table: DataFrame, n: int = 100, order: str = "timestamp_ns") -> DataFrame:
    """The last n rows."""
    return table.orderBy(F.col(order).desc()).limit(n)


def folder(path: str, p: Params) -> str:
    """path with a folder that names the parameters: the snapshot interval in seconds, the z-score window, the event window."""
    return f"{path.rstrip('/')}/output_Snapshot{p.snapshot_us / 1e6:.2f}_Window{p.zscore}_Events{p.rolling}"


def formatted(table: DataFrame) -> DataFrame:
    """The header's columns in their order, numbers with fifteen decimals and an exponent, as text."""
    return table.select("timestamp_ns", "instrument", *[F.format_string("%.15e", F.col(c).cast("double")).alias(c) for c in FEATURES])


def write_tables(raw: DataFrame, norm: DataFrame, path: str, p: Params, kind: str = "csv", exact: bool = False) -> str:
    """The raw and the normalised table under folder(path, p)/{raw,norm}, a folder for each date, if there are dates, and
    instrument; exact: as `formatted` writes numbers. Returns the folder."""
    base = folder(path, p)
    for name, table in (("raw", raw), ("norm", norm)):
        dates = ["date"] if "date" in table.columns else []
        own = [F.format_string("%.15e", F.col(c).cast("double")).alias(c) if exact else F.col(c) for c in FEATURES]
        out = table.select(*dates, F.col("instrument").alias("asset"), "timestamp_ns", "instrument", *own)
        out.write.mode("overwrite").option("header", True).partitionBy(*dates, "asset").format(kind).save(f"{base}/{name}")
    return base


def write_labelled(features: DataFrame, labels: DataFrame, keys: list[str], path: str, kind: str = "csv") -> None:
    """Every column of the features with the regime of its row."""
    features.join(labels.select(*keys, "regime"), keys).write.mode("overwrite").option("header", True).format(kind).save(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Rows of METRICS appended to one typed table, however many runs write to it."""
    metrics.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in METRICS.split(", ")]).write.mode("append").parquet(path)


def write_report(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """Each table under its name, in its own order, as one file: reports have a row a feature, regime or pair."""
    for name, t in tables.items():
        t.coalesce(1).write.mode("overwrite").option("header", True).format(kind).save(f"{path}/{name}")


def write_granger(pairs: DataFrame, path: str, kind: str = "csv") -> None:
    """Both directions' pairs, a folder each, by lag and p-value."""
    write_report({d: pairs.where(F.col("direction") == d).drop("direction").orderBy("lag", "p_value", "cause", "effect") for d in ("forward", "backward")}, path, kind)


def push(table: DataFrame, receive: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """Hands a table to a receiver: a stream each micro-batch with its number (the query is returned), a batch all at once as
    number 0. The receiver runs on the driver and works on the DataFrame, so nothing is collected here."""
    if not table.isStreaming:
        receive(table, 0)
        return None
    out = table.writeStream.foreachBatch(receive)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).trigger(availableNow=True).start()
