"""python -m ticklattice DATES BASE FUTURE --source DIR --out DIR: the feature tables of two instruments, a folder for each date.

DATES are yyyyMMdd, separated by commas; all are one job. A date's events are read from DIR/INSTRUMENT/DATE*.dbn* or, with --kind
parquet, from DIR/date=DATE (columns of MBO_SCHEMA). Dates without events are reported, and so are those that fail when, after
a failure of the job, each is made alone; the others are still made, and the exit code is 1.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.operators.features import features, normalised
from ticklattice.params import Params
from ticklattice.sources.adapter import read_mbo, session_bounds, write_features
from ticklattice.sources.dbn import DbnReader, as_mbo, read_dbn


def read_dates(spark: SparkSession, source: str, dates: list[str], base: str, future: str, p: Params, kind: str) -> tuple[DataFrame | None, list[str]]:
    """The events of both instruments on those dates, with the date, and the dates that have none."""
    found, missing = [], []
    for date in dates:
        try:
            if kind == "dbn":
                both = []
                for name in (base, future):
                    path = f"{source}/{name}/{date}*.dbn*"
                    DbnReader(path, name).partitions()  # raises where there is no such file
                    both.append(as_mbo(read_dbn(spark, path, name), p.tick))
                found.append(both[0].unionByName(both[1]).withColumn("date", F.lit(date)))
            else:
                found.append(read_mbo(spark, f"{source}/date={date}").where(F.col("instrument").isin(base, future)).withColumn("date", F.lit(date)))
        except Exception as e:  # noqa: BLE001  the other dates do not depend on it
            missing.append(date)
            print(f"{date}: {e}", file=sys.stderr)
    return reduce(DataFrame.unionByName, found) if found else None, missing


def extract(events: DataFrame, p: Params, whole_day: bool = False) -> DataFrame:
    """The features of both instruments on each date, of its session alone unless whole_day; earlier events still build the book."""
    made = features(events, p)
    if whole_day:
        return made
    dates = session_bounds(events.select("date").distinct())
    return made.join(F.broadcast(dates), "date").where("timestamp_ns between start_ns and end_ns").drop("start_ns", "end_ns")  # a row a date


def main(args: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="ticklattice", description=__doc__)
    ask.add_argument("dates")
    ask.add_argument("base")
    ask.add_argument("future")
    ask.add_argument("--source", required=True)
    ask.add_argument("--out", required=True)
    ask.add_argument("--kind", choices=["dbn", "parquet"], default="dbn")
    ask.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ask.add_argument("--interval-ms", type=int, default=500)
    ask.add_argument("--whole-day", action="store_true")
    ask.add_argument("--normalised", help="a folder for the z-scores of the same tables")
    got = ask.parse_args(args)
    spark = SparkSession.builder.appName("ticklattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    p, dates = replace(Params(), snapshot_us=got.interval_ms * 1000), list(dict.fromkeys(got.dates.split(",")))

    def make(some: list[str]) -> list[str]:
        events, missing = read_dates(spark, got.source, some, got.base, got.future, p, got.kind)
        if events is not None:
            made = extract(events, p, got.whole_day)
            write_features(made, got.out, got.format)
            if got.normalised:
                write_features(normalised(made, p.zscore).withColumn("timestamp_ns", F.col("g") * p.snapshot_us * 1000), got.normalised, got.format)
        return missing

    try:
        failed = make(dates)
    except Exception as e:  # noqa: BLE001  one of them may be damaged: each alone
        if len(dates) == 1:
            print(f"{dates[0]}: {e}", file=sys.stderr)
            return 1
        failed = []
        for date in dates:
            try:
                failed += make([date])
            except Exception as e:  # noqa: BLE001
                failed.append(date)
                print(f"{date}: {e}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
