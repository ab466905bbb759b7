"""Descriptive diagnostics of features and regime labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of centroids that may be broadcast.
MANY_LABELS = 10_000


def stacked(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """feature, value: a row for each column of each row."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keep, "x.*")


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, var_pop, var_samp, the largest first (a row a feature)."""
    return stacked(df, columns).groupBy("feature").agg(F.var_pop("value").alias("var_pop"), F.var_samp("value").alias("var_samp")).orderBy(F.col("var_pop").desc(), "feature")


def durations(labels: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """mean and median length of the runs of each regime (gaps and islands), within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.sum(F.when(F.col("regime").eqNullSafe(F.lag("regime").over(w)), 0).otherwise(1)).over(w)
    runs = labels.withColumn("island", island).groupBy(*keys, "island", "regime").agg(F.count(F.lit(1)).alias("duration"))
    return runs.groupBy("regime").agg(F.avg("duration").alias("mean_duration"), F.median("duration").alias("median_duration"), F.count(F.lit(1)).alias("runs"))


def regime_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table behind the heat map: rows and the mean of each column by regime."""
    return df.groupBy("regime").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in columns])


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation (0: 1, also if only rounding makes one); the figures come to the
    driver, two a column."""
    spread = lambda c: F.when(F.min(c) < F.max(c), F.stddev_pop(c))
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[spread(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in columns})


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as SQL has it: pairs with a null do not count, no pair at all gives null, and a column without
    spread NaN, where F.corr divides by zero. Least and largest decide about spread, as deviations of a constant may round."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    both = F.covar_pop(x, y)
    rho = F.coalesce(F.try_divide(F.try_divide(both, F.stddev_pop(x)), F.stddev_pop(y)), F.lit(float("nan")))
    return F.when(both.isNull(), F.lit(None)).when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), rho).otherwise(F.lit(float("nan")))


def autocorrelations(df: DataFrame, keys: Sequence[str], order: str, column: str, lags: int = 20, within: Sequence[str] = ()) -> DataFrame:
    """lag, rho for each key. Lags do not cross the columns `within` (say dates); their rows count together."""
    w = Window.partitionBy(*keys, *within).orderBy(order)
    past = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(column, k).over(w).cast("double").alias("y")) for k in range(1, lags + 1)])
    long = df.select(*keys, F.col(column).cast("double").alias("x"), past.alias("p")).select(*keys, "x", F.inline("p"))
    return long.groupBy(*keys, "lag").agg(correlation("x", "y").alias("rho"))


def series_summary(df: DataFrame, keys: Sequence[str], order: str, column: str, within: Sequence[str] = ()) -> DataFrame:
    """Lag-1 autocorrelation, deviation, deviation of the differences, coefficient of variation (null if the mean is 0), the
    highest autocorrelation first. Differences do not cross the columns `within`."""
    w = Window.partitionBy(*keys, *within).orderBy(order)
    x = df.select(*keys, F.col(column).cast("double").alias("x"), F.lag(column).over(w).cast("double").alias("y"))
    return x.groupBy(*keys).agg(
        correlation("x", "y").alias("rho1"), F.stddev_samp("x").alias("std"), F.stddev_samp(F.col("x") - F.col("y")).alias("delta_std"),
        F.try_divide(F.stddev_samp("x"), F.avg("x")).alias("coef_var"),
    ).orderBy(F.col("rho1").desc(), *keys)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, rho of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho")) for a, b in pairs])).alias("x")).select("x.*")


def cluster_scores(df: DataFrame, columns: Sequence[str], label: str = "regime") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores of labelled points: two passes of aggregates, one row a cluster on the way.
    The centroids are broadcast if there are MANY_LABELS at most, else joined by a shuffle."""
    k, cols = len(columns), [F.col(c).cast("double") for c in columns]
    cent = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c{i}") for i, c in enumerate(cols)])
    few = cent.select(label).limit(MANY_LABELS + 1).count() <= MANY_LABELS
    near = df.join(F.broadcast(cent) if few else cent, label)
    d2 = sum(((cols[i] - F.col(f"c{i}")) ** 2 for i in range(1, k)), (cols[0] - F.col("c0")) ** 2)
    inner = near.groupBy(label).agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s"))
    g = cent.join(inner, label)
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    g = g.withColumns({f"m{i}": F.sum(F.col("n") * F.col(f"c{i}")).over(every) / total for i in range(k)})
    between = F.col("n") * sum(((F.col(f"c{i}") - F.col(f"m{i}")) ** 2 for i in range(1, k)), (F.col("c0") - F.col("m0")) ** 2)
    ch = g.agg(F.sum(between).alias("b"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    ch = ch.select(F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))
    x, y = g.alias("x"), g.alias("y")
    apart = F.sqrt(sum(((F.col(f"x.c{i}") - F.col(f"y.c{i}")) ** 2 for i in range(1, k)), (F.col("x.c0") - F.col("y.c0")) ** 2))
    db = x.join(y, F.col(f"x.{label}") != F.col(f"y.{label}")).groupBy(F.col(f"x.{label}")).agg(F.max(F.try_divide(F.col("x.s") + F.col("y.s"), apart)).alias("r"))
    return ch.crossJoin(db.agg(F.avg("r").alias("davies_bouldin")))


def silhouette(df: DataFrame, columns: Sequence[str], label: str = "regime", sample: int = 20000) -> DataFrame:
    """Mean silhouette (Euclidean) of at most `sample` points, chosen by a hash of their values: the sample is the feature. It
    is broadcast and each block of it is held against all of it."""
    s = df.select(F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns]).orderBy(F.xxhash64(*columns, label), *columns).limit(sample)
    rows = s.toPandas()
    x, y = rows[list(columns)].to_numpy(float), rows["y"].to_numpy(int)
    shared = df.sparkSession.sparkContext.broadcast((x, y))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = shared.value
        kinds, at = np.unique(y, return_inverse=True)
        ones = np.eye(len(kinds))[at]
        n = ones.sum(0)
        for b in batches:
            for i in b["id"].to_numpy():
                d = np.sqrt(((x - x[i]) ** 2).sum(1)) @ ones
                own = at[i]
                a = d[own] / max(n[own] - 1, 1)
                rest = min((d[j] / n[j] for j in range(len(kinds)) if j != own), default=0.0)
                yield pd.DataFrame({"s": [(rest - a) / max(a, rest) if n[own] > 1 and max(a, rest) > 0 else 0.0]})

    return df.sparkSession.range(len(x)).mapInPandas(block, "s double").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("points"))


def distribution(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """The table behind histograms: feature, bin (0 .. bins - 1, of equal width from least to largest), low, rows. Nulls go."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))]).first()
    lows = {c: (ends[f"a_{c}"], ((ends[f"b_{c}"] or 0.0) - (ends[f"a_{c}"] or 0.0)) / bins or 1.0) for c in columns if ends[f"a_{c}"] is not None}
    low, step = (F.element_at(F.create_map(*[x for c, v in lows.items() for x in (F.lit(c), F.lit(v[i]))]), F.col("feature")) for i in (0, 1)) if lows else (F.lit(0.0), F.lit(1.0))
    x = stacked(df, columns).where("value is not null").withColumns({"low0": low, "step": step})
    x = x.withColumn("bin", F.least(F.floor((F.col("value") - F.col("low0")) / F.col("step")), F.lit(bins - 1)).cast("int"))
    return x.groupBy("feature", "bin").agg(F.first(F.col("low0") + F.col("bin") * F.col("step")).alias("low"), F.count(F.lit(1)).alias("rows"))


def label_counts(df: DataFrame, label: str = "regime") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def information_criteria(ll: float, n: int, states: int, dims: int) -> dict[str, float]:
    """AIC and BIC of a Gaussian hidden Markov model with full covariances."""
    p = states - 1 + states * (states - 1) + states * dims + states * dims * (dims + 1) // 2
    return {"aic": 2 * p - 2 * ll, "bic": p * float(np.log(n)) - 2 * ll, "parameters": p}
