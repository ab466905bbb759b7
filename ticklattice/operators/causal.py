"""Dependence between two label or value series: transitions, likelihood ratio, conditional mutual information, Granger, unit root."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions.tails import adf_p, chi2_sf, f_sf


def lagged(pairs: DataFrame, delta: int) -> DataFrame:
    """cur and prev of series b and the value of series a delta steps back, for every t of a key k that has all three."""
    w = Window.partitionBy("k").orderBy("t")
    return pairs.select("k", "t", F.col("b").alias("cur"), F.lag("b").over(w).alias("prev"), F.lag("a", delta).over(w).alias("past")).where("prev is not null and past is not null")


def transitions(rows: DataFrame, *given: str) -> DataFrame:
    return rows.groupBy(*given, "cur").agg(F.count(F.lit(1)).alias("n"))


def log_likelihood(counts: DataFrame, *given: str) -> Column | DataFrame:
    """Σ n ln(n / Σ n) over the transitions from the same given values: `ll`."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*given))).agg(F.sum(F.col("n") * F.log("p")).alias("ll"))


def likelihood_ratio(pairs: DataFrame, delta: int, states_a: int, states_b: int) -> DataFrame:
    """Whether a's past value tells of b's transition beyond b's own: both models on the same rows. stat, df, p_value."""
    rows = lagged(pairs, delta)
    base = log_likelihood(transitions(rows, "prev"), "prev").withColumnRenamed("ll", "ll0")
    full = log_likelihood(transitions(rows, "prev", "past"), "prev", "past").withColumnRenamed("ll", "ll1")
    df = (states_b - 1) * states_b * (states_a - 1)
    tail = F.pandas_udf(lambda s: s.map(lambda x: chi2_sf(x, df)), "double")
    out = base.crossJoin(full).select("ll0", "ll1", (2 * (F.col("ll1") - F.col("ll0"))).alias("stat"), F.lit(df).alias("df"))
    return out.withColumn("p_value", tail("stat"))


def conditional_mutual_information(pairs: DataFrame, lags: Sequence[int]) -> DataFrame:
    """lag, cmi: I(cur; past | prev) in nats, the past as many rows back. One pass counts all lags' contingency tables at once;
    the entropies come from those counts, states cubed a lag."""
    w = Window.partitionBy("k").orderBy("t")
    wide = pairs.select(F.col("b").alias("cur"), F.lag("b").over(w).alias("prev"), *[F.lag("a", d).over(w).alias(f"a{d}") for d in lags])
    past = F.explode(F.array(*[F.struct(F.lit(d).alias("lag"), F.col(f"a{d}").alias("past")) for d in lags]))
    rows = wide.select("cur", "prev", past.alias("x")).select("x.lag", "cur", "prev", "x.past").where("prev is not null and past is not null")
    n = rows.groupBy("lag", "cur", "prev", "past").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name, *cols in (("h_xy", "cur", "prev"), ("h_yz", "prev", "past"), ("h_y", "prev"), ("h_xyz", "cur", "prev", "past")):
        e = n.groupBy("lag", *cols).agg(F.sum("n").alias("n")).groupBy("lag").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name))
        out = e if out is None else out.join(e, "lag")
    return out.select("lag", (F.col("h_xy") + F.col("h_yz") - F.col("h_y") - F.col("h_xyz")).alias("cmi"))


def permutation_p(pairs: DataFrame, delta: int, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """cmi and the share of shuffled pasts that reach it. What a replicate needs is the counts of (cur, prev) and of past,
    of which there are few; each replicate is drawn from them apart, so no replicate shuffles the series itself."""
    rows = lagged(pairs, delta)
    table = rows.groupBy("cur", "prev", "past").agg(F.count(F.lit(1)).alias("n")).toPandas()  # states cubed at most
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def cmi(n: np.ndarray) -> float:  # cur, prev, past
        h = lambda x: -(p := x.ravel()[x.ravel() > 0] / x.sum()) @ np.log(p)
        return float(h(n.sum(2)) + h(n.sum(0)) - h(n.sum((0, 2))) - h(n))

    def tensor(t: pd.DataFrame) -> np.ndarray:
        codes = [pd.factorize(t[c], sort=True) for c in ("cur", "prev", "past")]
        n = np.zeros([len(u) for _, u in codes])
        np.add.at(n, tuple(c for c, _ in codes), t["n"].to_numpy())
        return n

    def draw(batches):
        n = tensor(shared.value)
        flat, margin = n.sum(2).ravel().astype(int), n.sum((0, 1)).astype(int)
        seen = cmi(n)
        for b in batches:
            for i in b["id"]:
                rng, left, out = np.random.default_rng([seed, int(i)]), margin.copy(), []
                for m in flat:  # without replacement: a random deal of the pasts to the (cur, prev) cells
                    got = rng.multivariate_hypergeometric(left, m)
                    left = left - got
                    out.append(got)
                yield pd.DataFrame({"cmi": [seen], "hit": [int(cmi(np.array(out).reshape(n.shape)) >= seen)]})

    reps = pairs.sparkSession.range(permutations).mapInPandas(draw, "cmi double, hit int")
    return reps.agg(F.max("cmi").alias("cmi"), ((F.sum("hit") + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("permutations"))


def moments(rows: DataFrame, columns: Sequence[str], part: str) -> dict[int, np.ndarray]:
    """For each value of `part` the sums of the products of a constant and the columns (nulls count as 0). Tasks sum up their
    own rows, so what is shuffled is one small matrix a task."""
    n = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in b.columns[1:])])
            of = b.column(0).to_numpy(zero_copy_only=False)
            for m in np.unique(of).tolist():
                own = x[of == m]
                sums[m] = sums.get(m, 0.0) + own.T @ own
        at = np.arange(n * n)
        for m, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, m), pa.int64()), pa.array(at, pa.int64()), pa.array(g.ravel())], names=["m", "at", "v"])

    typed = rows.select(F.col(part).cast("long").alias("m"), *[F.col(c).cast("double").alias(c) for c in columns])
    out: dict[int, np.ndarray] = {}
    for r in typed.mapInArrow(run, "m long, at long, v double").groupBy("m", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.m, np.zeros(n * n))[r.at] = r.v
    return {m: g.reshape(n, n) for m, g in out.items()}


def standard(series: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """k, t and the columns less their mean, over their deviation (0: 1), without rows that lack one; the deviations."""
    own = series.select("k", "t", *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    s = own.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    of = [(s[f"m{i}"] or 0.0, s[f"s{i}"] or 1.0) for i in range(len(columns))]
    return own.select("k", "t", *[((F.col(c) - m) / d).alias(c) for c, (m, d) in zip(columns, of, strict=True)]), [d for _, d in of]


def lag_moments(z: DataFrame, columns: Sequence[str], lags: int) -> dict[int, np.ndarray]:
    """moments of the columns' values 0 .. lags rows back within a key k, in the order (column, lag), for each number of rows
    there are before a row (`lags` stands for as many or more)."""
    w = Window.partitionBy("k").orderBy("t")
    back = [F.lag(c, i).over(w).alias(f"{c}_{i}") if i else F.col(c).alias(f"{c}_0") for c in columns for i in range(lags + 1)]
    rows = z.select(F.least(F.row_number().over(w) - 1, F.lit(lags)).alias("m"), *back)
    return moments(rows, [f"{c}_{i}" for c in columns for i in range(lags + 1)], "m")


def _ssr(g: np.ndarray, y: int, xs: Sequence[int]) -> float:
    """The squared residuals of column y by a constant (column 0) and the columns xs, of the sums of products g."""
    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
    xs, y = [x - 1 for x in xs], y - 1
    return float(c[y, y] - c[y, xs] @ np.linalg.lstsq(c[np.ix_(xs, xs)], c[xs, y], rcond=1e-12)[0])


def _f_test(g: np.ndarray, y: int, own: Sequence[int], more: Sequence[int], unit: float) -> tuple[float, float, float | None, float | None]:
    """Squared residuals without and with the columns `more`, F and its p-value (null if there are no residuals or degrees)."""
    small, big = _ssr(g, y, own), _ssr(g, y, [*own, *more])
    rest = float(g[0, 0]) - len(own) - len(more) - 1
    if big <= 1e-12 * max(g[y, y], 1e-300) or rest <= 0:
        return small * unit, big * unit, None, None
    f = (small - big) / len(more) / (big / rest)
    return small * unit, big * unit, f, f_sf(f, len(more), rest)


GRANGER = "lag int, ssr_restricted double, ssr_full double, f double, p_value double"


def granger(series: DataFrame, max_lag: int = 10) -> DataFrame:
    """Whether x helps to foretell y: the F test of two regressions for each lag, all from one pass over the standardised
    series; lags do not cross keys k. Too few rows for a lag give nulls, an empty series no rows."""
    z, (unit, _) = standard(series, ["y", "x"])
    return series.sparkSession.createDataFrame(_granger(lag_moments(z, ["y", "x"], max_lag), 0, 1, max_lag, unit**2), GRANGER)


def _granger(sums: dict[int, np.ndarray], y: int, x: int, max_lag: int, unit: float) -> list[tuple]:
    at = lambda c, i: 1 + c * (max_lag + 1) + i
    out = []
    for lag in range(1, max_lag + 1):
        whole = [g for m, g in sums.items() if m >= lag]
        if whole:
            own, more = ([at(c, i) for i in range(1, lag + 1)] for c in (y, x))
            out.append((lag, *_f_test(sum(whole), at(y, 0), own, more, unit)))
    return out


def granger_pairs(a: DataFrame, b: DataFrame, a_prefix: str, b_prefix: str, max_lag: int = 10, lead: int = 1) -> DataFrame:
    """direction (forward: a foretells b), cause, effect, lag, p_value for every pair of a column of a and one of b whose names
    begin with the prefixes, say posteriors. b's rows move up by `lead`, within a key k, before both meet at their (k, t);
    rows that lack one go. One pass over the joined series serves all pairs, lags and directions."""
    w = Window.partitionBy("k").orderBy("t")
    ours, theirs = select_prefix(a, a_prefix), select_prefix(b, b_prefix)
    moved = b.select("k", "t", *[F.lead(c, lead).over(w).alias(c) if lead else F.col(c) for c in theirs])
    z, _ = standard(a.select("k", "t", *ours).join(moved, ["k", "t"]), [*ours, *theirs])
    sums = lag_moments(z, [*ours, *theirs], max_lag)
    out = []
    for i, x in enumerate(ours):
        for j, y in enumerate(theirs, len(ours)):
            for direction, cause, effect, c, e in (("forward", x, y, i, j), ("backward", y, x, j, i)):
                out += [(direction, cause, effect, lag, p) for lag, _, _, _, p in _granger(sums, e, c, max_lag, 1.0)]
    return a.sparkSession.createDataFrame(out, "direction string, cause string, effect string, lag int, p_value double")


def select_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def strongest_pairs(pairs: DataFrame, lag: int = 1, n: int = 25) -> DataFrame:
    """The n pairs of each direction with the least p-values at a lag; failed tests go."""
    w = Window.partitionBy("direction").orderBy("p_value", "cause", "effect")
    found = pairs.where(F.col("p_value").isNotNull() & (F.col("lag") == lag))  # pairs of model columns: a few rows
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def adf(series: DataFrame, column: str = "y") -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: used_lag (0 or 1 lagged differences, by Akaike's criterion on the rows that
    have one), nobs, stat, p_value; nulls where the regression fails. Differences do not cross keys k."""
    z, _ = standard(series, [column])
    w = Window.partitionBy("k").orderBy("t")
    d = z.select("k", "t", F.lag(column).over(w).alias("l"), (F.col(column) - F.lag(column).over(w)).alias("d")).where("l is not null")
    rows = d.select("d", "l", F.lag("d").over(w).alias("d1"), F.when(F.lag("d").over(w).isNull(), 0).otherwise(1).alias("m"))
    sums = moments(rows, ["d", "l", "d1"], "m")
    both, out = sums.get(1), (None, None, None, None)
    if both is not None and both[0, 0] > 4:
        n = float(both[0, 0])
        ssr = [_ssr(both, 1, [2]), _ssr(both, 1, [2, 3])]
        used = int(min(ssr) > 0 and n * math.log(ssr[1]) + 2 < n * math.log(ssr[0]))
        g, xs = (both, [2, 3]) if used else (sum(sums.values()), [2])
        n, c = float(g[0, 0]), g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
        own = [x - 1 for x in xs]
        if np.linalg.cond(c[np.ix_(own, own)]) < 1e12 and (s2 := _ssr(g, 1, xs) / (n - len(xs) - 1)) > 0:
            inv = np.linalg.inv(c[np.ix_(own, own)])
            stat = float((inv @ c[own, 0])[0] / math.sqrt(s2 * inv[0, 0]))
            out = used, int(n), stat, adf_p(stat)
    return series.sparkSession.createDataFrame([out], "used_lag int, nobs long, stat double, p_value double")


def hayashi_yoshida(a: DataFrame, b: DataFrame, bin_us: int) -> DataFrame:
    """Covariance of two asynchronously observed prices (t, v): Σ of the products of changes whose intervals overlap. The
    interval join meets in time bins, and a pair counts in the bin where the later of the two begins."""

    def moves(x: DataFrame, n: str) -> DataFrame:
        w = Window.partitionBy("k").orderBy("t")
        m = x.select("k", F.lag("t").over(w).alias(f"{n}0"), F.col("t").alias(f"{n}1"), (F.col("v") - F.lag("v").over(w)).alias(f"{n}d")).where(f"{n}0 is not null and {n}0 < {n}1")
        return m.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{n}0") / bin_us), F.floor((F.col(f"{n}1") - 1) / bin_us))))

    j = moves(a, "a").join(moves(b, "b"), ["k", "bin"]).where("a0 < b1 and b0 < a1").where(F.floor(F.greatest("a0", "b0") / bin_us) == F.col("bin"))
    return j.groupBy("k").agg(F.sum(F.col("ad") * F.col("bd")).alias("covariance"), F.count(F.lit(1)).alias("overlaps"))
