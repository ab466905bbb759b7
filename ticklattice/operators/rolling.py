"""Rolling operators by prefix sums: their cost does not follow the window's length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column], n: int) -> DataFrame:
    """df with the sum of each expression over the last n rows (null counts as 0): the running sum less that of n rows ago."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({f"__{k}": F.sum(F.coalesce(c, F.lit(0))).over(w) for k, c in columns.items()})
    out = out.withColumns({k: F.col(f"__{k}") - F.coalesce(F.lag(f"__{k}", n).over(w), F.lit(0)) for k in columns})
    return out.drop(*[f"__{k}" for k in columns])


def zscores(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], n: int) -> DataFrame:
    """Each column as a z-score over the last n rows, the current one included, with the population variance of the values
    that are not null; where it is not positive the deviation counts as 1.

    Sums run over blocks of n rows, of values less their key's mean, so that no more than 2 n of them meet in a sum: what of a
    window lies in the block before is that block's total less its own running sum. A variance below 1e-12 of the mean
    square is the sums' rounding, and counts as none."""
    w = Window.partitionBy(*keys).orderBy(order)
    block = Window.partitionBy(*keys, "__b").orderBy(order)
    whole = Window.partitionBy(*keys)
    out = df.select(*keys, order, *columns, (F.row_number().over(w) - 1).alias("__i"), *[F.avg(c).over(whole).alias(f"__m_{c}") for c in columns])
    out = out.withColumn("__b", F.floor(F.col("__i") / n))
    parts: dict[str, Column] = {}
    for c in columns:
        x = F.col(c) - F.col(f"__m_{c}")
        parts |= {f"s_{c}": x, f"q_{c}": x * x, f"n_{c}": F.when(F.col(c).isNotNull(), 1.0)}
    out = out.withColumns({f"__{k}": F.sum(F.coalesce(v, F.lit(0.0))).over(block) for k, v in parts.items()})
    ago = lambda k: F.lag(f"__{k}", n).over(w)  # noqa: E731  the same place in the block before
    ends = out.withColumns({f"__t_{k}": F.last(F.when(F.col("__i") % n == n - 1, F.col(f"__{k}")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k in parts})
    out = ends.withColumns({k: F.col(f"__{k}") + F.when(F.col("__b") > 0, F.col(f"__t_{k}") - ago(k)).otherwise(0.0) for k in parts})

    def z(c: str) -> Column:
        mean = F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}"))
        square = F.try_divide(F.col(f"q_{c}"), F.col(f"n_{c}"))
        var = square - mean * mean
        return (F.col(c) - F.col(f"__m_{c}") - mean) / F.when(var > 1e-12 * square, F.sqrt(var)).otherwise(1.0)

    return out.select(*keys, order, *[z(c).alias(c) for c in columns])


def ema(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """df with exponential averages y = a x + (1 - a) y', y' = 0 at first (null x counts as 0): name -> (column, a).

    The recursion in closed form, by sums of x (1 - a)^-i over blocks so short that the powers stay below 1e100. Into a block
    comes the average at the end of the one before; what lies two blocks back has a weight under 1e-100."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("__i", F.row_number().over(w) - 1)
    for name, (c, a) in columns.items():
        size = max(1, int(230 / -math.log1p(-a))) if a < 1 else 1
        block, i = Window.partitionBy(*keys, "__b").orderBy(order), F.col("__i") % size
        out = out.withColumn("__b", F.floor(F.col("__i") / size))
        out = out.withColumn("__s", a * F.pow(F.lit(1 - a), i) * F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.pow(F.lit(1 - a), -i)).over(block) if a < 1 else F.coalesce(F.col(c), F.lit(0.0)))
        ends = F.last(F.when(i == size - 1, F.col("__s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(name, F.col("__s") + F.coalesce(ends, F.lit(0.0)) * F.pow(F.lit(1 - a), i + 1)).drop("__b", "__s")
    return out.drop("__i")


def ewm_seeded(df: DataFrame, keys: Sequence[str], order: str, column: str, n: int, a: float) -> Column:
    """For a column without nulls: the average v = a x + (1 - a) v' over the last n rows, seeded with the first of them, in terms
    of `__e`, the exponential average of the whole column (see with_ewm)."""
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w) - 1
    steps = F.least(i, F.lit(n - 1))
    first = F.coalesce(F.lag(column, n - 1).over(w), F.first(column).over(w))
    before = F.coalesce(F.lag("__e", n - 1).over(w), F.first("__e").over(w))
    return F.col("__e") + F.pow(F.lit(1 - a), steps) * (first - before)


def with_ewm(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str, n: int, a: float) -> DataFrame:
    """df with `name`, ewm_seeded of a column, at a cost that does not follow n."""
    out = ema(df, keys, order, {"__e": (column, a)})
    return out.withColumn(name, ewm_seeded(out, keys, order, column, n, a)).drop("__e")


def carried(c: str, w) -> Column:
    """The last value that is not null."""
    return F.last(c, ignorenulls=True).over(w)


def entropy(counts: Sequence[Column], total: Column) -> Column:
    """Shannon entropy in bits of counts that sum to total; 0 where there are none."""
    part = [F.when(c > 0, -(c / F.greatest(total, F.lit(1))) * F.log2(c / F.greatest(total, F.lit(1)))).otherwise(0.0) for c in counts]
    out = part[0]
    for p in part[1:]:
        out = out + p
    return F.when(total > 0, out).otherwise(0.0)
