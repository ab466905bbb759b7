"""The nineteen features of each instrument on a common grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.operators import book
from ticklattice.operators.rolling import carried, ema, entropy, rolling_sums, with_ewm, zscores
from ticklattice.params import FEATURES, Params


BOOK = book.BOOK


@dataclass
class Grid:
    """The grid numbers of each date: after its first event, and not after the shorter stream's last. `first` and `last` count
    snapshots, `first_sample` and `last_sample` samples; a row a date, made on the driver. `most` is the longest."""

    spans: DataFrame
    samples: DataFrame
    most: int

    @classmethod
    def of(cls, events: DataFrame, p: Params) -> Grid:
        per = book.dated(events).groupBy(*BOOK).agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).groupBy("date").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
        rows = [(r.date, r.lo // p.snapshot_us + 1, r.hi // p.snapshot_us) for r in per.collect()]  # a row a date
        kind = book.dated(events).schema["date"].dataType.simpleString()
        ratio, make = p.snapshot_us // p.sample_us, lambda x: events.sparkSession.createDataFrame(x, f"date {kind}, first long, last long")
        return cls(make(rows), make([(d, (a - 1) * ratio + 1, b * ratio) for d, a, b in rows]), max([(b - a + 1) * ratio for _, a, b in rows], default=1))

    def points(self, events: DataFrame) -> DataFrame:
        return self._points(events, self.spans)

    def sample_points(self, events: DataFrame) -> DataFrame:
        return self._points(events, self.samples)

    @staticmethod
    def _points(events: DataFrame, spans: DataFrame) -> DataFrame:
        books = book.dated(events).select(*BOOK).distinct().join(F.broadcast(spans), "date").where("first <= last")
        return books.select(*BOOK, F.explode(F.sequence("first", "last")).alias("g"))


def levels(events: DataFrame, p: Params, grid: Grid) -> book.Levels:
    """The book's levels on the sample grid, of which the snapshot grid is a part."""
    return book.Levels.of(book.versions(book.judge(events)), p.sample_us, grid.samples, grid.most, p.depth)


def trade_windows(events: DataFrame, n: int) -> DataFrame:
    """For each trade, over the last n: volumes by direction, count, direction sum, buys, and reversals within the window."""
    keys = [c for c in BOOK if c in events.columns]
    w = Window.partitionBy(*keys).orderBy("seq")
    t = events.where("action = 'T'").withColumn("dir", F.when(F.col("side") == "B", 1).otherwise(-1))
    t = t.withColumn("flip", F.when(F.col("dir") == -F.lag("dir").over(w), 1).otherwise(0))
    d = F.col("dir")
    t = rolling_sums(t, keys, ["seq"], {
        "buy": F.when(d > 0, F.col("size")), "sell": F.when(d < 0, F.col("size")), "n": F.lit(1), "net": d, "buys": F.when(d > 0, 1), "flips": F.col("flip"),
    }, n)
    # a reversal against a trade that has left the window does not count
    head = F.when(F.row_number().over(w) > n, F.lag("flip", n - 1).over(w)).otherwise(0)
    return t.withColumn("flips", F.col("flips") - F.coalesce(head, F.lit(0)))


def sample_windows(best: DataFrame, points: DataFrame, p: Params) -> DataFrame:
    """For each sample time (number h): statistics of the rings of mid and spread, in price units, from the best prices at
    points (date, instrument, g)."""
    w = Window.partitionBy(*BOOK).orderBy("h")
    s = points.join(best, [*BOOK, "g"], "left").withColumnRenamed("g", "h")
    s = s.withColumns({"mid": F.col("mid") * p.tick, "spread": F.col("spread") * p.tick})
    s = s.withColumn("tick", F.coalesce(F.signum(F.col("mid") - F.lag("mid").over(w)), F.lit(0.0)))
    s = s.withColumn("r", F.log("mid") - F.log(F.lag("mid").over(w)))
    s = rolling_sums(s, BOOK, ["h"], {"ss": F.col("spread"), "sq": F.col("spread") ** 2, "sn": F.when(F.col("spread").isNotNull(), 1)}, p.ring)
    s = rolling_sums(s, BOOK, ["h"], {"ups": F.when(F.col("tick") > 0, 1), "downs": F.when(F.col("tick") < 0, 1), "ticks": F.lit(1)}, p.rolling)
    m = F.col("ss") / p.rolling
    vol = F.sqrt(F.greatest(F.lit(0.0), (F.col("sq") - 2 * m * F.col("ss") + F.col("sn") * m * m) / p.rolling))
    s = s.withColumn("spread_volatility", vol).withColumn(
        "tick_direction_entropy", entropy([F.col("ups"), F.col("downs"), F.col("ticks") - F.col("ups") - F.col("downs")], F.col("ticks"))
    )
    r2 = F.col("r") ** 2
    k = p.ring - 1
    # statistics of the returns there are, by their own count: a null return is no row of them
    there = F.col("r").isNotNull()
    keys = [*BOOK, "there"]
    s = s.withColumns({"there": there, "r2": r2})
    s = rolling_sums(s, keys, ["h"], {
        "n": F.lit(1), "q": r2, "qu": F.when(F.col("r") > 0, r2), "nu": F.when(F.col("r") > 0, 1), "qd": F.when(F.col("r") <= 0, r2), "nd": F.when(F.col("r") <= 0, 1),
    }, k)
    s = with_ewm(s, keys, "h", "r2", "ewm", k, 2.0 / (p.rolling + 1))
    u, d = F.coalesce(F.try_divide("qu", "nu"), F.lit(0.0)), F.coalesce(F.try_divide("qd", "nd"), F.lit(0.0))
    s = s.withColumns({
        "realized_variance": F.when(there, F.col("q") / F.greatest("n", F.lit(1))), "ewm_volatility": F.when(there, F.sqrt(F.greatest(F.col("ewm"), F.lit(0.0)))),
        "directional_volatility": F.when(there, F.when(u >= d, 1.0).otherwise(-1.0) * F.sqrt(F.abs(u - d))),
    })
    return s.select(*BOOK, "h", "spread_volatility", "tick_direction_entropy", *[F.coalesce(carried(c, w), F.lit(0.0)).alias(c) for c in ("realized_variance", "ewm_volatility", "directional_volatility")])


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def features(events: DataFrame, p: Params) -> DataFrame:
    """(date,) instrument, g, timestamp_ns (the grid time) and FEATURES; a side or trade that is absent gives null or 0 as each
    feature defines it. Everything is keyed by date, if events have one, and instrument: many dates are one job, and a key's
    rows move once for each window order."""
    grid, with_date = Grid.of(events, p), "date" in events.columns
    events = book.dated(events)
    ratio = p.snapshot_us // p.sample_us
    judged = book.judge(events)
    found = book.Levels.of(book.versions(judged), p.sample_us, grid.samples, grid.most, p.depth)
    points, hours = grid.points(events), grid.sample_points(events)
    arr = book.depth_arrays(found.top(points.withColumn("at", F.col("g") * ratio)), points, p.depth)
    samples = sample_windows(found.best(hours.withColumn("at", F.col("g"))), hours, p)
    w = Window.partitionBy(*BOOK).orderBy("g")
    spans = F.broadcast(grid.spans)
    bucket = F.greatest(F.floor(F.col("ts_us") / p.snapshot_us) + 1, F.col("first")).alias("g")
    per = judged.join(spans, "date").groupBy(*BOOK, bucket).agg(
        F.sum(F.when((F.col("action") == "A") & F.col("accepted"), 1).otherwise(0)).alias("adds"), F.max("ts_us").alias("last_us")
    )
    trades = trade_windows(events, p.rolling).join(spans, "date").select(*BOOK, bucket, F.struct("seq", "buy", "sell", "n", "net", "buys", "flips").alias("t")).groupBy(*BOOK, "g").agg(F.max("t").alias("t"))
    clock = events.join(spans, "date").groupBy("date", bucket).agg(F.max("ts_us").alias("clock_us"))
    x = (
        arr.join(per, [*BOOK, "g"], "left").join(trades, [*BOOK, "g"], "left").join(clock, ["date", "g"], "left")
        .withColumns({"t": carried("t", w), "last_us": carried("last_us", w), "clock_us": carried("clock_us", w), "adds": F.coalesce("adds", F.lit(0))})
        .withColumn("h", F.floor(F.col("clock_us") / p.sample_us))
        .join(samples, [*BOOK, "h"], "left")
    )
    price = lambda c: F.when(c > 0, c * p.tick)
    a0, b0 = price(F.col("ask_p")[0]), price(F.col("bid_p")[0])
    x = x.withColumns({"a0": a0, "b0": b0, "midprice": (a0 + b0) / 2, "buy": F.coalesce("t.buy", F.lit(0)), "sell": F.coalesce("t.sell", F.lit(0)), "tn": F.coalesce("t.n", F.lit(0))})
    at = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    ofi = _total(F.transform(at(p.depth), lambda i: F.exp(-p.ofi_decay * i) * (F.get("bid_d", i) * F.get("bid_s", i) - F.get("ask_d", i) * F.get("ask_s", i))))
    volume = F.col("buy") + F.col("sell")
    near = lambda s, sign, best: _total(F.transform(at(p.stress_levels), lambda i: F.when(
        F.get(f"{s}_s", i) >= p.stress_size, F.exp(-p.stress_decay * sign * (F.col(best) - F.get(f"{s}_p", i) * p.tick)) * F.get(f"{s}_s", i)).otherwise(0.0)))
    depth = {s: _total(F.transform(f"{s}_s", lambda v: v.cast("double"))) for s in ("bid", "ask")}
    slope = lambda s: F.coalesce(F.try_divide(_total(F.zip_with(
        f"{s}_p", f"{s}_s", lambda q, v: F.when(q > 0, F.abs(F.log("midprice") - F.log(F.when(q > 0, q * p.tick))) * v).otherwise(0.0))), depth[s]), F.lit(0.0))
    gap = lambda s: F.try_divide((F.get(f"{s}_p", F.lit(0)) * F.get(f"{s}_s", F.lit(0)) - F.get(f"{s}_p", F.lit(1)) * F.get(f"{s}_s", F.lit(1))) * p.tick, F.get(f"{s}_s", F.lit(0)) + F.get(f"{s}_s", F.lit(1)))  # noqa: E731, E501
    x = x.withColumns({
        "ofi_raw": F.when(volume > p.min_volume, ofi / F.greatest(volume, F.lit(1))).otherwise(0.0),
        "liq": near("bid", 1, "b0") + near("ask", -1, "a0"),
        "log_spread": F.log("a0") - F.log("b0"),
        "log_return": F.coalesce(F.log("midprice") - F.log(F.lag("midprice", p.return_lag + 1).over(w)), F.lit(0.0)),
        "signed_volume_pressure": F.coalesce(F.try_divide(F.col("buy") - F.col("sell"), volume), F.lit(0.0)),
        "order_arrival_rate": F.coalesce(F.try_divide(F.col("adds").cast("double"), (F.col("last_us") - F.lag("last_us").over(w)) / 1e6), F.lit(0.0)),
        "market_depth": depth["bid"] + depth["ask"],
        "depth_imbalance": F.coalesce(F.try_divide(depth["bid"] - depth["ask"], depth["bid"] + depth["ask"]), F.lit(0.0)),
        "lob_slope": slope("bid") + slope("ask"),
        "price_gap": gap("bid") + gap("ask"),
        "reversal_rate": F.when(F.col("tn") > 1, F.col("t.flips") / F.greatest("tn", F.lit(1))).otherwise(0.0),
        "aggressor_bias": F.try_divide("t.net", "t.n"),
        "shannon_entropy": entropy([F.coalesce("t.buys", F.lit(0)), F.col("tn") - F.coalesce("t.buys", F.lit(0))], F.col("tn")),
    })
    was = F.lag("liq").over(w)
    x = x.withColumn("stress_raw", F.when(was > 0, -(F.col("liq") - was) / was).otherwise(0.0))
    keep = [f for f in FEATURES if f not in ("ofi", "liquidity_stress")]
    x = x.select(*BOOK, "g", *[F.col(f).cast("double").alias(f) for f in keep], F.col("ofi_raw").cast("double"), F.col("stress_raw").cast("double"))
    x = ema(x, BOOK, "g", {"ofi": ("ofi_raw", p.ofi_alpha), "liquidity_stress": ("stress_raw", p.stress_alpha)})
    return x.select(*(BOOK if with_date else BOOK[1:]), "g", (F.col("g") * p.snapshot_us * 1000).alias("timestamp_ns"), *FEATURES)


def normalised(raw: DataFrame, n: int) -> DataFrame:
    return zscores(raw, [c for c in BOOK if c in raw.columns], "g", FEATURES, n)
