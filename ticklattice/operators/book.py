"""Order books without replay: liveness, order versions, levels at grid times, top of book.

Everything is keyed by (date, instrument); events without a date column are one date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["instrument", "order_id"]
BOOK = ["date", "instrument"]


def dated(df: DataFrame) -> DataFrame:
    return df if "date" in df.columns else df.withColumn("date", F.lit(0))


def _order_key(df: DataFrame) -> list[str]:
    return [c for c in ("date", *KEY, "epoch") if c in df.columns]


def judge(events: DataFrame, clear_on_r: bool = False) -> DataFrame:
    """events with `accepted`: an add of an order that isn't live, a modification or cancellation of one that is. An order is
    live exactly if its last earlier add or cancellation is an add, so no state is carried. Trades and others: true.

    A clear (action R) does nothing, unless clear_on_r: then it closes all orders of its book, which begins a new epoch.
    """
    if clear_on_r:
        book = Window.partitionBy(*[c for c in BOOK if c in events.columns]).orderBy("seq")
        clears = F.when(F.col("action") == "R", F.col("ts_us"))
        events = events.withColumns({"epoch": F.count(clears).over(book), "closed_us": F.min(clears).over(book.rowsBetween(1, Window.unboundedFollowing))})
    before = Window.partitionBy(*_order_key(events)).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("action").isin("A", "C"), F.col("action")), ignorenulls=True).over(before)
    live = F.coalesce(last == "A", F.lit(False))
    return events.withColumn("accepted", F.when(F.col("action") == "A", ~live).when(F.col("action").isin("M", "C"), live).otherwise(True))


def versions(judged: DataFrame) -> DataFrame:
    """Order versions: what an accepted add or modification opens and the next accepted event of the order closes. A
    modification keeps the side of its add, every side but B is the ask; a cancellation removes the whole order."""
    own = judged.where("accepted and action in ('A', 'M', 'C')")
    w = Window.partitionBy(*_order_key(own)).orderBy("seq")
    side = F.last(F.when(F.col("action") == "A", F.when(F.col("side") == "B", "B").otherwise("A")), ignorenulls=True).over(w)
    end = F.lead("ts_us").over(w)
    end = F.coalesce(end, "closed_us") if "closed_us" in own.columns else end
    keys = [c for c in ("date", *KEY) if c in own.columns]
    return own.select(*keys, "seq", "action", side.alias("side"), "price_ticks", "size", F.col("ts_us").alias("start_us"), end.alias("end_us")).where("action <> 'C'").drop("action")


def runs(vs: DataFrame, step: int, spans: DataFrame) -> DataFrame:
    """Σ size by level while it is unchanged, on the grid of times g * step and from events strictly earlier: g from and to.
    Versions become changes at the first grid time they are seen at, and changes of a level are summed up. spans has the
    first and last g of each date (a row a date)."""
    level = [*BOOK, "side", "price_ticks"]
    vs = dated(vs).join(F.broadcast(spans), "date")
    seen = lambda c: F.greatest(F.floor(F.col(c) / step) + 1, F.col("first"))
    change = vs.select(*level, "last", seen("start_us").alias("g"), F.col("size").alias("d")).unionByName(
        vs.where("end_us is not null").select(*level, "last", seen("end_us").alias("g"), (-F.col("size")).alias("d"))
    )
    net = change.groupBy(*level, "last", "g").agg(F.sum("d").alias("d")).where("g <= last")
    w = Window.partitionBy(*level).orderBy("g")
    out = net.select(*level, "g", F.sum("d").over(w).alias("size"), F.coalesce(F.lead("g").over(w) - 1, F.col("last")).alias("to"))
    return out.where("size > 0 and g <= to")


def _rank(depth: int, *keys: str):
    return Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "B", -F.col("price_ticks")).otherwise(F.col("price_ticks")))


@dataclass
class Levels:
    """Runs of levels by dyadic blocks of the grid: a run is cut into at most two blocks of each size 2^k, each block keeps its
    best `depth` levels, and a grid time looks into the blocks that hold it. So rows follow runs and grid times by their
    logarithm; no level is laid out on the grid."""

    nodes: DataFrame
    spans: DataFrame
    sizes: int
    depth: int

    @classmethod
    def of(cls, vs: DataFrame, step: int, spans: DataFrame, length: int, depth: int) -> Levels:
        """length: the most grid times that a date has."""
        sizes = max(length, 1).bit_length()
        cut = runs(vs, step, spans).join(F.broadcast(spans), "date").selectExpr(*BOOK, "side", "price_ticks", "size", "g - first as l", "to + 1 - first as r")
        # the k-th block size: from the first block that begins within the run to the last that ends there
        at = "transform(sequence(0, {0}), k -> named_struct('k', k, 'a', shiftright(l + shiftleft(1L, k) - 1, k), 'b', shiftright(r, k)))".format(sizes)
        left = "filter({0}, x -> x.a < x.b and x.a % 2 = 1)".format(at)
        right = "filter({0}, x -> x.a < x.b and x.b % 2 = 1)".format(at)
        blocks = f"explode(concat(transform({left}, x -> named_struct('k', x.k, 'n', x.a)), transform({right}, x -> named_struct('k', x.k, 'n', x.b - 1)))) as x"
        cut = cut.selectExpr(*BOOK, "side", "price_ticks", "size", blocks).select(*BOOK, "side", "price_ticks", "size", "x.k", "x.n")
        return cls(cut.withColumn("o", F.row_number().over(_rank(depth, *BOOK, "k", "n"))).where(f"o <= {depth}"), spans, sizes, depth)

    def at(self, points: DataFrame, depth: int) -> DataFrame:
        """The nodes of the best `depth` levels that each of points (date, instrument, g, at: a time of the grid) is in."""
        seen = points.join(F.broadcast(self.spans), "date").selectExpr(*BOOK, "g", "at - first as x", f"explode(sequence(0, {self.sizes})) as k")
        return seen.selectExpr(*BOOK, "g", "k", "shiftright(x, k) as n").join(self.nodes.where(F.col("o") <= depth), [*BOOK, "k", "n"])

    def top(self, points: DataFrame) -> DataFrame:
        """The best levels of each side at points: level 0 is the highest bid, the lowest ask."""
        found = self.at(points, self.depth).withColumn("level", F.row_number().over(_rank(self.depth, *BOOK, "g")) - 1)
        return found.where(F.col("level") < self.depth).select(*BOOK, "g", "side", "level", "price_ticks", "size")

    def best(self, points: DataFrame) -> DataFrame:
        """Best bid and ask, mid and spread in ticks at points; null where a side is empty, no row where both are."""
        b = F.max(F.when(F.col("side") == "B", F.col("price_ticks")))
        a = F.min(F.when(F.col("side") == "A", F.col("price_ticks")))
        return self.at(points, 1).groupBy(*BOOK, "g").agg(b.alias("bid"), a.alias("ask")).withColumns(
            {"mid": (F.col("bid") + F.col("ask")) / 2, "spread": (F.col("ask") - F.col("bid")).cast("double")}
        )


def depth_arrays(top: DataFrame, grid: DataFrame, depth: int) -> DataFrame:
    """A row a grid point: arrays of price and size by level, zeros where there is no level, and the direction in which each
    level's size moved since the point before."""
    g = top.groupBy(*BOOK, "g").agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("level", c)))).alias(f"{n}_{x}") for s, n in (("B", "bid"), ("A", "ask")) for c, x in (("price_ticks", "p"), ("size", "s"))]
    )
    out = grid.join(g, [*BOOK, "g"], "left")
    w = Window.partitionBy(*BOOK).orderBy("g")
    levels = F.sequence(F.lit(0), F.lit(depth - 1))
    out = out.withColumns({f"{n}_{x}": F.transform(levels, _filled(f"{n}_{x}")) for n in ("bid", "ask") for x in ("p", "s")})
    none = F.array_repeat(F.lit(0).cast("long"), depth)
    move = lambda x, y: F.signum(x - y).cast("int")
    return out.withColumns({f"{n}_d": F.zip_with(F.col(f"{n}_s"), F.coalesce(F.lag(f"{n}_s").over(w), none), move) for n in ("bid", "ask")})


def _filled(m: str):
    return lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0))


def merged(events: DataFrame, first: str) -> DataFrame:
    """Both instruments in time order, ties by instrument (`first` first) then sequence, up to the time at which the shorter
    of the two ends on each date. position counts a date's rows from 0; the dates are sorted apart."""
    e = dated(events)
    ends = e.groupBy(*BOOK).agg(F.max("ts_us").alias("m")).groupBy("date").agg(F.min("m").alias("cap"))
    out = e.join(F.broadcast(ends), "date").where("ts_us <= cap").drop("cap").withColumn("rank", F.when(F.col("instrument") == first, 0).otherwise(1))
    out = out.withColumn("position", F.row_number().over(Window.partitionBy("date").orderBy("ts_us", "rank", "seq")) - 1)
    return out if "date" in events.columns else out.drop("date")


def until(events: DataFrame, stop_us: int) -> tuple[DataFrame, DataFrame]:
    """Replay up to a time: the events at stop_us or before it, and those that are still to come."""
    return events.where(F.col("ts_us") <= stop_us), events.where(F.col("ts_us") > stop_us)
