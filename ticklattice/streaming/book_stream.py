"""The order book as a stream: keyed state, clocks of event time, snapshots on a grid, late rows to a side output.

State is keyed by order, or by (date, instrument); a new date is a new key. A dead order, and a book, is forgotten once the
watermark, LATE behind the latest event, is KEEP past its clock. A row behind its key's clock comes out marked late; one
behind the watermark is dropped by Spark, which counts it.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticklattice.params import Params

LATE = "1 day"
#: Milliseconds that the watermark has to be past a key's clock before its state goes.
KEEP = 86_400_000
ORDER_STATE = "live boolean, side string, price_ticks long, size long, seq long, ts_us long"
LIVE_SCHEMA = "instrument string, order_id long, seq long, action string, accepted boolean, late boolean, side string, price_ticks long, size long"


def _forget_at(state: GroupState, clock_us: int) -> None:
    state.setTimeoutTimestamp(max(clock_us // 1000 + KEEP, state.getCurrentWatermarkMs() + 1))


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("__ts", F.timestamp_micros("ts_us")).withWatermark("__ts", LATE)


def track_orders(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state machine of one order: events come in any order within a micro-batch and are put in order of sequence; one
    behind what the order has already seen is late, and changes nothing."""
    columns = [c.split()[0] for c in LIVE_SCHEMA.split(", ")]
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=columns)
        return
    instrument, order_id = key
    live, side, price, size, last, clock = state.get if state.exists else (False, None, None, None, -1, 0)
    rows, out = pd.concat(list(batches)).sort_values("seq"), []
    for r in rows.itertuples():
        if r.seq <= last:
            out.append((instrument, order_id, r.seq, r.action, False, True, None, None, None))
            continue
        last, clock = r.seq, max(clock, int(r.ts_us))
        ok = not live if r.action == "A" else live
        if ok and r.action == "A":
            live, side, price, size = True, "B" if r.side == "B" else "A", r.price_ticks, r.size
        elif ok and r.action == "M":
            price, size = r.price_ticks, r.size
        elif ok:
            live = False
        out.append((instrument, order_id, r.seq, r.action, ok, False, side if ok else None, price if ok else None, size if ok else None))
    state.update((live, side, None if price is None else int(price), None if size is None else int(size), int(last), clock))
    if not live:  # only its clock is kept, for late rows
        _forget_at(state, clock)
    yield pd.DataFrame(out, columns=columns)


def live_orders(events: DataFrame) -> DataFrame:
    """A stream of judged adds, modifications and cancellations, keyed by instrument and order, so that state is spread over
    all tasks and no instrument is one task's."""
    own = _timed(events.where(F.col("action").isin("A", "M", "C")))
    return own.groupBy("instrument", "order_id").applyInPandasWithState(track_orders, LIVE_SCHEMA, ORDER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


@dataclass
class Book:
    """What a (date, instrument) carries from event to event: its clock, live orders, the trades of the rolling window, the
    returns of the ring, adds since the last snapshot, and the grid times that come next."""

    clock: tuple[int, int] = (-1, -1)
    orders: dict[int, tuple[str, int, int]] = field(default_factory=dict)
    trades: deque = field(default_factory=deque)
    returns: deque = field(default_factory=deque)
    mid: float | None = None
    adds: int = 0
    snapshot: int | None = None
    sample: int | None = None

    def best(self) -> tuple[int | None, int | None]:
        bids = [p for s, p, _ in self.orders.values() if s == "B"]
        asks = [p for s, p, _ in self.orders.values() if s != "B"]
        return max(bids, default=None), min(asks, default=None)

    def apply(self, r, p: Params) -> None:
        if r.action == "A" and r.order_id not in self.orders:
            self.orders[r.order_id] = ("B" if r.side == "B" else "A", int(r.price_ticks), int(r.size))
            self.adds += 1
        elif r.action == "M" and r.order_id in self.orders:
            self.orders[r.order_id] = (self.orders[r.order_id][0], int(r.price_ticks), int(r.size))
        elif r.action == "C":
            self.orders.pop(r.order_id, None)
        elif r.action == "T":
            self.trades.append((1 if r.side == "B" else -1) * int(r.size))
            if len(self.trades) > p.rolling:
                self.trades.popleft()

    def take_sample(self, p: Params) -> None:
        bid, ask = self.best()
        mid = None if bid is None or ask is None else (bid + ask) / 2
        if mid is not None and self.mid is not None:
            self.returns.append(math.log(mid) - math.log(self.mid))
            if len(self.returns) > p.ring - 1:
                self.returns.popleft()
        self.mid = mid

    def take_snapshot(self, g: int) -> tuple:
        bid, ask = self.best()
        buys = sum(x for x in self.trades if x > 0)
        sells = -sum(x for x in self.trades if x < 0)
        net = sum((x > 0) - (x < 0) for x in self.trades)
        rv = sum(x * x for x in self.returns) / len(self.returns) if self.returns else 0.0
        out = (g, bid, ask, buys, sells, len(self.trades), net, self.adds, rv, False, None)
        self.adds = 0
        return out

    def until(self, ts: int, p: Params) -> list[tuple]:
        """Takes the samples and snapshots due at ts or before it: they see the events strictly earlier than themselves."""
        out = []
        if self.snapshot is None:
            self.snapshot, self.sample = ts // p.snapshot_us + 1, ts // p.sample_us + 1
        while min(self.sample * p.sample_us, self.snapshot * p.snapshot_us) <= ts:
            if self.sample * p.sample_us <= self.snapshot * p.snapshot_us:
                self.take_sample(p)
                self.sample += 1
            else:
                out.append(self.take_snapshot(self.snapshot))
                self.snapshot += 1
        return out


SNAPSHOTS = "date string, instrument string, g long, bid long, ask long, buy long, sell long, trades long, net long, adds long, realized_variance double, late boolean, seq long"


def snapshots(events: DataFrame, p: Params) -> DataFrame:
    """A stream of book snapshots on the grid of p.snapshot_us, keyed by (date, instrument): a snapshot is due when the key's
    clock, its last event's time, reaches it, and so are the samples between. A row behind the clock changes nothing and
    comes out marked late, with its seq; select the two apart with split_late."""
    columns = [c.split()[0] for c in SNAPSHOTS.split(", ")]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        book = pickle.loads(state.get[0]) if state.exists else Book()
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts_us", "seq"]).itertuples():
            if (r.ts_us, r.seq) <= book.clock:
                out.append((None, None, None, None, None, None, None, None, None, True, r.seq))
                continue
            out += book.until(r.ts_us, p)
            book.apply(r, p)
            book.clock = (r.ts_us, r.seq)
        state.update((pickle.dumps(book),))
        _forget_at(state, book.clock[0])
        frame = pd.DataFrame([(*key, *x) for x in out], columns=columns)
        yield frame.astype({c: "Int64" for c in ("g", "bid", "ask", "buy", "sell", "trades", "net", "adds", "seq")})

    own = _timed(events.withColumn("date", F.col("date").cast("string") if "date" in events.columns else F.lit("")))
    return own.groupBy("date", "instrument").applyInPandasWithState(advance, SNAPSHOTS, "book binary", "append", GroupStateTimeout.EventTimeTimeout)


def split_late(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and late ones, of live_orders or snapshots."""
    return batch.where("not late").drop("late"), batch.where("late")


def write_split(stream: DataFrame, path: str, late_path: str, checkpoint: str):
    """Runs the stream over what there is: rows in time to path, late ones to late_path. Returns the query. A micro-batch that
    is run again after a failure overwrites its own folder, so nothing is written twice."""

    def both(batch: DataFrame, n: int) -> None:
        batch.persist()
        for part, where in zip(split_late(batch), (path, late_path), strict=True):
            part.write.mode("overwrite").parquet(f"{where}/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def aligned(base: DataFrame, future: DataFrame, p: Params, late: str = "1 minute") -> DataFrame:
    """The snapshots of two streams at the same grid time. Each side has its own watermark on the grid time, and the lesser of
    the two rules what state is dropped, so neither side runs ahead of the other."""

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.where("not late").select("date", F.col("g").alias(f"{name}_g"), *[F.col(c).alias(f"{name}_{c}") for c in ("bid", "ask", "buy", "sell")])
        return own.withColumn(f"{name}_ts", F.timestamp_micros(F.col(f"{name}_g") * p.snapshot_us)).withWatermark(f"{name}_ts", late)

    a, b = side(base, "base"), side(future, "future").withColumnRenamed("date", "other")
    return a.join(b, (F.col("date") == F.col("other")) & (F.col("base_ts") == F.col("future_ts"))).drop("other", "future_g", "future_ts").withColumnRenamed("base_g", "g")


def trade_bars(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Trades by instrument and time window, with a watermark: bars are final once it has passed them, later rows go."""
    t = events.where("action = 'T'").withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    d = F.when(F.col("side") == "B", F.col("size")).otherwise(-F.col("size"))
    return t.groupBy("instrument", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"), F.sum(d).alias("signed_volume"))
