"""The engine's queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklattice.operators import book, causal, diagnostics, features, hmm
from ticklattice.operators.rolling import ema, zscores
from ticklattice.params import DROPPED, FEATURES, MODEL, SPARSE
from ticklattice.plans import oracles, workflow
from ticklattice.sources import sinks
from ticklattice.sources.adapter import MBO_SCHEMA, contract_filter, mbo_events, session_bounds
from ticklattice.streaming import book_stream

ORACLES = oracles.ORACLES
P = SPARSE


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k (instrument), day, t (position within the day), regime, v and u of every event."""
    w = Window.partitionBy("k", "day").orderBy("seq")
    e = mbo_events(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / 86_400_000_000)).withColumnRenamed("instrument", "k")
    return e.select("k", "day", F.row_number().over(w).alias("t"), (F.col("order_id") % 3).cast("int").alias("regime"), F.col("price_ticks").cast("double").alias("v"), F.col("size").cast("double").alias("u"), "ts_us")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both instruments' series side by side, by position within a day (k)."""
    s = _series(spark, sf_dir)
    a, b = (s.where(F.col("k") == n) for n in ("SPOT", "FUT"))
    a = a.select("day", "t", F.col("regime").alias("a"), F.col("v").alias("x"))
    return a.join(b.select("day", "t", F.col("regime").alias("b"), F.col("v").alias("y")), ["day", "t"]).select(F.col("day").alias("k"), "t", "a", "b", "x", "y")


def q_mbo_events(spark, d):
    return mbo_events(spark, d)


def q_contract_filter(spark, d):
    e = mbo_events(spark, d).withColumn("contract", F.col("order_id") % 10)
    return contract_filter(e, "FUT", "contract", 3).groupBy("instrument", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))


def q_clock_audit(spark, d):
    day = F.floor(F.col("ts_us") / 86_400_000_000)
    w = Window.partitionBy("day").orderBy("seq")
    return mbo_events(spark, d).withColumn("day", day).withColumn("late", F.when(F.col("ts_us") < F.lag("ts_us").over(w), 1).otherwise(0)).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))


def q_session_bounds(spark, d):
    dates = mbo_events(spark, d).select(F.date_format(F.timestamp_micros("ts_us"), "yyyyMMdd").alias("date")).distinct()
    return session_bounds(dates)


def q_systematic_sample(spark, d):
    return _series(spark, d).where(F.col("t") % 50 == 1).select("k", "day", "t", "regime", "v")


def q_accepted_events(spark, d):
    return book.judge(mbo_events(spark, d)).select("seq", "instrument", "order_id", "action", "accepted")


def q_rejected_audit(spark, d):
    j = book.judge(mbo_events(spark, d))
    return j.where("action in ('A', 'M', 'C')").groupBy("instrument", "action").agg(F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("rejected"))


def q_unknown_orders(spark, d):
    """Modifications and cancellations of orders that no earlier add named."""
    e = mbo_events(spark, d)
    adds = e.where("action = 'A'").groupBy(*book.KEY).agg(F.min("seq").alias("first"))
    own = e.where("action in ('M', 'C')").join(adds, book.KEY, "left")
    return own.where("first is null or seq < first").select("seq", *book.KEY, "action")


def q_order_versions(spark, d):
    return book.versions(book.judge(mbo_events(spark, d))).select("seq", "instrument", "order_id", "side", "price_ticks", "size", "start_us", "end_us")


def _book(spark, d):
    e = mbo_events(spark, d)
    grid = features.Grid.of(e, P)
    points, hours = grid.points(e), grid.sample_points(e)
    return features.levels(e, P, grid), points.withColumn("at", F.col("g") * (P.snapshot_us // P.sample_us)), hours.withColumn("at", F.col("g"))


def q_book_levels(spark, d):
    levels, points, _ = _book(spark, d)
    return levels.top(points).select("instrument", "g", "side", "level", "price_ticks", "size")


def q_book_depth_change(spark, d):
    levels, points, _ = _book(spark, d)
    a = book.depth_arrays(levels.top(points), points.drop("at"), P.depth)
    return a.select("instrument", "g", F.posexplode(F.arrays_zip("bid_d", "ask_d")).alias("level", "x")).select("instrument", "g", "level", "x.bid_d", "x.ask_d")


def q_book_best_prices(spark, d):
    levels, _, hours = _book(spark, d)
    return levels.best(hours).select("instrument", "g", "bid", "ask", "mid", "spread")


def q_merged_stream(spark, d):
    return book.merged(mbo_events(spark, d), "SPOT").select("seq", "ts_us", "instrument", "rank", "position")


def q_aligned_snapshots(spark, d):
    levels, points, _ = _book(spark, d)
    b = levels.best(points)
    side = lambda n, i: b.where(F.col("instrument") == i).select("g", F.col("mid").alias(f"{n}_mid"), F.col("spread").alias(f"{n}_spread"))
    return side("base", "SPOT").join(side("future", "FUT"), "g")


def q_trade_windows(spark, d):
    t = features.trade_windows(mbo_events(spark, d), P.rolling)
    return t.select("seq", "instrument", *[F.col(c).cast("long").alias(c) for c in ("buy", "sell", "n", "net", "buys", "flips")])


def q_adds_per_snapshot(spark, d):
    j = book.judge(mbo_events(spark, d)).where("accepted and action = 'A'")
    return j.groupBy("instrument", (F.floor(F.col("ts_us") / P.snapshot_us) + 1).alias("g")).agg(F.count(F.lit(1)).alias("adds"))


def q_sample_windows(spark, d):
    levels, _, hours = _book(spark, d)
    return rounded(features.sample_windows(levels.best(hours), hours.drop("at"), P).drop("date"), 8)


def q_features_raw(spark, d):
    return rounded(features.features(mbo_events(spark, d), P)).select("instrument", "timestamp_ns", *FEATURES)


def q_features_norm(spark, d):
    return rounded(features.normalised(features.features(mbo_events(spark, d), P), P.zscore), 4).withColumnRenamed("g", "grid")


def q_zscore(spark, d):
    """Also of a column of values around 1e-6."""
    z = zscores(_series(spark, d).withColumn("s", F.col("u") / 1e6), ["k", "day"], "t", ["v", "u", "s"], P.zscore)
    return rounded(z, 5)


def q_ema(spark, d):
    return rounded(ema(_series(spark, d).select("k", "day", "t", "u"), ["k", "day"], "t", {"e2": ("u", 0.2), "e1": ("u", 0.1)}))


def q_event_count_trigger(spark, d):
    w = Window.partitionBy("instrument").orderBy("seq")
    return mbo_events(spark, d).withColumn("k", F.row_number().over(w)).where("k % 100 = 0").select("instrument", "k", "seq")


def q_label_durations(spark, d):
    return rounded(diagnostics.durations(_series(spark, d), ["k", "day"], "t"))


def q_variance_table(spark, d):
    return rounded(diagnostics.variances(_series(spark, d), ["v", "u"]), 4)


def q_regime_means(spark, d):
    return rounded(diagnostics.regime_means(_series(spark, d), ["v", "u"]))


def q_autocorrelation(spark, d):
    return rounded(diagnostics.autocorrelations(_series(spark, d), ["k"], "t", "v", within=["day"]))


def q_series_summary(spark, d):
    return rounded(diagnostics.series_summary(_series(spark, d), ["k"], "t", "v", within=["day"]), 4)


def q_correlation_matrix(spark, d):
    return rounded(diagnostics.correlations(mbo_events(spark, d), ["price_ticks", "size", "order_id"]))


def q_standard_scaler(spark, d):
    return rounded(diagnostics.standardised(_series(spark, d), ["v", "u"]).select("k", "day", "t", "v", "u"))


def q_cluster_scores(spark, d):
    return rounded(diagnostics.cluster_scores(_series(spark, d), ["v", "u"]), 4)


def q_silhouette(spark, d):
    return rounded(diagnostics.silhouette(_series(spark, d), ["v", "u"]))


def q_crosstab(spark, d):
    return _pairs(spark, d).groupBy("a").pivot("b", [0, 1, 2]).count().na.fill(0).select(F.col("a"), *[F.col(str(i)).alias(f"b{i}") for i in range(3)])


def q_cross_correlation(spark, d):
    w = Window.partitionBy("k").orderBy("t")
    p = _pairs(spark, d)
    cols = {j: F.lag("y", j).over(w) if j >= 0 else F.lead("y", -j).over(w) for j in range(-20, 21)}
    long = p.select("x", F.array(*[F.struct(F.lit(j).alias("lag"), c.alias("y")) for j, c in cols.items()]).alias("p")).select("x", F.inline("p"))
    return rounded(long.groupBy("lag").agg(diagnostics.correlation("x", "y").alias("rho")))


def q_transitions(spark, d):
    w = Window.partitionBy("k", "day").orderBy("t")
    return causal.transitions(_series(spark, d).select("k", F.col("regime").alias("cur"), F.lag("regime").over(w).alias("prev")).where("prev is not null"), "k", "prev")


def q_lag_transitions(spark, d):
    return causal.transitions(causal.lagged(_pairs(spark, d), 3), "prev", "past")


def q_likelihood_ratio(spark, d):
    return rounded(causal.likelihood_ratio(_pairs(spark, d), 10, 3, 3).select("ll0", "ll1", "stat", "df", "p_value"), 4)


def q_cmi(spark, d):
    return rounded(causal.conditional_mutual_information(_pairs(spark, d), range(1, 6)), 8)


def q_cmi_permutation(spark, d):
    out = None
    for delta in range(1, 6):
        p = causal.permutation_p(_pairs(spark, d), delta).withColumn("lag", F.lit(delta))
        out = p if out is None else out.unionByName(p)
    return out


def _both_ways(spark, d, lags):
    p = _pairs(spark, d)
    there = causal.granger(p, lags).withColumn("direction", F.lit("forward"))
    return there.unionByName(causal.granger(p.select("k", "t", F.col("x").alias("y"), F.col("y").alias("x")), lags).withColumn("direction", F.lit("backward")))


def q_granger(spark, d):
    """Lag 1 both ways, without the p-values; granger_lags has all."""
    n = _pairs(spark, d).where("t > 1").agg(F.count(F.lit(1)).alias("n"))
    return rounded(_both_ways(spark, d, 1).crossJoin(n).select("direction", "n", "ssr_restricted", "ssr_full", "f"), 4).withColumns({c: F.round(c, 2) for c in ("ssr_restricted", "ssr_full")})


def q_granger_lags(spark, d):
    """Lags 1 to 10 both ways, the least p-values of a lag first."""
    return _both_ways(spark, d, 10).orderBy("lag", "p_value")


def q_adf(spark, d):
    """Without the p-value, which adf_p has."""
    return rounded(causal.adf(_pairs(spark, d)).select("used_lag", "nobs", "stat"), 4)


def q_adf_p(spark, d):
    return causal.adf(_pairs(spark, d))


def q_hayashi_yoshida(spark, d):
    """Every event of a day; of events at one time the last counts."""
    s = _series(spark, d).groupBy("k", "day", F.col("ts_us").alias("t")).agg(F.max_by("v", F.col("t")).alias("v"))
    a, b = (s.where(F.col("k") == n).select(F.col("day").alias("k"), "t", "v") for n in ("SPOT", "FUT"))
    return rounded(causal.hayashi_yoshida(a, b, 3_600_000_000).withColumnRenamed("k", "day"), 3)


def _stored(spark, d):
    """The features, written once and read by every iteration of a fit."""
    at = f"{_scratch(spark)}/features"
    features.features(mbo_events(spark, d), P).write.parquet(at)
    return spark.read.parquet(at)


def q_regimes(spark, d):
    f = _stored(spark, d).na.drop(subset=MODEL)
    z = diagnostics.standardised(f.select("instrument", "g", *MODEL), MODEL)
    m = hmm.fit_hmm(z, ["instrument"], "g", MODEL)
    return hmm.decode(z, m, ["instrument"], "g", MODEL)


def q_pca(spark, d):
    f = _stored(spark, d).select("instrument", "g", *MODEL).na.drop()
    comps, _ = hmm.pca(f, MODEL)
    return hmm.project(f, MODEL, comps)


def _scratch(spark) -> str:
    """A folder of its own below spark.checkpoint.dir; a local master may have none set, and takes a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = Path(tempfile.mkdtemp(prefix="ticklattice-stream-")).as_uri()
    return f"{at.rstrip('/')}/ticklattice/{uuid.uuid4().hex}"


def _streamed(spark, d, make):
    """What a stream makes of the events, fed as files, once it has ended: rows in time, and late ones."""
    base = _scratch(spark)
    mbo_events(spark, d).write.parquet(f"{base}/in")
    q = book_stream.write_split(make(spark.readStream.schema(MBO_SCHEMA).parquet(f"{base}/in")), f"{base}/out", f"{base}/late", f"{base}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def q_stream_book(spark, d):
    """The streaming judge over the same events; equal to the batch one."""
    return _streamed(spark, d, book_stream.live_orders).select("seq", "instrument", "order_id", "action", "accepted")


def q_stream_snapshots(spark, d):
    """Snapshots from the streamed book, with its rolling trades and sampled returns."""
    s = _streamed(spark, d, lambda e: book_stream.snapshots(e, P))
    return rounded(s.select("instrument", "g", "bid", "ask", "buy", "sell", "trades", "net", "adds", "realized_variance"), 8)


def q_stream_bars(spark, d):
    """Trade bars of six hours, of a stream whose watermark has passed them all."""
    base = _scratch(spark)
    e = mbo_events(spark, d)
    last = e.agg(F.max("ts_us") + 86_400_000_000 * 365).first()[0]
    e.write.parquet(f"{base}/in/k=0")
    spark.createDataFrame([(-1, last, "END", "T", "B", 0, 0, 0)], MBO_SCHEMA).write.parquet(f"{base}/in/k=1")
    stream = spark.readStream.schema(MBO_SCHEMA).option("maxFilesPerTrigger", 100).parquet(f"{base}/in/*")
    q = book_stream.trade_bars(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("instrument", F.unix_micros("w.start").alias("start_us"), "trades", "volume", "signed_volume").where("instrument <> 'END'")


def q_feature_summary(spark, d):
    """Lag-1 autocorrelation, deviations and variation of the model's features."""
    f = features.features(mbo_events(spark, d), P)
    return workflow.summary(f, ["instrument"], "g", MODEL)


def q_label_counts(spark, d):
    return diagnostics.label_counts(_series(spark, d))


def q_distribution(spark, d):
    return diagnostics.distribution(_series(spark, d), ["v", "u"], 20).select("feature", "bin", F.round("low", 6).alias("low"), "rows")


def q_replay_until(spark, d):
    """Events replayed up to the session's noon on each side, and those that are left."""
    noon = 1_705_000_000_000_000
    done, rest = book.until(mbo_events(spark, d), noon)
    count = lambda x, n: x.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("clock_us")).withColumn("part", F.lit(n))
    return count(done, "done").unionByName(count(rest, "rest"))


def q_first_events(spark, d):
    return sinks.first_events(mbo_events(spark, d), 100).select("seq", "instrument", "action")


def q_latest_features(spark, d):
    f = features.features(mbo_events(spark, d), P).where("instrument = 'SPOT'")
    return sinks.latest(f, 100).select("instrument", "timestamp_ns", F.round("midprice", 6).alias("midprice"))


def q_model_columns(spark, d):
    """What is left of the feature table for the models."""
    f = features.features(mbo_events(spark, d), P)
    return rounded(f.drop(*[c for c in DROPPED if c not in ("instrument", "timestamp_ns")]).drop("g"))


def q_regime_metrics(spark, d):
    """The classifier and its checks: criteria, cluster scores, silhouette."""
    f = _stored(spark, d)
    return rounded(workflow.classify(f, ["instrument"], "g").metrics, 4)


def q_posterior_granger(spark, d):
    """Posteriors of both instruments' regimes: every pair, both ways, the strongest at lag 1."""
    f = _stored(spark, d)
    series = {}
    for n, prefix in (("SPOT", "base_p_"), ("FUT", "future_p_")):
        run = workflow.classify(f.where(F.col("instrument") == n), ["instrument"], "g")
        series[n] = workflow.posterior_series(run.labels, [], "g", prefix, 4)
    return causal.strongest_pairs(causal.granger_pairs(series["SPOT"], series["FUT"], "base_p_", "future_p_"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
