"""Streams with late rows and resets, sinks, reports, the regime workflow, and statistics against numpy."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.operators import causal, diagnostics, hmm
from ticklattice.params import FEATURES, Params
from ticklattice.plans import workflow
from ticklattice.sources import sinks
from ticklattice.sources.adapter import MBO_SCHEMA, read_features
from ticklattice.streaming import book_stream


def stream_in(spark, path, parts):
    """A stream whose micro-batches are the parts, in their order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, MBO_SCHEMA).coalesce(1).write.parquet(f"{path}/in/k={i}")
    return spark.readStream.schema(MBO_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def test_late_rows_come_out_apart(spark, tmp_path):
    p = Params(snapshot_us=100, sample_us=50, rolling=3, ring=4)
    add = lambda seq, ts, side, price, order: (seq, ts, "X", "A", side, order, price, 5)
    parts = [[add(1, 10, "B", 99, 1), add(2, 20, "A", 101, 2), (3, 130, "X", "T", "B", 0, 0, 7)], [(4, 120, "X", "C", "B", 1, 0, 0), (5, 350, "X", "T", "N", 0, 0, 2)]]
    out = {}
    for name, make in (("snap", lambda e: book_stream.snapshots(e, p)), ("live", book_stream.live_orders)):
        stream = stream_in(spark, f"{tmp_path}/{name}", parts)
        book_stream.write_split(make(stream), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/late", f"{tmp_path}/{name}/state").awaitTermination()
        out[name] = spark.read.parquet(f"{tmp_path}/{name}/out"), spark.read.parquet(f"{tmp_path}/{name}/late")
    got, late = out["snap"]
    assert [(r.g, r.bid, r.ask, r.buy, r.sell, r.trades, r.net, r.adds) for r in got.orderBy("g").collect()] == [(1, 99, 101, 0, 0, 0, 0, 2), (2, 99, 101, 7, 0, 1, 1, 0), (3, 99, 101, 7, 0, 1, 1, 0)]
    assert [r.seq for r in late.collect()] == [4]  # behind its book's clock, and so not applied
    assert sorted((r.seq, r.accepted) for r in out["live"][0].collect()) == [(1, True), (2, True), (4, True)] and out["live"][1].count() == 0


def test_a_new_date_is_a_new_book(spark, tmp_path):
    p = Params(snapshot_us=100, sample_us=50)
    day = [(1, 10, "X", "A", "B", 1, 99, 5), (2, 210, "X", "T", "B", 0, 0, 1)]
    stream = stream_in(spark, str(tmp_path), [day]).withColumn("date", F.lit("a"))
    both = stream.unionByName(stream_in(spark, f"{tmp_path}/b", [[(1, 10, "X", "A", "A", 1, 101, 5), (2, 210, "X", "T", "B", 0, 0, 1)]]).withColumn("date", F.lit("b")))
    book_stream.write_split(book_stream.snapshots(both, p), f"{tmp_path}/out", f"{tmp_path}/late", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.date, r.g, r.bid, r.ask) for r in got} == {("a", 1, 99, None), ("a", 2, 99, None), ("b", 1, None, 101), ("b", 2, None, 101)}


def test_two_streams_meet_at_grid_times(spark, tmp_path):
    schema = "date string, g long, bid long, ask long, buy long, sell long, late boolean"
    for name, gs in (("base", (1, 2, 3)), ("future", (2, 3, 4))):
        spark.createDataFrame([("d", g, g, g + 1, 0, 0, False) for g in gs], schema).write.parquet(f"{tmp_path}/{name}")
    base, future = (spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}") for n in ("base", "future"))
    joined = book_stream.aligned(base, future, Params())
    joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.g, r.base_bid, r.future_ask) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(2, 2, 3), (3, 3, 4)]


def table(spark, rows=60):
    rng = np.random.default_rng(6)
    data = []
    for date in ("20250505", "20250506"):
        for i in range(rows):
            s = i // (rows // 2)
            data.append((date, "SPY", i, 1000 * i, *[float(x) for x in rng.normal(4 * s, 1, len(FEATURES))]))
    return spark.createDataFrame(data, "date string, instrument string, g long, timestamp_ns long, " + ", ".join(f"{f} double" for f in FEATURES))


def test_tables_go_out_and_come_back(spark, tmp_path):
    t = table(spark)
    at = sinks.write_tables(t, t, str(tmp_path), Params(), exact=True)
    assert at.endswith("output_Snapshot0.50_Window30000_Events1500")
    line = spark.read.text(f"{at}/raw/date=20250505/asset=SPY").first()[0]
    assert line == ",".join(["timestamp_ns", "instrument", *FEATURES])
    paths = [f"{at}/norm/date={d}/asset=SPY" for d in ("20250505", "20250506", "20250505")]
    back = read_features(spark, paths, corrupt="bad")
    assert back.count() == t.count() and all(r.bad is None for r in back.collect())
    assert {r.date for r in back.select("date").distinct().collect()} == {"20250505", "20250506"}
    a, b = (x.orderBy("date", "timestamp_ns").toPandas()[FEATURES].to_numpy() for x in (t, back))
    assert np.allclose(a, b, rtol=1e-14)
    (tmp_path / "odd.csv").write_text(f"{line}\n1,SPY,x\n")
    assert [r.bad for r in read_features(spark, [str(tmp_path / "odd.csv")], corrupt="bad").collect()] == ["1,SPY,x"]
    kept, seen = sinks.counted(t)
    kept.write.format("noop").mode("overwrite").save()
    assert seen.get["records"] == t.count()
    got = []
    assert sinks.push(t, lambda df, n: got.append((df.count(), n))) is None and got == [(t.count(), 0)]
    assert [r.g for r in sinks.latest(t.where("date = '20250505'"), 2).collect()] == [59, 58]
    assert workflow.systematic(t, ["date"], "g", 25).groupBy("date").count().first()["count"] == 3


def test_a_stream_is_pushed_batch_by_batch(spark, tmp_path):
    stream, got = stream_in(spark, str(tmp_path), [[(1, 1, "X", "A", "B", 1, 9, 1)], [(2, 2, "X", "A", "B", 2, 9, 1)]]), []
    sinks.push(stream, lambda df, n: got.append((n, [r.seq for r in df.collect()])), f"{tmp_path}/state").awaitTermination()
    assert got == [(0, [1]), (1, [2])]


def test_workflow_fits_labels_checks_and_writes(spark, tmp_path):
    t = table(spark)
    runs = workflow.sweep(t, ["date"], "g", (2, 3), iterations=8)
    assert set(runs) == {2, 3}
    for k, r in runs.items():
        workflow.write_run(r, t, ["date"], "g", str(tmp_path))
        m = r.metrics.first()
        p = k - 1 + k * (k - 1) + k * 5 + k * 15
        assert m.regimes == k and abs(m.aic - (2 * p - 2 * m.log_likelihood)) < 1e-6 and abs(m.bic - (p * math.log(120) - 2 * m.log_likelihood)) < 1e-6
    assert runs[2].metrics.first().silhouette > 0.4
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == 2
    labelled = spark.read.option("header", True).csv(f"{tmp_path}/labelled_2")
    assert labelled.count() == 120 and "regime" in labelled.columns and set(FEATURES) < set(labelled.columns)
    var = [float(r.var_pop) for r in spark.read.option("header", True).csv(f"{tmp_path}/report_2/variances").collect()]
    assert var == sorted(var, reverse=True) and len(var) == 5
    assert {r.feature for r in workflow.summary(t, ["date"], "g").collect()} == set(FEATURES)
    back, model = hmm.load_hmm(spark, f"{tmp_path}/model_2"), runs[2].model
    assert all(np.allclose(getattr(back, n), getattr(model, n)) for n in ("start", "trans", "means", "covars")) and back.log_likelihood == model.log_likelihood
    post = workflow.posterior_series(runs[2].labels, ["date"], "g", "p_", 2).collect()
    assert all(abs(r.p_0 + r.p_1 - 1) < 1e-9 for r in post)
    sinks.write_granger(spark.createDataFrame([("forward", "a", "b", 1, 0.5), ("backward", "b", "a", 1, None)], "direction string, cause string, effect string, lag int, p_value double"), str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/forward").columns == ["cause", "effect", "lag", "p_value"]


def test_score_is_the_likelihood_of_all_paths(spark):
    m = hmm.GaussianHMM(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.0], [2.0]]), np.array([[[1.0]], [[0.5]]]))
    x = [0.1, 1.9, 2.2, -0.3]
    d = [[math.exp(-0.5 * (v - mu) ** 2 / s) / math.sqrt(2 * math.pi * s) for mu, s in ((0, 1), (2, 0.5))] for v in x]
    total, best, path = 0.0, 0.0, None
    post = np.zeros((4, 2))
    for code in range(16):
        z = [code >> i & 1 for i in range(4)]
        p = m.start[z[0]] * d[0][z[0]]
        for t in range(1, 4):
            p *= m.trans[z[t - 1], z[t]] * d[t][z[t]]
        total += p
        post[range(4), z] += p
        if p > best:
            best, path = p, z
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "k string, t int, v double")
    ll, n = hmm.score(df, m, ["k"], "t", ["v"])
    assert n == 4 and abs(ll - math.log(total)) < 1e-9
    got = hmm.decode(df, m, ["k"], "t", ["v"]).orderBy("t").collect()
    assert [r.regime for r in got] == path and np.allclose([r.posterior for r in got], post / total)


def test_pca_silhouette_and_permutation_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) @ np.array([[2, 1, 0], [0, 1, 0.2], [0, 0, 0.1]])
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x, strict=True)], "regime int, a double, b double, c double")
    comps, share = hmm.pca(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    s = np.linalg.svd(z, full_matrices=False)[1] ** 2
    assert np.allclose(share, s / s.sum()) and comps.shape[1] == int(np.searchsorted(np.cumsum(s / s.sum()), 0.99)) + 1
    pcs = hmm.project(df, ["a", "b", "c"], comps).toPandas()
    assert np.allclose(sorted(pcs[[c for c in pcs if c.startswith("pc")]].var(ddof=0), reverse=True), s[: comps.shape[1]] / 80)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(80):
        a = d[i, y == y[i]].sum() / (sum(y == y[i]) - 1)
        b = d[i, y != y[i]].mean()
        want.append((b - a) / max(a, b))
    assert abs(diagnostics.silhouette(df, ["a", "b", "c"]).first().silhouette - np.mean(want)) < 1e-9
    past = rng.integers(0, 2, 400)
    cur = np.where(rng.random(400) < 0.8, np.roll(past, 2), rng.integers(0, 2, 400))
    other = rng.integers(0, 2, 400)
    pairs = lambda a: spark.createDataFrame([(0, t, int(a[t]), int(cur[t])) for t in range(400)], "k int, t int, a int, b int")
    told, untold = (causal.permutation_p(pairs(a), 2, 200).first() for a in (past, other))
    assert told.p_value < 0.01 < 0.02 < untold.p_value and told.cmi > untold.cmi
    bins = diagnostics.distribution(df, ["a"], 5).orderBy("bin").collect()
    assert [r.rows for r in bins] == [c for c in np.histogram(x[:, 0], 5)[0].tolist() if c]


def test_information_criteria():
    assert diagnostics.information_criteria(-10.0, 100, 2, 1) == {"aic": 34.0, "bic": pytest.approx(7 * math.log(100) + 20), "parameters": 7}


def test_summary_of_a_feature_without_spread_equals_sql(spark):
    rows = [(k, t, 0.1, math.sin(t), None if t % 2 else 1.0) for k in "ab" for t in range(40)]
    t = spark.createDataFrame(rows, "k string, t int, flat double, x double, gaps double").repartition(7)
    got = {r.feature: r for r in workflow.summary(t, ["k"], "t", ["flat", "x", "gaps"]).collect()}
    con = duckdb.connect()
    con.sql("create table t(k text, t int, flat double, x double, gaps double)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    for c in ("flat", "x", "gaps"):
        sql = f"select round(corr(v, y), 4), round(stddev_samp(v), 4), round(stddev_samp(v - y), 4) from (select {c} v, lag({c}) over (partition by k order by t) y from t)"
        want, r = con.sql(sql).fetchall()[0], got[c]
        for a, b in zip((r.rho1, r.std, r.delta_std), want, strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-4, nan_ok=True), c
    assert math.isnan(got["flat"].rho1) and got["gaps"].rho1 is None
    flat = diagnostics.autocorrelations(t, ["k"], "t", "flat", 3).collect()
    assert len(flat) == 6 and all(math.isnan(r.rho) for r in flat)


def test_pca_leaves_features_without_spread_out(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 2))
    t = spark.createDataFrame([(float(a), 0.1, float(b)) for a, b in x], "a double, flat double, b double").repartition(7)
    comps, share = hmm.pca(t, ["a", "flat", "b"])
    z = (x - x.mean(0)) / x.std(0)
    s = np.linalg.svd(z, full_matrices=False)[1] ** 2
    assert np.allclose(share, [*(s / s.sum()), 0.0]) and comps.shape == (3, 2) and np.allclose(comps[1], 0.0)
    pcs = hmm.project(t, ["a", "flat", "b"], comps).toPandas()
    assert np.allclose(pcs.var(ddof=0), s / 60)
    assert all(abs(r.flat) < 1e-12 for r in diagnostics.standardised(t, ["flat"]).collect())
    none, share = hmm.pca(t, ["flat"])
    assert none.shape == (1, 0) and share.tolist() == [0.0]
