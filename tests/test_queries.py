"""Every query against the SQL that gives the same rows, and micro-fixtures of the order book."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.functions.tails import adf_p, chi2_sf, f_sf
from ticklattice.operators import book, hmm
from ticklattice.plans.queries import ORACLES, QUERIES
from ticklattice.sources.adapter import MBO_SCHEMA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def events(spark, rows):
    return spark.createDataFrame([(i, i * 10, "X", a, s, o, p, z) for i, (a, s, o, p, z) in enumerate(rows, 1)], MBO_SCHEMA)


def test_liveness_equals_a_state_machine(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("AAMC"), rnd.choice("BA"), rnd.randrange(6), rnd.randrange(90, 110), rnd.randrange(1, 9)) for _ in range(400)]
    live, want = set(), []
    for a, _, o, *_ in rows:
        ok = (o not in live) if a == "A" else o in live
        want.append(ok)
        if ok and a == "A":
            live.add(o)
        elif ok and a == "C":
            live.remove(o)
    got = [r.accepted for r in book.judge(events(spark, rows)).orderBy("seq").collect()]
    assert got == want


def test_modification_keeps_side_and_cancellation_removes_all(spark):
    v = book.versions(book.judge(events(spark, [("A", "B", 1, 100, 5), ("A", "B", 1, 101, 9), ("M", "A", 1, 99, 7), ("M", "B", 2, 99, 1), ("C", "B", 1, 0, 1), ("C", "B", 1, 0, 1)])))
    assert sorted((r.side, r.price_ticks, r.size, r.start_us, r.end_us) for r in v.collect()) == [("B", 99, 7, 30, 50), ("B", 100, 5, 10, 30)]


def top_levels(spark, versions, step, first, last):
    spans = spark.createDataFrame([(0, first, last)], "date int, first long, last long")
    points = spark.range(first, last + 1).selectExpr("0 as date", "'X' as instrument", "id as g", "id as at")
    return book.Levels.of(versions, step, spans, last - first + 1, 10).top(points)


def test_state_is_strictly_before_the_grid_time(spark):
    v = book.versions(book.judge(events(spark, [("A", "B", 1, 100, 5), ("A", "A", 2, 102, 3), ("C", "B", 1, 0, 0)])))
    cells = {(r.g, r.side): r.size for r in top_levels(spark, v, 10, 1, 5).collect()}
    assert cells == {(2, "B"): 5, (3, "B"): 5, (3, "A"): 3, (4, "A"): 3, (5, "A"): 3}


def test_levels_are_summed_ranked_and_cut(spark):
    rows = [("A", "B", i, 100 - i // 2, 1 + i) for i in range(26)]
    top = top_levels(spark, book.versions(book.judge(events(spark, rows))), 1000, 1, 1).orderBy("level").collect()
    assert [r.price_ticks for r in top] == list(range(100, 90, -1)) and top[0].size == 3


def test_empty_events(spark):
    e = events(spark, [])
    assert book.versions(book.judge(e)).count() == 0 and book.merged(e, "X").count() == 0


def test_tails():
    assert abs(chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(f_sf(4.964603, 1, 10) - 0.05) < 1e-6
    assert abs(adf_p(-2.86) - 0.05) < 2e-3 and adf_p(-30.0) == 0.0


def test_hmm_finds_two_regimes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in ("a", "b"):
        s = 0
        for t in range(200):
            s = s if rng.random() < 0.95 else 1 - s
            rows.append((day, t, s, float(rng.normal(6 * s, 1)), float(rng.normal(-4 * s, 1))))
    df = spark.createDataFrame(rows, "day string, t int, s int, x double, y double")
    m = hmm.fit_hmm(df, ["day"], "t", ["x", "y"], states=2, iterations=10)
    got = {(r.day, r.t): r.regime for r in hmm.decode(df, m, ["day"], "t", ["x", "y"]).collect()}
    same = np.mean([got[d, t] == s for d, t, s, *_ in rows])
    assert max(same, 1 - same) > 0.98


def test_entry_module_lists_the_queries(spark):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["instrument", "timestamp_ns"]


def test_ema_takes_every_event_in_any_block(spark, sf):
    """A closed form in blocks against the recursion, over several blocks and with nulls."""
    from ticklattice.operators.rolling import ema, with_ewm

    rnd = random.Random(4)
    rows = [("a", i, rnd.gauss(0, 1) if i % 7 else None) for i in range(3000)] + [("b", 0, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    got = {(r.k, r.t): r for r in ema(df, ["k"], "t", {"fast": ("x", 0.2), "slow": ("x", 0.01), "last": ("x", 1.0)}).collect()}
    for k in "ab":
        y = {"fast": 0.0, "slow": 0.0, "last": 0.0}
        for _, t, x in sorted(r for r in rows if r[0] == k):
            for name, a in (("fast", 0.2), ("slow", 0.01), ("last", 1.0)):
                y[name] = a * (x or 0.0) + (1 - a) * y[name]
                assert abs(got[k, t][name] - y[name]) < 1e-9
    v = [rnd.random() for _ in range(900)]
    out = with_ewm(spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, t int, x double"), ["k"], "t", "x", "e", 50, 0.1).orderBy("t").collect()
    for i, r in enumerate(out):
        e = v[max(0, i - 49)]
        for x in v[max(0, i - 49) + 1 : i + 1]:
            e = 0.1 * x + 0.9 * e
        assert abs(r.e - e) < 1e-9
    assert QUERIES["ema"](spark, sf).count() == QUERIES["mbo_events"](spark, sf).count()


def test_hayashi_yoshida_takes_every_event(spark, sf):
    e = QUERIES["mbo_events"](spark, sf).orderBy("seq").toPandas()
    e["day"] = e.ts_us // 86_400_000_000
    got = {r.day: (r.covariance, r.overlaps) for r in QUERIES["hayashi_yoshida"](spark, sf).collect()}
    for day, own in e.groupby("day"):
        moves = []
        for n in ("SPOT", "FUT"):
            last = dict(zip(own.ts_us[own.instrument == n], own.price_ticks[own.instrument == n].astype(float), strict=True))
            t = sorted(last)
            moves.append([(a, b, last[b] - last[a]) for a, b in zip(t, t[1:], strict=False)])
        met = [x * y for a0, a1, x in moves[0] for b0, b1, y in moves[1] if a0 < b1 and b0 < a1]
        if met:
            assert got[day][1] == len(met) and abs(got[day][0] - sum(met)) < 1e-2


def test_granger_and_adf_equal_least_squares(spark):
    """F, p and the statistic of regressions solved with numpy, for series far from zero and in two keys."""
    from ticklattice.operators import causal

    rng = np.random.default_rng(8)
    rows = []
    for k in (1, 2):
        x, y = rng.normal(size=300).cumsum(), np.zeros(300)
        for t in range(1, 300):
            y[t] = 0.5 * y[t - 1] + 0.3 * x[t - 1] + rng.normal()
        rows += [(k, t, float(400_000 + x[t]), float(400_000 + y[t])) for t in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, x double, y double")
    series = {k: np.array([r[2:] for r in rows if r[0] == k]) - 400_000 for k in (1, 2)}

    def ssr(y, cols):
        a = np.column_stack([np.ones(len(y)), *cols])
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        return float(((y - a @ b) ** 2).sum()), b, a

    got = {r.lag: r for r in causal.granger(df, 4).collect()}
    for lag in range(1, 5):
        y = np.concatenate([s[lag:, 1] for s in series.values()])
        back = lambda c: [np.concatenate([s[lag - i : 300 - i, c] for s in series.values()]) for i in range(1, lag + 1)]  # noqa: B023, E731
        small, big = ssr(y, back(1))[0], ssr(y, back(1) + back(0))[0]
        f = (small - big) / lag / (big / (len(y) - 2 * lag - 1))
        assert abs(got[lag].f - f) < 1e-6 * f and abs(got[lag].ssr_full - big) < 1e-6 * big and got[lag].p_value < 1e-6
    for c, name in ((0, "x"), (1, "y")):
        d = np.concatenate([np.diff(s[:, c])[1:] for s in series.values()])
        lags = [np.concatenate([s[1:-1, c] for s in series.values()]), np.concatenate([np.diff(s[:, c])[:-1] for s in series.values()])]
        n, s0, (s1, b, a) = len(d), ssr(d, lags[:1])[0], ssr(d, lags)
        used = int(n * np.log(s1) + 2 < n * np.log(s0))
        if not used:
            d = np.concatenate([np.diff(s[:, c]) for s in series.values()])
            s1, b, a = ssr(d, [np.concatenate([s[:-1, c] for s in series.values()])])
        stat = b[1] / np.sqrt(s1 / (len(d) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        r = causal.adf(df, name).first()
        assert r.used_lag == used and r.nobs == len(d) and abs(r.stat - stat) < 1e-6 * abs(stat) and 0 <= r.p_value <= 1
    flat = spark.createDataFrame([(1, t, 1.0, 1.0) for t in range(20)], "k int, t int, x double, y double")
    assert causal.adf(flat).first().stat is None and all(r.f is None for r in causal.granger(flat, 2).collect())
    assert causal.granger(flat.limit(0), 2).count() == 0 and causal.adf(flat.limit(0)).first().p_value is None


def test_granger_of_posterior_pairs(spark):
    from ticklattice.operators import causal

    rng = np.random.default_rng(9)
    a = rng.random((200, 2))
    b = np.vstack([rng.random((2, 2)), a[:-2]]) * 0.9 + 0.1 * rng.random((200, 2))
    frame = lambda m, n: spark.createDataFrame([("d", t, *map(float, r)) for t, r in enumerate(m)], f"k string, t int, {n}_p_0 double, {n}_p_1 double")
    got = causal.granger_pairs(frame(a, "spy"), frame(b, "es"), "spy_p_", "es_p_", max_lag=3)
    assert got.count() == 2 * 4 * 3
    top = causal.strongest_pairs(got, n=2).collect()
    assert {(r.direction, r.place) for r in top} == {(d, i) for d in ("forward", "backward") for i in (1, 2)}
    best = {(r.cause, r.effect) for r in top if r.direction == "forward"}
    assert best == {("spy_p_0", "es_p_0"), ("spy_p_1", "es_p_1")} and all(r.p_value < 1e-9 for r in top if r.direction == "forward")
    one = causal.granger(frame(a, "x").select("k", "t", "x_p_0").join(frame(np.vstack([b[1:], b[:1]]), "y").where("t < 199").select("k", "t", "y_p_1"), ["k", "t"]).toDF("k", "t", "x", "y"), 3)
    p = {r.lag: r.p_value for r in one.collect()}
    assert all(abs(p[r.lag] - r.p_value) < 1e-6 for r in got.where("cause = 'spy_p_0' and effect = 'es_p_1'").collect())


def test_other_sides_are_asks_and_clears_close_the_book(spark):
    rows = [("A", "N", 1, 100, 5), ("A", "B", 2, 99, 4), ("R", "N", 0, 0, 0), ("C", "B", 2, 0, 0), ("A", "B", 2, 98, 3)]
    e = events(spark, rows)
    v = lambda clear: sorted((r.side, r.price_ticks, r.start_us, r.end_us) for r in book.versions(book.judge(e, clear)).collect())
    assert v(False) == [("A", 100, 10, None), ("B", 98, 50, None), ("B", 99, 20, 40)]
    assert v(True) == [("A", 100, 10, 30), ("B", 98, 50, None), ("B", 99, 20, 30)]
    assert [r.accepted for r in book.judge(e, True).orderBy("seq").collect()] == [True, True, True, False, True]


def test_many_dates_are_one_job(spark, sf):
    """Features of two dates at once equal those of each alone."""
    from dataclasses import replace

    from ticklattice.operators import features
    from ticklattice.params import FEATURES, SPARSE

    e = QUERIES["mbo_events"](spark, sf).withColumn("date", F.floor(F.col("ts_us") / 864_000_000_000).cast("string"))
    p = replace(SPARSE, snapshot_us=43_200_000_000)
    both = features.features(e, p).toPandas()
    assert len(both.date.unique()) > 1
    for date, own in both.groupby("date"):
        alone = features.features(e.where(F.col("date") == date).drop("date"), p).toPandas()
        a, b = (x.sort_values(["instrument", "g"])[FEATURES].to_numpy(float) for x in (own, alone))
        assert len(a) == len(b) and np.allclose(a, b, atol=1e-9, equal_nan=True)


def test_queries_take_the_settings_of_the_reference(spark, sf, monkeypatch):
    seen = {}

    def fit(*args, states=4, iterations=500, **more):
        seen.update(states=states, iterations=iterations)
        raise StopIteration

    monkeypatch.setattr(hmm, "fit_hmm", fit)
    with pytest.raises(StopIteration):
        QUERIES["regimes"](spark, sf)
    assert seen == {"states": 4, "iterations": 500}
    assert sorted(r.lag for r in QUERIES["cmi_permutation"](spark, sf).collect()) == [1, 2, 3, 4, 5]
    assert QUERIES["silhouette"](spark, "/root/testdata/sf0.01").first().points == QUERIES["mbo_events"](spark, "/root/testdata/sf0.01").count()
