"""DuckDB SQL of the queries, built on one common table expression for each step."""

from __future__ import annotations

from ticklattice.params import FEATURES, MODEL
from ticklattice.params import SPARSE as P

S, U, K, N, Z, L = P.snapshot_us, P.sample_us, P.ring, P.rolling, P.zscore, P.return_lag + 1
ALPHA = 2.0 / (N + 1)

CTES = {
    "mbo": """SELECT event_id AS seq, epoch_us(ts) AS ts_us, CASE WHEN user_id % 2 = 0 THEN 'SPOT' ELSE 'FUT' END AS instrument,
 CASE WHEN event_type IN ('signup', 'view') THEN 'A' WHEN event_type = 'purchase' THEN 'M' WHEN event_type = 'error' THEN 'C' ELSE 'T' END AS action,
 CASE WHEN (user_id // 2) % 2 = 0 THEN 'B' ELSE 'A' END AS side, user_id AS order_id,
 CAST(CASE WHEN (user_id // 2) % 2 = 0 THEN 400000 - 25 * floor(value / 10) ELSE 400025 + 25 * floor(value / 10) END AS BIGINT) AS price_ticks,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS size FROM events""",
    "judged": """SELECT *, CASE WHEN action = 'A' THEN last_ac IS DISTINCT FROM 'A' WHEN action IN ('M', 'C') THEN last_ac IS NOT DISTINCT FROM 'A' ELSE true END AS accepted
 FROM (SELECT *, last_value(CASE WHEN action IN ('A', 'C') THEN action END IGNORE NULLS) OVER (PARTITION BY instrument, order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ac FROM mbo)""",
    "vers": """SELECT seq, instrument, order_id, side2 AS side, price_ticks, size, ts_us AS start_us, end_us FROM (SELECT *,
 last_value(CASE WHEN action = 'A' THEN side END IGNORE NULLS) OVER (PARTITION BY instrument, order_id ORDER BY seq) AS side2, lead(ts_us) OVER (PARTITION BY instrument, order_id ORDER BY seq) AS end_us
 FROM judged WHERE accepted AND action IN ('A', 'M', 'C')) WHERE action <> 'C'""",
    "bounds": f"SELECT min(lo) // {S} + 1 AS g0, min(hi) // {S} AS g1 FROM (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM mbo GROUP BY instrument)",
    "grid": "SELECT DISTINCT instrument, g FROM mbo, (SELECT unnest(range(g0, g1 + 1)) AS g FROM bounds)",
    "hours": f"SELECT DISTINCT instrument, h FROM mbo, (SELECT unnest(range((g0 - 1) * {S // U} + 1, g1 * {S // U} + 1)) AS h FROM bounds)",
    "lv": f"SELECT g.instrument, g.g, v.side, v.price_ticks, sum(v.size)::BIGINT AS size FROM grid g JOIN vers v ON v.instrument = g.instrument AND v.start_us < g.g * {S} AND (v.end_us IS NULL OR v.end_us >= g.g * {S}) GROUP BY ALL",
    "top": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, g, side ORDER BY CASE WHEN side = 'B' THEN -price_ticks ELSE price_ticks END)::INT - 1 AS level FROM lv) WHERE level < {P.depth}",
    "arr": f"""SELECT *, coalesce(sign(bs - lag(bs, 1, 0) OVER (PARTITION BY instrument, level ORDER BY g)), 0)::INT AS bd, coalesce(sign(az - lag(az, 1, 0) OVER (PARTITION BY instrument, level ORDER BY g)), 0)::INT AS ad FROM (
 SELECT g.instrument, g.g, l.level, coalesce(b.price_ticks, 0) AS bp, coalesce(b.size, 0) AS bs, coalesce(a.price_ticks, 0) AS ap, coalesce(a.size, 0) AS az
 FROM grid g CROSS JOIN (SELECT unnest(range(0, {P.depth}))::INT AS level) l LEFT JOIN top b ON b.instrument = g.instrument AND b.g = g.g AND b.level = l.level AND b.side = 'B'
 LEFT JOIN top a ON a.instrument = g.instrument AND a.g = g.g AND a.level = l.level AND a.side = 'A')""",
    "best": f"""SELECT x.instrument, x.h, max(CASE WHEN v.side = 'B' THEN v.price_ticks END) AS bid, min(CASE WHEN v.side = 'A' THEN v.price_ticks END) AS ask
 FROM hours x JOIN vers v ON v.instrument = x.instrument AND v.start_us < x.h * {U} AND (v.end_us IS NULL OR v.end_us >= x.h * {U}) GROUP BY ALL""",
    "trades": f"""SELECT *, coalesce(sum(size) FILTER (dir > 0) OVER w, 0)::BIGINT AS buy, coalesce(sum(size) FILTER (dir < 0) OVER w, 0)::BIGINT AS sell, count(*) OVER w AS n, sum(dir) OVER w AS net,
 count(*) FILTER (dir > 0) OVER w AS buys,
 (sum(flip) OVER w - CASE WHEN rn > {N} THEN lag(flip, {N - 1}) OVER (PARTITION BY instrument ORDER BY seq) ELSE 0 END)::BIGINT AS flips FROM (
 SELECT *, CASE WHEN dir = -lag(dir) OVER o THEN 1 ELSE 0 END AS flip, row_number() OVER o AS rn FROM (SELECT *, CASE WHEN side = 'B' THEN 1 ELSE -1 END AS dir FROM mbo WHERE action = 'T')
 WINDOW o AS (PARTITION BY instrument ORDER BY seq)) WINDOW w AS (PARTITION BY instrument ORDER BY seq ROWS {N - 1} PRECEDING)""",
    "smp": f"""SELECT *, ln(mid) - ln(lag(mid) OVER (PARTITION BY instrument ORDER BY h)) AS r, coalesce(sign(mid - lag(mid) OVER (PARTITION BY instrument ORDER BY h)), 0) AS tick FROM (
 SELECT instrument, h, (bid + ask) / 2.0 * {P.tick} AS mid, (ask - bid) * {P.tick} AS spread FROM hours LEFT JOIN best USING (instrument, h))""",
    "rets": "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY h) AS rn, r * r AS r2 FROM smp WHERE r IS NOT NULL",
    "ewm": f"""SELECT a.instrument, a.h, sum(b.r2 * pow(1 - {ALPHA}, a.rn - b.rn) * CASE WHEN b.rn = greatest(1, a.rn - {K - 2}) THEN 1 ELSE {ALPHA} END) AS v,
 avg(b.r2) AS rv, coalesce(avg(b.r2) FILTER (b.r > 0), 0) AS u, coalesce(avg(b.r2) FILTER (b.r <= 0), 0) AS d
 FROM rets a JOIN rets b ON a.instrument = b.instrument AND b.rn BETWEEN a.rn - {K - 2} AND a.rn GROUP BY ALL""",
    "ring": f"""SELECT instrument, h, sqrt(greatest(0, (sq - 2 * (ss / {N}) * ss + sn * (ss / {N}) * (ss / {N})) / {N})) AS spread_volatility, te AS tick_direction_entropy,
 coalesce(last_value(rv IGNORE NULLS) OVER w, 0) AS realized_variance, coalesce(last_value(sqrt(v) IGNORE NULLS) OVER w, 0) AS ewm_volatility,
 coalesce(last_value(CASE WHEN u >= d THEN 1 ELSE -1 END * sqrt(abs(u - d)) IGNORE NULLS) OVER w, 0) AS directional_volatility FROM (
 SELECT *, coalesce(sum(spread) OVER k, 0) AS ss, coalesce(sum(spread * spread) OVER k, 0) AS sq, count(spread) OVER k AS sn,
 list_sum(list_transform([count(*) FILTER (tick > 0) OVER n, count(*) FILTER (tick < 0) OVER n, count(*) FILTER (tick = 0) OVER n], lambda c: CASE WHEN c > 0 THEN -(c / (count(*) OVER n)::DOUBLE) * log2(c / (count(*) OVER n)::DOUBLE) ELSE 0 END)) AS te
 FROM smp WINDOW k AS (PARTITION BY instrument ORDER BY h ROWS {K - 1} PRECEDING), n AS (PARTITION BY instrument ORDER BY h ROWS {N - 1} PRECEDING)) LEFT JOIN ewm USING (instrument, h)
 WINDOW w AS (PARTITION BY instrument ORDER BY h)""",
    "shape": f"""SELECT instrument, g, max(CASE WHEN level = 0 AND ap > 0 THEN ap * {P.tick} END) AS a0, max(CASE WHEN level = 0 AND bp > 0 THEN bp * {P.tick} END) AS b0,
 sum(exp(-{P.ofi_decay} * level) * (bd * bs - ad * az)) AS ofi, sum(bs)::DOUBLE AS bdep, sum(az)::DOUBLE AS adep,
 sum(CASE level WHEN 0 THEN bp * bs WHEN 1 THEN -bp * bs ELSE 0 END) * {P.tick} / nullif(sum(CASE WHEN level < 2 THEN bs END), 0) + sum(CASE level WHEN 0 THEN ap * az WHEN 1 THEN -ap * az ELSE 0 END) * {P.tick} / nullif(sum(CASE WHEN level < 2 THEN az END), 0) AS price_gap
 FROM arr GROUP BY ALL""",
    "near": f"""SELECT instrument, g, sum(CASE WHEN level < {P.stress_levels} AND bs >= {P.stress_size} THEN exp(-{P.stress_decay} * (b0 - bp * {P.tick})) * bs ELSE 0 END) + sum(CASE WHEN level < {P.stress_levels} AND az >= {P.stress_size} THEN exp(-{P.stress_decay} * (ap * {P.tick} - a0)) * az ELSE 0 END) AS liq,
 coalesce(sum(CASE WHEN bp > 0 THEN abs(ln((a0 + b0) / 2) - ln(bp * {P.tick})) * bs ELSE 0 END) / nullif(any_value(bdep), 0), 0) + coalesce(sum(CASE WHEN ap > 0 THEN abs(ln((a0 + b0) / 2) - ln(ap * {P.tick})) * az ELSE 0 END) / nullif(any_value(adep), 0), 0) AS lob_slope
 FROM arr JOIN shape USING (instrument, g) GROUP BY ALL""",
    "per": f"SELECT instrument, greatest(ts_us // {S} + 1, (SELECT g0 FROM bounds)) AS g, count(*) FILTER (action = 'A' AND accepted) AS adds, max(ts_us) AS last_us FROM judged GROUP BY ALL",
    "lastt": f"SELECT instrument, greatest(ts_us // {S} + 1, (SELECT g0 FROM bounds)) AS g, max(seq) AS tseq FROM trades GROUP BY ALL",
    "clock": f"SELECT greatest(ts_us // {S} + 1, (SELECT g0 FROM bounds)) AS g, max(ts_us) AS clock_us FROM mbo GROUP BY ALL",
    "snap": """SELECT x.*, coalesce(adds, 0) AS adds2, last_value(last_us IGNORE NULLS) OVER w AS lus, last_value(tseq IGNORE NULLS) OVER w AS ts2, last_value(clock_us IGNORE NULLS) OVER w AS cus
 FROM shape x LEFT JOIN per USING (instrument, g) LEFT JOIN lastt USING (instrument, g) LEFT JOIN clock USING (g) WINDOW w AS (PARTITION BY instrument ORDER BY g)""",
    "wide": f"""SELECT s.instrument, s.g, (a0 + b0) / 2 AS midprice, ln(a0) - ln(b0) AS log_spread, coalesce(ln((a0 + b0) / 2) - ln(lag((a0 + b0) / 2, {L}) OVER w), 0) AS log_return,
 ewm_volatility, realized_variance, directional_volatility, spread_volatility, tick_direction_entropy,
 CASE WHEN coalesce(buy + sell, 0) > {P.min_volume} THEN ofi / (buy + sell) ELSE 0 END AS ofi_raw, coalesce((buy - sell) / nullif(buy + sell, 0)::DOUBLE, 0) AS signed_volume_pressure,
 coalesce(adds2 / nullif((lus - lag(lus) OVER w) / 1e6, 0), 0) AS order_arrival_rate, coalesce((bdep - adep) / nullif(bdep + adep, 0), 0) AS depth_imbalance, bdep + adep AS market_depth, lob_slope, price_gap,
 CASE WHEN n > 1 THEN flips / n::DOUBLE ELSE 0 END AS reversal_rate, net / n::DOUBLE AS aggressor_bias,
 CASE WHEN n > 0 THEN CASE WHEN buys > 0 THEN -(buys / n::DOUBLE) * log2(buys / n::DOUBLE) ELSE 0 END + CASE WHEN n > buys THEN -((n - buys) / n::DOUBLE) * log2((n - buys) / n::DOUBLE) ELSE 0 END ELSE 0 END AS shannon_entropy,
 CASE WHEN lag(liq) OVER w > 0 THEN -(liq - lag(liq) OVER w) / lag(liq) OVER w ELSE 0 END AS stress_raw
 FROM snap s JOIN near USING (instrument, g) LEFT JOIN trades t ON t.seq = s.ts2 LEFT JOIN ring r ON r.instrument = s.instrument AND r.h = s.cus // {U} WINDOW w AS (PARTITION BY s.instrument ORDER BY s.g)""",
    "emas": f"""SELECT a.instrument, a.g, sum({P.ofi_alpha} * pow(1 - {P.ofi_alpha}, a.g - b.g) * coalesce(b.ofi_raw, 0)) AS ofi, sum({P.stress_alpha} * pow(1 - {P.stress_alpha}, a.g - b.g) * coalesce(b.stress_raw, 0)) AS liquidity_stress
 FROM wide a JOIN wide b ON a.instrument = b.instrument AND b.g <= a.g GROUP BY ALL""",
    "series": "SELECT instrument AS k, ts_us // 86400000000 AS day, row_number() OVER (PARTITION BY instrument, ts_us // 86400000000 ORDER BY seq)::INT AS t, (order_id % 3)::INT AS regime, price_ticks::DOUBLE AS v, size::DOUBLE AS u, ts_us FROM mbo",
    "pairs": "SELECT day, t, a.regime AS a, a.v AS x, b.regime AS b, b.v AS y FROM (SELECT * FROM series WHERE k = 'SPOT') a JOIN (SELECT * FROM series WHERE k = 'FUT') b USING (day, t)",
}
NEEDS = {
    "mbo": "", "judged": "mbo", "vers": "judged", "bounds": "mbo", "grid": "bounds", "hours": "bounds", "lv": "vers grid", "top": "lv", "arr": "top", "best": "vers hours", "trades": "mbo", "smp": "best", "rets": "smp", "ewm": "rets",
    "ring": "smp ewm", "shape": "arr", "near": "shape", "per": "judged bounds", "lastt": "trades bounds", "clock": "mbo bounds", "snap": "shape per lastt clock", "wide": "snap near trades ring", "emas": "wide", "series": "mbo", "pairs": "series",
}


def _with(need: str, sql: str) -> str:
    seen: list[str] = []

    def add(n: str) -> None:
        if n not in seen:
            for m in NEEDS[n].split():
                add(m)
            seen.append(n)

    for n in need.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in seen) + f"\n{sql}"


RAW = FEATURES
_LAG = lambda d: f"(SELECT b AS cur, lag(b) OVER o AS prev, lag(a, {d}) OVER o AS past FROM pairs WINDOW o AS (PARTITION BY day ORDER BY t))"
_H = lambda d, c: f"(SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM {_LAG(d)} WHERE prev IS NOT NULL AND past IS NOT NULL GROUP BY {c}))"
#: z-scores; the variance counts as none below 1e-12 of the mean square about the mean of the whole key (window o)
_Z = lambda c: f"({c} - avg({c}) OVER w) / CASE WHEN var_pop({c}) OVER w > 1e-12 * (var_pop({c}) OVER w + pow(avg({c}) OVER w - avg({c}) OVER o, 2)) THEN stddev_pop({c}) OVER w ELSE 1 END"
_CORR = ["price_ticks", "size", "order_id"]

ORACLES = {
    "mbo_events": _with("mbo", "SELECT * FROM mbo"),
    "contract_filter": _with("mbo", "SELECT instrument, action, count(*) AS n, sum(size)::BIGINT AS volume FROM mbo WHERE NOT (instrument = 'FUT' AND order_id % 10 <> 3) GROUP BY ALL"),
    "clock_audit": _with("mbo", "SELECT day, count(*) AS n, sum(late)::BIGINT AS late FROM (SELECT ts_us // 86400000000 AS day, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY ts_us // 86400000000 ORDER BY seq) THEN 1 ELSE 0 END AS late FROM mbo) GROUP BY day"),
    "session_bounds": _with("mbo", "SELECT strftime(d, '%Y%m%d') AS date, (epoch_us(d) + 48600000000) * 1000 AS start_ns, (epoch_us(d) + 72000000000) * 1000 AS end_ns FROM (SELECT DISTINCT date_trunc('day', make_timestamp(ts_us)) AS d FROM mbo)"),
    "systematic_sample": _with("series", "SELECT k, day, t, regime, v FROM series WHERE t % 50 = 1"),
    "accepted_events": _with("judged", "SELECT seq, instrument, order_id, action, accepted FROM judged"),
    "rejected_audit": _with("judged", "SELECT instrument, action, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM judged WHERE action <> 'T' GROUP BY ALL"),
    "unknown_orders": _with("mbo", "SELECT seq, instrument, order_id, action FROM mbo m WHERE action IN ('M', 'C') AND NOT EXISTS (SELECT 1 FROM mbo a WHERE a.action = 'A' AND a.instrument = m.instrument AND a.order_id = m.order_id AND a.seq < m.seq)"),
    "order_versions": _with("vers", "SELECT * FROM vers"),
    "book_levels": _with("top", "SELECT instrument, g, side, level, price_ticks, size FROM top"),
    "book_depth_change": _with("arr", "SELECT instrument, g, level, bd AS bid_d, ad AS ask_d FROM arr"),
    "book_best_prices": _with("best", "SELECT instrument, h AS g, bid, ask, (bid + ask) / 2.0 AS mid, (ask - bid)::DOUBLE AS spread FROM best"),
    "merged_stream": _with("mbo", "SELECT seq, ts_us, instrument, CASE WHEN instrument = 'SPOT' THEN 0 ELSE 1 END AS rank, (row_number() OVER (ORDER BY ts_us, CASE WHEN instrument = 'SPOT' THEN 0 ELSE 1 END, seq))::INT - 1 AS position FROM mbo WHERE ts_us <= (SELECT min(m) FROM (SELECT max(ts_us) AS m FROM mbo GROUP BY instrument))"),
    "aligned_snapshots": _with("lv", "SELECT * FROM (SELECT g, (max(price_ticks) FILTER (side = 'B') + min(price_ticks) FILTER (side = 'A')) / 2.0 AS base_mid, (min(price_ticks) FILTER (side = 'A') - max(price_ticks) FILTER (side = 'B'))::DOUBLE AS base_spread FROM lv WHERE instrument = 'SPOT' GROUP BY g) JOIN (SELECT g, (max(price_ticks) FILTER (side = 'B') + min(price_ticks) FILTER (side = 'A')) / 2.0 AS future_mid, (min(price_ticks) FILTER (side = 'A') - max(price_ticks) FILTER (side = 'B'))::DOUBLE AS future_spread FROM lv WHERE instrument = 'FUT' GROUP BY g) USING (g)"),
    "trade_windows": _with("trades", "SELECT seq, instrument, buy, sell, n, net::BIGINT AS net, buys, flips FROM trades"),
    "adds_per_snapshot": _with("judged", f"SELECT instrument, ts_us // {S} + 1 AS g, count(*) AS adds FROM judged WHERE accepted AND action = 'A' GROUP BY ALL"),
    "sample_windows": _with("ring", "SELECT instrument, h, round(spread_volatility, 8) AS spread_volatility, round(tick_direction_entropy, 8) AS tick_direction_entropy, round(realized_variance, 8) AS realized_variance, round(ewm_volatility, 8) AS ewm_volatility, round(directional_volatility, 8) AS directional_volatility FROM ring"),
    "features_raw": _with("wide emas", f"SELECT instrument, g * {S} * 1000 AS timestamp_ns, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in RAW)} FROM wide JOIN emas USING (instrument, g)"),
    "features_norm": _with("wide emas", f"SELECT instrument, g AS grid, {', '.join(f'round({_Z(c)}, 4) AS {c}' for c in RAW)} FROM (SELECT * FROM wide JOIN emas USING (instrument, g)) WINDOW w AS (PARTITION BY instrument ORDER BY g ROWS {Z - 1} PRECEDING), o AS (PARTITION BY instrument)"),
    "zscore": _with("series", f"SELECT k, day, t, round({_Z('v')}, 5) AS v, round({_Z('u')}, 5) AS u, round({_Z('s')}, 5) AS s FROM (SELECT *, u / 1e6 AS s FROM series) WINDOW w AS (PARTITION BY k, day ORDER BY t ROWS {Z - 1} PRECEDING), o AS (PARTITION BY k, day)"),
    "ema": _with("series", "SELECT a.k, a.day, a.t, a.u, round(sum(0.2 * pow(0.8, a.t - b.t) * b.u), 6) AS e2, round(sum(0.1 * pow(0.9, a.t - b.t) * b.u), 6) AS e1 FROM series a JOIN series b ON a.k = b.k AND a.day = b.day AND b.t <= a.t GROUP BY ALL"),
    "event_count_trigger": _with("mbo", "SELECT instrument, k, seq FROM (SELECT instrument, seq, row_number() OVER (PARTITION BY instrument ORDER BY seq)::INT AS k FROM mbo) WHERE k % 100 = 0"),
    "label_durations": _with("series", "SELECT regime, round(avg(duration), 6) AS mean_duration, round(median(duration), 6) AS median_duration, count(*) AS runs FROM (SELECT k, day, i, regime, count(*) AS duration FROM (SELECT *, sum(c) OVER (PARTITION BY k, day ORDER BY t) AS i FROM (SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER (PARTITION BY k, day ORDER BY t) THEN 0 ELSE 1 END AS c FROM series)) GROUP BY ALL) GROUP BY regime"),
    "variance_table": _with("series", "SELECT 'v' AS feature, round(var_pop(v), 4) AS var_pop, round(var_samp(v), 4) AS var_samp FROM series UNION ALL SELECT 'u', round(var_pop(u), 4), round(var_samp(u), 4) FROM series"),
    "regime_means": _with("series", "SELECT regime, count(*) AS rows, round(avg(v), 6) AS v, round(avg(u), 6) AS u FROM series GROUP BY regime"),
    "autocorrelation": _with("series", "SELECT a.k, (b.t - a.t)::INT AS lag, round(corr(b.v, a.v), 6) AS rho FROM series a JOIN series b ON a.k = b.k AND a.day = b.day AND b.t - a.t BETWEEN 1 AND 20 GROUP BY ALL"),
    "series_summary": _with("series", "SELECT k, round(corr(v, y), 4) AS rho1, round(stddev_samp(v), 4) AS std, round(stddev_samp(v - y), 4) AS delta_std, round(stddev_samp(v) / nullif(avg(v), 0), 4) AS coef_var FROM (SELECT k, v, lag(v) OVER (PARTITION BY k, day ORDER BY t) AS y FROM series) GROUP BY k"),
    "correlation_matrix": _with("mbo", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM mbo" for i, a in enumerate(_CORR) for b in _CORR[i:])),
    "standard_scaler": _with("series", "SELECT k, day, t, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS v, round((u - avg(u) OVER ()) / stddev_pop(u) OVER (), 6) AS u FROM series"),
    "cluster_scores": _with("series", ", c AS (SELECT regime, count(*) AS n, avg(v) AS cv, avg(u) AS cu FROM series GROUP BY 1), i AS (SELECT regime, any_value(n) AS n, any_value(cv) AS cv, any_value(cu) AS cu, sum((v - cv) ** 2 + (u - cu) ** 2) AS w, avg(sqrt((v - cv) ** 2 + (u - cu) ** 2)) AS s FROM series JOIN c USING (regime) GROUP BY 1), m AS (SELECT avg(v) AS mv, avg(u) AS mu FROM series) SELECT round((sum(n * ((cv - mv) ** 2 + (cu - mu) ** 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 4) AS calinski_harabasz, (SELECT round(avg(r), 4) FROM (SELECT x.regime, max((x.s + y.s) / sqrt((x.cv - y.cv) ** 2 + (x.cu - y.cu) ** 2)) AS r FROM i x JOIN i y ON x.regime <> y.regime GROUP BY 1)) AS davies_bouldin FROM i, m"),
    "silhouette": _with("series", ", p AS (SELECT row_number() OVER () AS i, regime AS y, v, u FROM series), q AS (SELECT a.i, a.y, b.y AS z, sum(sqrt((a.v - b.v) * (a.v - b.v) + (a.u - b.u) * (a.u - b.u))) AS s, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3), r AS (SELECT i, max(CASE WHEN z = y AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN z <> y THEN s / n END) AS b FROM q GROUP BY 1) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette, count(*) AS points FROM r"),
    "crosstab": _with("pairs", "SELECT a, count(*) FILTER (b = 0) AS b0, count(*) FILTER (b = 1) AS b1, count(*) FILTER (b = 2) AS b2 FROM pairs GROUP BY a"),
    "cross_correlation": _with("pairs", "SELECT (p.t - q.t)::INT AS lag, round(corr(p.x, q.y), 6) AS rho FROM pairs p JOIN pairs q ON p.day = q.day AND p.t - q.t BETWEEN -20 AND 20 GROUP BY 1"),
    "transitions": _with("series", "SELECT k, prev, cur, count(*) AS n FROM (SELECT k, regime AS cur, lag(regime) OVER (PARTITION BY k, day ORDER BY t) AS prev FROM series) WHERE prev IS NOT NULL GROUP BY ALL"),
    "lag_transitions": _with("pairs", f"SELECT prev, past, cur, count(*) AS n FROM {_LAG(3)} WHERE prev IS NOT NULL AND past IS NOT NULL GROUP BY ALL"),
    "likelihood_ratio": _with("pairs", f", r AS (SELECT * FROM {_LAG(10)} WHERE prev IS NOT NULL AND past IS NOT NULL), a AS (SELECT sum(n * ln(n / s)) AS ll0 FROM (SELECT n, sum(n) OVER (PARTITION BY prev) AS s FROM (SELECT prev, cur, count(*) AS n FROM r GROUP BY ALL))), b AS (SELECT sum(n * ln(n / s)) AS ll1 FROM (SELECT n, sum(n) OVER (PARTITION BY prev, past) AS s FROM (SELECT prev, past, cur, count(*) AS n FROM r GROUP BY ALL))) SELECT round(ll0, 4) AS ll0, round(ll1, 4) AS ll1, round(2 * (ll1 - ll0), 4) AS stat, 12 AS df, round(exp(ll0 - ll1) * (1 + (ll1 - ll0) + pow(ll1 - ll0, 2) / 2 + pow(ll1 - ll0, 3) / 6 + pow(ll1 - ll0, 4) / 24 + pow(ll1 - ll0, 5) / 120), 4) AS p_value FROM a, b"),
    "cmi": _with("pairs", " UNION ALL ".join(f"SELECT {d} AS lag, round({_H(d, 'cur, prev')} + {_H(d, 'prev, past')} - {_H(d, 'prev')} - {_H(d, 'cur, prev, past')}, 8) AS cmi" for d in range(1, 6))),
    "granger": _with("pairs", " UNION ALL ".join(f"SELECT '{d}' AS direction, n, round(n * (v0 - c01 * c01 / v1), 2) AS ssr_restricted, round(ssr, 2) AS ssr_full, round((n * (v0 - c01 * c01 / v1) - ssr) / (ssr / (n - 3)), 4) AS f FROM (SELECT *, n * (v0 - (c01 * c01 * v2 - 2 * c01 * c02 * c12 + c02 * c02 * v1) / (v1 * v2 - c12 * c12)) AS ssr FROM (SELECT count(*) AS n, var_pop(y0) AS v0, var_pop(y1) AS v1, var_pop(x1) AS v2, covar_pop(y0, y1) AS c01, covar_pop(y0, x1) AS c02, covar_pop(y1, x1) AS c12 FROM (SELECT {y} AS y0, lag({y}) OVER o AS y1, lag({x}) OVER o AS x1 FROM pairs WINDOW o AS (PARTITION BY day ORDER BY t)) WHERE y1 IS NOT NULL))" for d, y, x in (("forward", "y", "x"), ("backward", "x", "y")))),
    "adf": _with("pairs", ", r AS (SELECT y - l AS d, l, l - l2 AS d1 FROM (SELECT y, lag(y) OVER o AS l, lag(y, 2) OVER o AS l2 FROM pairs WINDOW o AS (PARTITION BY day ORDER BY t)) WHERE l IS NOT NULL), m AS (SELECT count(*) AS n, var_pop(d) AS vd, var_pop(l) AS vl, var_pop(d1) AS v1, covar_pop(d, l) AS cl, covar_pop(d, d1) AS c1, covar_pop(l, d1) AS cc FROM r WHERE d1 IS NOT NULL), f AS (SELECT *, vl * v1 - cc * cc AS det, n * (vd - (cl * cl * v1 - 2 * cl * c1 * cc + c1 * c1 * vl) / (vl * v1 - cc * cc)) AS ssr1, n * (vd - cl * cl / vl) AS ssr0 FROM m), z AS (SELECT count(*) AS n, var_pop(d) AS vd, var_pop(l) AS vl, covar_pop(d, l) AS cl FROM r) SELECT CASE WHEN one THEN 1 ELSE 0 END AS used_lag, CASE WHEN one THEN f.n ELSE z.n END AS nobs, round(CASE WHEN one THEN (cl1 / det) / sqrt(ssr1 / (f.n - 3) * f.v1 / (f.n * det)) ELSE z.cl / z.vl / sqrt(z.n * (z.vd - z.cl * z.cl / z.vl) / (z.n - 2) / (z.n * z.vl)) END, 4) AS stat FROM (SELECT *, cl * v1 - c1 * cc AS cl1, n * ln(ssr1) + 2 < n * ln(ssr0) AS one FROM f) f, z"),
    "hayashi_yoshida": _with("series", ", u AS (SELECT k, day, ts_us, arg_max(v, t) AS v FROM series GROUP BY ALL), m AS (SELECT k, day, lag(ts_us) OVER w AS t0, ts_us AS t1, v - lag(v) OVER w AS d FROM u WINDOW w AS (PARTITION BY k, day ORDER BY ts_us)) SELECT a.day AS day, round(sum(a.d * b.d), 3) AS covariance, count(*) AS overlaps FROM m a JOIN m b ON a.day = b.day AND a.t0 < b.t1 AND b.t0 < a.t1 WHERE a.k = 'SPOT' AND b.k = 'FUT' GROUP BY a.day"),
    "stream_book": _with("judged", "SELECT seq, instrument, order_id, action, accepted FROM judged WHERE action <> 'T'"),
    "stream_snapshots": _with("vers trades judged ring", f""", own AS (SELECT instrument, min(ts_us) // {S} + 1 AS a, max(ts_us) // {S} AS b FROM mbo GROUP BY 1), gr AS (SELECT instrument, unnest(range(a, b + 1)) AS g FROM own),
 bb AS (SELECT gr.instrument, gr.g, max(price_ticks) FILTER (side = 'B') AS bid, min(price_ticks) FILTER (side = 'A') AS ask FROM gr LEFT JOIN vers v ON v.instrument = gr.instrument AND v.start_us < gr.g * {S} AND (v.end_us IS NULL OR v.end_us >= gr.g * {S}) GROUP BY ALL),
 lt AS (SELECT gr.instrument, gr.g, max(seq) AS seq FROM gr LEFT JOIN trades t ON t.instrument = gr.instrument AND t.ts_us < gr.g * {S} GROUP BY ALL),
 ad AS (SELECT instrument, ts_us // {S} + 1 AS g, count(*) AS adds FROM judged WHERE accepted AND action = 'A' GROUP BY ALL),
 rv AS (SELECT gr.instrument, gr.g, arg_max(realized_variance, h) AS rv FROM gr LEFT JOIN ring r ON r.instrument = gr.instrument AND r.h <= gr.g * {S // U} GROUP BY ALL)
 SELECT bb.instrument, bb.g, bid, ask, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, coalesce(n, 0) AS trades, coalesce(net, 0)::BIGINT AS net, coalesce(adds, 0) AS adds, round(coalesce(rv, 0), 8) AS realized_variance
 FROM bb JOIN lt USING (instrument, g) LEFT JOIN ad USING (instrument, g) LEFT JOIN trades t ON t.seq = lt.seq JOIN rv USING (instrument, g)"""),
    "stream_bars": _with("mbo", "SELECT instrument, ts_us // 21600000000 * 21600000000 AS start_us, count(*) AS trades, sum(size)::BIGINT AS volume, sum(CASE WHEN side = 'B' THEN size ELSE -size END)::BIGINT AS signed_volume FROM mbo WHERE action = 'T' GROUP BY ALL"),
    "feature_summary": _with("wide emas", "SELECT feature, round(corr(v, y), 4) AS rho1, round(stddev_samp(v), 4) AS std, round(stddev_samp(v - y), 4) AS delta_std, round(stddev_samp(v) / nullif(avg(v), 0), 4) AS coef_var FROM (SELECT feature, v, lag(v) OVER (PARTITION BY instrument, feature ORDER BY g) AS y FROM (" + " UNION ALL ".join(f"SELECT instrument, g, '{c}' AS feature, {c}::DOUBLE AS v FROM wide" for c in MODEL) + ")) GROUP BY feature"),
    "label_counts": _with("series", "SELECT regime, count(*) AS rows FROM series GROUP BY regime"),
    "distribution": _with("series", " UNION ALL ".join(f"SELECT '{c}' AS feature, least(floor(({c} - lo) / st), 19)::INT AS bin, round(lo + least(floor(({c} - lo) / st), 19) * st, 6) AS low, count(*) AS rows FROM series, (SELECT min({c}) AS lo, (max({c}) - min({c})) / 20 AS st FROM series) GROUP BY ALL" for c in ("v", "u"))),
    "replay_until": _with("mbo", "SELECT instrument, count(*) AS n, max(ts_us) AS clock_us, CASE WHEN ts_us <= 1705000000000000 THEN 'done' ELSE 'rest' END AS part FROM mbo GROUP BY ALL"),
    "first_events": _with("mbo", "SELECT seq, instrument, action FROM mbo ORDER BY ts_us, seq LIMIT 100"),
    "latest_features": _with("wide", f"SELECT instrument, g * {S} * 1000 AS timestamp_ns, round(midprice, 6) AS midprice FROM wide WHERE instrument = 'SPOT' ORDER BY g DESC LIMIT 100"),
    "model_columns": _with("wide emas", f"SELECT instrument, g * {S} * 1000 AS timestamp_ns, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in MODEL)} FROM wide"),
}
