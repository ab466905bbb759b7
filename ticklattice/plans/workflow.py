"""The research workflow: fit regimes, label, check and report, for one number of regimes or for a sweep."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.operators import diagnostics, hmm
from ticklattice.params import FEATURES, MODEL
from ticklattice.sources.sinks import METRICS, append_metrics, write_labelled, write_report


@dataclass
class Run:
    """A model, its labels (keys, order, regime, posterior), one row of metrics, and the report's tables."""

    model: hmm.GaussianHMM
    labels: DataFrame
    metrics: DataFrame
    report: dict[str, DataFrame]


def classify(table: DataFrame, keys: Sequence[str], order: str, states: int = 4, columns: Sequence[str] = MODEL, iterations: int = 500, sample: int = 20000) -> Run:
    """Regimes of a feature table: columns standardised, a hidden Markov model over the sequences `keys`, labels, and checks."""
    own = table.na.drop(subset=list(columns))
    z = diagnostics.standardised(own.select(*keys, order, *columns), columns)
    model = hmm.fit_hmm(z, keys, order, columns, states=states, iterations=iterations)
    labels = hmm.decode(z, model, keys, order, columns)
    labelled = z.join(labels.select(*keys, order, "regime"), [*keys, order])
    ll, n = hmm.score(z, model, keys, order, columns)
    spark, crit = table.sparkSession, diagnostics.information_criteria(ll, n, states, len(columns))
    fit = spark.createDataFrame([(states, crit["aic"], crit["bic"], ll)], "regimes int, aic double, bic double, log_likelihood double")
    scores = diagnostics.cluster_scores(labelled, columns).crossJoin(diagnostics.silhouette(labelled, columns, sample=sample).select("silhouette"))  # a row each
    metrics = fit.crossJoin(scores).select(*[c.split()[0] for c in METRICS.split(", ")])
    report = {
        "variances": diagnostics.variances(own, columns),
        "durations": diagnostics.durations(labelled, keys, order).orderBy("regime"),
        "regime_means": diagnostics.regime_means(labelled, columns).orderBy("regime"),
        "label_counts": diagnostics.label_counts(labelled).orderBy("regime"),
        "distribution": diagnostics.distribution(own, columns).orderBy("feature", "bin"),
    }
    return Run(model, labels, metrics, report)


def sweep(table: DataFrame, keys: Sequence[str], order: str, states: Iterable[int] = range(3, 8), **more) -> dict[int, Run]:
    """classify for each number of regimes."""
    own = table.cache()
    try:
        return {k: classify(own, keys, order, states=k, **more) for k in states}
    finally:
        own.unpersist()


def write_run(run: Run, table: DataFrame, keys: Sequence[str], order: str, path: str) -> None:
    """Labelled table, model, report and a row of metrics (path/metrics takes those of all runs)."""
    k = len(run.model.start)
    write_labelled(table, run.labels, [*keys, order], f"{path}/labelled_{k}")
    write_report(run.report, f"{path}/report_{k}")
    hmm.save_hmm(table.sparkSession, run.model, f"{path}/model_{k}")
    append_metrics(run.metrics, f"{path}/metrics")


def posterior_series(labels: DataFrame, keys: Sequence[str], order: str, prefix: str, states: int) -> DataFrame:
    """k, t and a column for each regime's posterior, as granger_pairs takes them; k is the sequence."""
    return labels.select(F.concat_ws("/", *keys).alias("k"), F.col(order).alias("t"), *[F.col("posterior")[i].alias(f"{prefix}{i}") for i in range(states)])


def systematic(table: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """Every step-th row of each key, from the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return table.withColumn("__i", F.row_number().over(w)).where(F.col("__i") % step == F.lit(1 % step)).drop("__i")


def summary(table: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str] = FEATURES) -> DataFrame:
    """feature, rho1, std, delta_std, coef_var of each column over all sequences, rounded to 4 digits, the highest
    autocorrelation first (a row a feature)."""
    long = diagnostics.stacked(table, columns, *keys, order)
    out = diagnostics.series_summary(long, ["feature"], order, "value", within=keys)
    return out.select("feature", *[F.round(c, 4).alias(c) for c in ("rho1", "std", "delta_std", "coef_var")]).orderBy(F.col("rho1").desc(), "feature")
