"""Gaussian hidden Markov model: Baum-Welch, Viterbi, posteriors and score, one sequence (a date) a task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class GaussianHMM:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covars: np.ndarray
    log_likelihood: float = float("nan")
    iterations: int = 0

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.start)))
        for k, (m, c) in enumerate(zip(self.means, self.covars, strict=True)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def passes(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, posteriors and expected transitions, by scaled forward and backward passes."""
        d = self.log_density(x)
        top = d.max(1, keepdims=True)
        b = np.exp(d - top)
        n, k = b.shape
        alpha, scale = np.empty((n, k)), np.empty(n)
        a = self.start * b[0]
        for t in range(n):
            if t:
                a = (alpha[t - 1] @ self.trans) * b[t]
            scale[t] = max(a.sum(), 1e-300)
            alpha[t] = a / scale[t]
        beta = np.ones((n, k))
        xi = np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            w = b[t + 1] * beta[t + 1] / scale[t + 1]
            xi += self.trans * np.outer(alpha[t], w)
            beta[t] = self.trans @ w
        gamma = alpha * beta
        return float(np.log(scale).sum() + top.sum()), gamma / gamma.sum(1, keepdims=True), xi

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        d, lt = self.log_density(x), np.log(np.maximum(self.trans, 1e-300))
        v = np.log(np.maximum(self.start, 1e-300)) + d[0]
        back = np.zeros((len(x), len(v)), int)
        for t in range(1, len(x)):
            s = v[:, None] + lt
            back[t] = s.argmax(0)
            v = s.max(0) + d[t]
        path = [int(v.argmax())]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return np.array(path[::-1])


def fit_hmm(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], states: int = 4, iterations: int = 500, seed: int = 45, tol: float = 1e-2) -> GaussianHMM:
    """Baum-Welch over all sequences. Each task makes the expected counts of its sequence; their sums, whose size is that of
    the model, come to the driver, which sets the model anew. Starts from k-means++ centres of a sample of 10,000 rows."""
    d = len(columns)
    own = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop().cache()
    first = own.orderBy(F.xxhash64(*keys, order), order).select(*columns).limit(10_000).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    centres = [first[rng.integers(len(first))]]
    while len(centres) < states:
        gap = np.min([((first - c) ** 2).sum(1) for c in centres], 0)
        centres.append(first[rng.choice(len(first), p=gap / gap.sum())] if gap.sum() > 0 else first[rng.integers(len(first))])
    means = np.array(centres)
    for _ in range(20):
        at = ((first[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([first[at == k].mean(0) if (at == k).any() else means[k] for k in range(states)])
    cov = np.cov(first.T).reshape(d, d) + 1e-6 * np.eye(d)
    model = GaussianHMM(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), means, np.array([cov] * states))
    schema = "stats array<double>"

    def e_step(m: GaussianHMM):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values(order)[list(columns)].to_numpy(float)
            ll, g, xi = m.passes(x)
            parts = [[ll, len(x)], g[0], xi.ravel(), g.sum(0), (g.T @ x).ravel(), np.einsum("tk,ti,tj->kij", g, x, x).ravel()]
            return pd.DataFrame({"stats": [np.concatenate(parts).tolist()]})

        return run

    try:
        for it in range(iterations):
            sums = own.groupBy(*keys).applyInPandas(e_step(model), schema).select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
            s = np.array([r.v for r in sums])
            ll, at = s[0], 2
            cut = lambda n: s[at : at + n]  # noqa: B023, E731
            start = cut(states)
            at += states
            xi = cut(states * states).reshape(states, states)
            at += states * states
            n = np.maximum(cut(states), 1e-10)
            at += states
            sx = cut(states * d).reshape(states, d)
            at += states * d
            sxx = cut(states * d * d).reshape(states, d, d)
            means = sx / n[:, None]
            covars = np.array([sxx[k] / n[k] - np.outer(means[k], means[k]) + 1e-6 * np.eye(d) for k in range(states)])
            gain = ll - model.log_likelihood
            model = GaussianHMM(start / start.sum(), (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True), means, covars, float(ll), it + 1)
            if gain < tol and it:
                break
    finally:
        own.unpersist()
    return model


def score(df: DataFrame, model: GaussianHMM, keys: Sequence[str], order: str, columns: Sequence[str]) -> tuple[float, int]:
    """Log-likelihood of a table's sequences under a model, and how many rows they have; each sequence is scored apart."""
    own = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[list(columns)].to_numpy(float)
        return pd.DataFrame({"ll": [model.passes(x)[0]], "n": [len(x)]})

    r = own.groupBy(*keys).applyInPandas(run, "ll double, n long").agg(F.sum("ll"), F.sum("n")).first()
    return float(r[0] or 0.0), int(r[1] or 0)


def decode(df: DataFrame, model: GaussianHMM, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """keys, order, regime (the Viterbi path), posterior (array of double): one group a sequence."""
    own = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    schema = T.StructType([*[own.schema[k] for k in keys], own.schema[order], T.StructField("regime", T.IntegerType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[list(columns)].to_numpy(float)
        return pdf[[*keys, order]].assign(regime=model.viterbi(x).astype("int32"), posterior=list(model.passes(x)[1].tolist()))

    return own.groupBy(*keys).applyInPandas(run, schema)


def save_hmm(spark, model: GaussianHMM, path: str) -> None:
    rows = [("start", model.start), ("trans", model.trans), ("means", model.means), ("covars", model.covars), ("fit", np.array([model.log_likelihood, model.iterations]))]
    spark.createDataFrame([(n, list(a.shape), a.ravel().tolist()) for n, a in rows], "name string, shape array<long>, data array<double>").write.mode("overwrite").parquet(path)


def load_hmm(spark, path: str) -> GaussianHMM:
    a = {r.name: np.array(r.data).reshape(r.shape) for r in spark.read.parquet(path).collect()}
    return GaussianHMM(a["start"], a["trans"], a["means"], a["covars"], float(a["fit"][0]), int(a["fit"][1]))


def pca(df: DataFrame, columns: Sequence[str], ratio: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """Components that hold `ratio` of the variance of the standardised columns, and the shares of all, from the
    correlation matrix: one aggregate of the data. A column without spread has no variance to hold; if none has any, there
    are no components."""
    from ticklattice.operators.diagnostics import correlations

    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in correlations(df, columns).collect():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = 0.0 if r.rho is None or r.rho != r.rho else r.rho
    val, vec = np.linalg.eigh(m)
    val, vec = val[::-1], vec[:, ::-1]
    if val.sum() <= 0:
        return vec[:, :0], np.zeros(len(val))
    share = val / val.sum()
    k = int(np.searchsorted(np.cumsum(share), ratio - 1e-12)) + 1
    return vec[:, :k] * np.sign(vec[np.abs(vec).argmax(0), np.arange(len(val))])[:k], share


def project(df: DataFrame, columns: Sequence[str], components: np.ndarray) -> DataFrame:
    """df's standardised columns on the components, pc1, pc2, ..., beside the other columns."""
    from ticklattice.operators.diagnostics import standardised

    z = standardised(df, columns)
    pcs = {f"pc{j + 1}": sum((F.col(c) * float(components[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(components.shape[1])}
    return z.withColumns(pcs).drop(*columns)
