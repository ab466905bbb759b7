"""Operator 9, toxicity: maximal-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklattice.llm._util import as_table, map_text
from ticklattice.llm.quality import labelled_sample

#: ASCII punctuation and control characters part tokens as white space does.
_PARTS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Runs of letters, digits and bytes past ASCII, A-Z lower-cased, in UTF-8."""
    return text.encode().lower().translate(_PARTS).split()


#: Lengths in bytes of the prefixes that stand for words of one stem, longest first, and the mark that tells them from words.
PREFIXES = (6, 4)
MARK = b"~"
#: Distinct words that a worker remembers at once.
REMEMBERED = 200_000


def stems(word: bytes) -> list[bytes]:
    """The word itself, then its marked prefixes, the longest first. Prefixes keep whole characters."""
    cut = [word[:n].decode(errors="ignore").encode() for n in PREFIXES if len(word) > n]
    return [word, *(MARK + c for c in dict.fromkeys(cut))]


def segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) of a run of scores, left to right: each holds more than any part of it
    or any extension of it (Ruzzo and Tompa's scan). Every segment keeps the place of the last one before it that begins
    lower, and searches go from place to place, so the scan is linear however the scores drift."""
    total, found = 0.0, []  # start, end, sum before, sum after, place of the last that begins lower
    for i, s in enumerate(scores):
        if s > 0:
            a, before = i, total
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= before:
                    j = found[j][4]
                if j < 0 or found[j][3] >= total + s:
                    break
                a, before = found[j][0], found[j][2]
                del found[j:]
            found.append((a, i + 1, before, total + s, j))
        total += s
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class ToxicityModel:
    """Scores of the terms (words, or prefixes behind MARK) that tell the classes apart, of every other token; extreme-value and logistic parameters."""

    terms: dict[bytes, float]
    other: float
    lam: float = 0.7
    k: float = 0.1
    a: float = -2.0
    b: float = 1.0

    def term_score(self, word: bytes) -> float | None:
        """The score of the word, else of its longest scored prefix, else None."""
        for t in stems(word):
            if t in self.terms:
                return self.terms[t]
        return None

    def passages(self, text: str, known: dict[bytes, float | None] | None = None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens and all maximal segments. Tokens between two scored terms only add `other` each, so the
        scan takes one step for them all; it stays exact and linear. `known` remembers words' scores between texts."""
        words, known = tokens(text), {} if known is None else known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.term_score(w)
        hits = [(i, s) for i, w in enumerate(words) if (s := known[w]) is not None]
        scores, where, at = [], [], 0
        for i, s in hits:
            if i > at:
                scores.append((i - at) * self.other)
                where.append(at)
            scores.append(s)
            where.append(i)
            at = i + 1
        where.append(at)
        return len(words), [(where[a], where[b - 1] + 1, s) for a, b, s in segments(scores)]

    def bits(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """The extreme-value evidence of the passages: a segment of sum S has the normalised score x = lambda S - ln(K n), the
        -ln of the number of such segments expected in n tokens of ordinary text. The sum t of the r best has probability
        exp(-t) t^(r-1) / (r! (r-1)!) there (Karlin and Altschul's sum statistic); of all r the strongest counts, at the
        price of r - 1 halvings for the choice. 0 without a significant segment."""
        base = math.log(max(self.k * n, 1e-9))
        best = t = 0.0
        for r, x in enumerate(sorted((x for *_, s in found if (x := self.lam * s - base) > 0), reverse=True), 1):
            t += x
            if t > r - 1:
                best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2) if r > 1 else t)
        return best

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The segments that ordinary text of n tokens has less than once."""
        base = math.log(max(self.k * n, 1e-9))
        return [x for x in found if self.lam * x[2] > base]

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.a + self.b * evidence))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge, each halved until the loss falls."""
    d = np.stack([np.ones_like(x), x], 1)

    def loss(w: np.ndarray) -> float:
        z = d @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 5e-3 * (w @ w))

    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(2), d.T @ (p - y) + 1e-2 * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
    return float(w[0]), float(w[1])


def _distinct_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int) -> DataFrame:
    """labelled_sample without most copies, which would count one author's words many times: of texts that share the least
    hash of their five-word shingles under one of two hash functions, one stays."""
    import xxhash

    def keys(texts: list[str]):
        out = []
        for t in texts:
            w = tokens(t)
            grams = [b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
            out.append([min(xxhash.xxh64_intdigest(g, seed) >> 1 for g in grams) for seed in (1, 2)])
        return list(zip(*out, strict=True)) if out else [[], []]

    own = labelled_sample(docs, labels, label_col, sample)
    own = as_table(map_text(own, "text", ["doc_id", "text", "label"], [("k1", T.LongType()), ("k2", T.LongType())], lambda: keys), "sample")
    kept = own.select("doc_id", "k1", "k2")
    for k in ("k1", "k2"):
        kept = kept.join(kept.groupBy(k).agg(F.min("doc_id").alias("first")), k).where("first = doc_id").drop("first")
    return as_table(own.join(kept.select("doc_id"), "doc_id").select("doc_id", "text", "label"), "sample")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", sample: int = 12288, z_min: float = 2.5, effect: float = 1.0
) -> ToxicityModel:
    """Learns from a sample of at most `sample` labelled documents that are not held out, copies taken out; the Dirichlet
    prior of each candidate term is its share of the words of all documents, with the weight of the toxic sample.

    Terms are words, and prefixes that stand for the words of a stem; each counts once a document, so that a long
    document's favourite word stays one witness. Those are taken whose log-odds between the classes lie z_min deviations
    and `effect` from zero; candidates are terms of two toxic documents of the sample at least, so the sample bounds the
    model. lambda solves E[exp(lambda s)] = 1
    over the words of all documents, K fits the non-toxic sample's best segments, and a logistic curve turns the
    evidence into a score. Without both classes every score is that of no evidence.
    """
    own = _distinct_sample(docs, labels, label_col, sample)
    term = T.StructType([T.StructField("w", T.StringType()), T.StructField("label", T.LongType()), T.StructField("n", T.LongType())])

    def counted(texts: list[str]) -> list[list]:
        c: Counter = Counter()
        for t in texts:
            label, _, body = t.partition(":")
            words = set(tokens(body))
            c.update((label, x) for x in {x for w in words for x in stems(w)})
            c[label, b""] += len(words)
        rows = [(w.decode(), int(label), n) for (label, w), n in c.items()]
        return [[rows if k == 0 else [] for k in range(len(texts))]]

    marked = own.select(F.concat_ws(":", F.when(F.col("label") == 1, "1").otherwise("0"), "text").alias("text"))
    by_word = as_table(
        map_text(marked, "text", [], [("c", T.ArrayType(term))], lambda: counted)
        .select(F.explode("c").alias("c"))
        .groupBy("c.w")
        .agg(F.sum(F.when(F.col("c.label") == 1, F.col("c.n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("c.label") == 0, F.col("c.n")).otherwise(0)).alias("o")),
        "terms",
    )
    sizes = by_word.where("w = ''").first()
    n_t, n_o = (float(sizes.t), float(sizes.o)) if sizes else (0.0, 0.0)
    if not n_t or not n_o:
        return ToxicityModel({}, -0.01)
    # a first look, with a prior of one document: terms that can't reach the final bounds need no background count
    lift = F.log((F.col("t") + 1) / (n_t + 1)) - F.log((F.col("o") + n_o / n_t) / (n_o + 1))
    cand = by_word.where("w <> '' and t >= 2").withColumn("z", lift * F.sqrt("t")).where(lift > effect / 2).orderBy(F.col("z").desc(), "w").collect()
    vocabulary = docs.sparkSession.sparkContext.broadcast({r.w.encode(): i for i, r in enumerate(cand)})
    size = len(cand) + 1

    def background():
        v, known = vocabulary.value, {}

        def count(texts: list[str]):
            total = np.zeros(size, np.int64)
            for t in texts:
                words = set(tokens(t))
                total[-1] += len(words)
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words.difference(known):
                    known[w] = [v[x] for x in stems(w) if x in v]
                total[list({i for w in words if (k := known[w]) for i in k})] += 1
            at = np.flatnonzero(total)
            pairs = list(zip(at.tolist(), total[at].tolist(), strict=True))
            return [[pairs if k == 0 else [] for k in range(len(texts))]]

        return count

    pair = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("n", T.LongType())]))
    sums = map_text(docs, "text", [], [("c", pair)], background).select(F.explode("c").alias("c")).groupBy("c.i").agg(F.sum("c.n").alias("n")).collect()
    every = np.zeros(size)
    for r in sums:
        every[r.i] = r.n
    share = (every[:-1] + 0.5) / (every[-1] + 1)
    t, o = (np.array([float(r[x]) for r in cand]) for x in ("t", "o"))
    alpha = n_t * share
    delta = np.log((t + alpha) / (2 * n_t - t - alpha)) - np.log((o + alpha) / (n_o + n_t - o - alpha))
    sure = (delta / np.sqrt(1 / (t + alpha) + 1 / (o + alpha)) >= z_min) & (delta >= effect)
    terms = {r.w.encode(): float(min(d, 6)) for r, d, s in zip(cand, delta, sure, strict=True) if s}
    words = sure & np.array([not r.w.startswith(MARK.decode()) for r in cand], bool)
    rest_t, rest_o = n_t - t[words].sum(), n_o - o[words].sum()
    model = ToxicityModel(terms, min(-0.01, math.log((rest_t / n_t) / (rest_o / n_o))))

    p = np.append(share[words], max(1e-9, 1 - share[words].sum()))
    s = np.append([terms[r.w.encode()] for r, x in zip(cand, words, strict=True) if x], model.other)
    lo, hi = 1e-6, 20.0
    if (p * s).sum() < 0 < s.max():
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
        model.lam = lo
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best():
        m, known = shared.value, {}

        def run(texts: list[str]):
            got = [m.passages(t, known) for t in texts]
            return [n for n, _ in got], [[x for *_, x in f] for _, f in got]

        return run

    rows = map_text(own, "text", ["label"], [("n", T.LongType()), ("s", T.ArrayType(T.DoubleType()))], best).collect()
    y, n, top = (np.array(x, float) for x in ([r.label for r in rows], [r.n for r in rows], [max(r.s, default=0.0) for r in rows]))
    plain = (y == 0) & (n > 0)
    seen = max((top[plain] > 0).sum(), 1) / max(n[plain].sum(), 1)
    model.k = float(np.clip(seen * math.exp(model.lam * (np.median(top[plain & (top > 0)]) if (plain & (top > 0)).any() else 0)), 1e-6, 1.0))
    ev = np.array([model.bits(r.n, [(0, 1, x) for x in r.s]) for r in rows])
    model.a, model.b = _logistic(ev, y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = 0.5, with_passages: bool = False) -> DataFrame:
    """`keep` columns with score (0 to 1), predicted (1 if score >= threshold) and, if asked, passages: start and end (in
    tokens) and sum of every significant maximal segment. Whole texts; null and empty ones have no evidence and get
    the score of none; repeated rows the same score; an empty table none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))

    def factory():
        m, known = shared.value, {}

        def run(texts: list[str]):
            scores, found = [], []
            for t in texts:
                n, segs = m.passages(t, known)
                scores.append(m.score(m.bits(n, segs)))
                if with_passages:
                    found.append([dict(zip(("start", "end", "score"), x, strict=True)) for x in m.significant(n, segs)])
            return [scores, [int(x >= threshold) for x in scores], *([found] if with_passages else [])]

        return run

    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType()), *([("passages", spans)] if with_passages else [])]
    return map_text(docs, text_col, keep, fields, factory)
