"""Toxicity by cumulative-link (proportional odds) ordinal regression.

P(grade > j) = sigmoid(w . x - theta_j) with one weight vector for all ordered
thresholds theta_0 < theta_1 < ..; the severity is the expected grade, the sum of
these probabilities. Features are sparse: log(1 + count) of the words and word
beginnings of a learned vocabulary, scaled by nothing else, so one strong word weighs the same in a short
and in a long text.

The vocabulary holds those whose share of toxic texts in the fitting part is
higher than chance allows: a binomial test with Bonferroni's correction over all
words tried, near copies with the same label counting once. Labels are only toxic or not, so grade 2
is *derived*, not labelled: toxic texts with more vocabulary words than the median of
those that have any are grade 2, other toxic ones grade 1. The severity above 1 therefore
measures how much telling vocabulary a toxic text holds, not a human judgement; P(grade > 0) rests on labels alone.
``OrdinalModel.calibration`` keeps, for each threshold, the mean probability and the
observed share on the held-out part. Weights and thresholds
are fitted by accelerated proximal gradient with an L1 penalty; the rejection
threshold is set on the held-out part.

Fitting uses at most ``fit_rows`` labelled documents (those with the smallest hashes
of their id); equal texts count once, with the highest label. Their features are counted and tested on the
executors. The driver gets a signature of fixed size per text, the words whose share of toxic texts
is high, and each text's counts of vocabulary words. Scoring is a map over all documents with the bounded model in
the closure: no shuffle.

Edge cases: null and empty texts have severity 0; null labels are ignored, of
repeated labels the highest counts; without labels of both kinds nothing is
rejected; repeated documents each get a row; other columns are carried along
(``filter_toxic``) or ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm import bytewords as B
from keylog.llm.common import saved, table, whole_text

FIT_ROWS = 10_000  #: bound of the labelled sample
PREFIXES = (3, 4, 5, 6)  #: lengths of word beginnings
CHANCE = 0.01  #: chance that any word without meaning enters the vocabulary
GRADES = 3
PENALTY = 2e-4
NEAR = 0.8  #: estimated Jaccard similarity of the features from which on texts are near copies
HASHES, BAND = 128, 4  #: min-hashes of a text's features (the estimate's deviation is 0.035 at NEAR), and those that must agree in a row for texts to be compared
COST = 3  #: a clean text rejected weighs as much as so many toxic ones kept
SCORES = "doc_id long, severity double, p_toxic double, grade int, rejected boolean"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """Counts of the lower-cased words of a whole text."""
    return Counter(_WORD.findall(text.lower()))


def features(found: Counter) -> Counter:
    """Words and, marked by ^, the beginnings of longer words (stems, whatever the ending)."""
    out = Counter(found)
    for w, n in found.items():
        for k in PREFIXES:
            if len(w) > k:
                out["^" + w[:k]] += n
    return out


@dataclass
class OrdinalModel:
    """weights: word -> weight; theta: ordered thresholds; cut: least P(grade > 0) that is rejected.

    calibration: per threshold (mean P(grade > j), share of texts above) on the held-out texts.
    """

    weights: dict[str, float] = field(default_factory=dict)
    theta: tuple[float, ...] = (30.0, 31.0)
    cut: float = 2.0
    calibration: tuple[tuple[float, float], ...] = ()

    def __post_init__(self) -> None:
        self.heads = {w.removeprefix("^")[:3] for w in self.weights}  # only words that begin so can weigh

    def link(self, text: str) -> float:
        """w . x of a whole text."""
        found = features(Counter({w: n for w, n in words(text).items() if w[:3] in self.heads}))
        return sum(self.weights[w] * math.log1p(found[w]) for w in sorted(found.keys() & self.weights.keys()))

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > j) by row and j."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.theta) - np.asarray(z)[:, None], -40, 40)))


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_words: int, penalty: float, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient on the cumulative-link likelihood.

    rows, cols, vals: the sparse matrix in coordinates. theta_j = theta_0 + sums of exp(gaps).
    """
    n, k = len(grades), GRADES - 1
    share = np.array([np.clip((grades > j).mean(), 1e-4, 1 - 1e-4) for j in range(k)])
    t = np.log(1 / share - 1)
    par = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 0.05))])
    w, w_old, p_old = np.zeros(n_words), np.zeros(n_words), par.copy()
    lip = 0.5 * np.bincount(rows, vals**2, minlength=n).max(initial=1.0)
    step = 8.0 / lip
    for i in range(steps):
        m = i / (i + 3)
        v, q = w + m * (w - w_old), par + m * (par - p_old)
        theta = q[0] + np.concatenate([[0], np.cumsum(np.exp(q[1:]))])
        z = np.bincount(rows, vals * v[cols], minlength=n)
        s = 1 / (1 + np.exp(np.clip(theta - z[:, None], -40, 40)))  # P(grade > j)
        upper = np.concatenate([np.ones((n, 1)), s], 1)  # P(grade >= j)
        lower = np.concatenate([s, np.zeros((n, 1))], 1)
        at = np.arange(n)
        p = np.maximum(upper[at, grades] - lower[at, grades], 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        gz = -(du[at, grades] - dl[at, grades]) / p / n
        gw = np.bincount(cols, vals * gz[rows], minlength=n_words)
        gt = np.zeros(k)  # d/d theta_j = -d/dz of the term that holds theta_j
        for j in range(k):
            gt[j] = (du[at, grades] * (grades == j + 1) / p / n).sum() - (dl[at, grades] * (grades == j) / p / n).sum()
        gq = np.concatenate([[gt.sum()], [gt[j + 1 :].sum() * np.exp(q[1 + j]) for j in range(k - 1)]])
        w_old, p_old = w, par
        x = v - step * gw
        w = np.sign(x) * np.maximum(np.abs(x) - step * penalty, 0)
        par = q - np.clip(2.0 * gq, -0.5, 0.5)  # thresholds have a curvature of their own
    return w, par[0] + np.concatenate([[0], np.cumsum(np.exp(par[1:]))])


def signature(names: list[str]) -> np.ndarray:
    """Min-hashes of a set of features; the share of equal ones in two signatures estimates the sets' Jaccard similarity."""
    if not names:
        return np.full(HASHES, 0xFFFFFFFF, dtype="<u4")
    h = np.fromiter((zlib.crc32(w.encode()) for w in names), dtype=np.uint64, count=len(names))
    out = np.full(HASHES, 0xFFFFFFFF, dtype="<u4")
    seeds = np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32)
    for i in range(0, len(h), 4096):
        out = np.minimum(out, (B.mix(h[i : i + 4096, None] + seeds) >> np.uint64(32)).min(0).astype("<u4"))
    return out


def distinct(signs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which texts to keep: all but those estimated to be NEAR a kept earlier one with the same label."""
    keep = np.ones(len(toxic), dtype=bool)
    seen: dict[tuple, list[int]] = {}
    for i, label in enumerate(toxic.tolist()):
        keys = [(label, b, signs[i, b : b + BAND].tobytes()) for b in range(0, HASHES, BAND)]
        near = sorted({j for k in keys for j in seen.get(k, ())})
        if near and ((signs[near] == signs[i]).mean(1) >= NEAR).any():
            keep[i] = False
        else:
            for k in keys:
                seen.setdefault(k, []).append(i)
    return keep


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) >= k)."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(k, h, toxic, words, counts, sign) of at most ``fit_rows`` labelled documents; k numbers the rows, h is the text's SHA-1."""
    lab = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded: it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(some), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = TaskContext.get().partitionId() << 33
        for pdf in (b[i : i + 100] for b in batches for i in range(0, len(b), 100)):
            found = [features(words(t)) for t in pdf["text"]]
            names = [list(x.keys()) for x in found]
            yield pd.DataFrame({"k": np.arange(k, k + len(pdf)), "h": pdf["h"].to_numpy(), "toxic": pdf["toxic"].to_numpy(), "words": names, "counts": [list(x.values()) for x in found], "sign": [signature(x).tobytes() for x in names]})
            k += len(pdf)
        B.trim()

    texts = rows.select(F.sha1(F.col("text").cast("binary")).alias("h"), "text", (F.col("toxic") > 0).alias("toxic"))
    return saved(texts.mapInPandas(count, "k long, h string, toxic boolean, words array<string>, counts array<int>, sign binary"), "labelled")


def vocabulary(train: DataFrame, base: float) -> list[str]:
    """The features of (words, toxic) that stand in more toxic texts than chance allows, ``base`` being the share of those."""
    seen = train.select(F.explode("words").alias("w"), F.col("toxic").cast("int").alias("bad")).groupBy("w").agg(F.count("*").alias("df"), F.sum("bad").alias("bad"))
    tried = saved(seen.where(F.pow(F.lit(base), F.col("df")) <= CHANCE), "tried")  # rarer ones cannot pass
    n = tried.count()
    high = tried.where(F.col("bad") > 1.5 * base * F.col("df")).collect()
    return sorted(r.w for r in high if tail(r.df, r.bad, base) <= CHANCE / n)


def fit(sample: DataFrame) -> OrdinalModel:
    """The model of a sample; every third text is held out for the threshold."""
    spark = sample.sparkSession
    got = sample.select("k", "h", "toxic", "sign").toArrow().sort_by([("h", "ascending"), ("toxic", "descending"), ("k", "ascending")])
    h = np.asarray(got["h"])
    got = got.filter(pa.array(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]))  # equal texts: one row, with the highest label
    toxic = np.asarray(got["toxic"]).astype(bool)
    if not toxic.any() or toxic.all():
        return OrdinalModel()
    signs = np.frombuffer(b"".join(x.as_py() for x in got["sign"]), dtype="<u4").reshape(len(toxic), HASHES)
    kept = np.flatnonzero(distinct(signs, toxic))
    third = np.arange(len(kept)) % 3 == 0
    toxic = toxic[kept]
    n, n_bad = int((~third).sum()), int(toxic[~third].sum())
    if not n_bad or n_bad == n or not third.any():
        return OrdinalModel()
    ids = got["k"].take(pa.array(kept)).to_pylist()
    part = spark.createDataFrame([(k, i, bool(t)) for i, (k, t) in enumerate(zip(ids, third, strict=True))], "k long, i int, held boolean")
    rows = sample.select("k", "toxic", "words", "counts").join(F.broadcast(part), "k")  # one row for each text of the bounded sample
    vocab = vocabulary(rows.where("not held"), n_bad / n)
    if not vocab:
        return OrdinalModel()
    place = {w: k for k, w in enumerate(vocab)}

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, ws, cs in zip(pdf["i"], pdf["words"], pdf["counts"], strict=True):
                at = sorted((place[w], c) for w, c in zip(ws, cs, strict=True) if w in place)
                yield pd.DataFrame({"i": i, "k": [k for k, _ in at], "c": [c for _, c in at]})

    x = rows.select("i", "words", "counts").mapInPandas(only, "i int, k int, c int").toArrow().sort_by([("i", "ascending"), ("k", "ascending")])
    row, col, counts = (np.asarray(x[c]).astype(np.int64) for c in ("i", "k", "c"))
    stem = np.array([w.startswith("^") for w in vocab])
    whole = ~stem[col]
    tells = np.bincount(row[whole], counts[whole], minlength=len(kept))
    some = toxic & (tells > 0) & ~third
    grades = np.where(toxic, 1 + (tells > (np.median(tells[some]) if some.any() else 0)), 0)
    number = np.cumsum(~third) - 1
    mine = ~third[row]
    w, theta = fit_cumulative(number[row[mine]], col[mine], np.log1p(counts[mine]), grades[~third], len(vocab), PENALTY)
    model = OrdinalModel({v: float(w[i]) for i, v in enumerate(vocab) if abs(w[i]) > 1e-6}, tuple(map(float, theta)))
    p = model.above(np.bincount(row, np.log1p(counts) * w[col], minlength=len(kept)))[third]
    model.calibration = tuple((float(p[:, j].mean()), float((grades[third] > j).mean())) for j in range(GRADES - 1))
    held = toxic[third]
    if held.any() and not held.all():
        model.cut = threshold(p[:, 0], held)
    return model


def threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """Where clean texts rejected, each counted COST times, plus toxic texts kept are fewest; of equals the widest gap."""
    odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
    at = np.unique(odds)
    at = np.append(at, at[-1] + 1.0)
    missed = np.searchsorted(np.sort(odds[toxic]), at[:-1], "right")
    wrong = (~toxic).sum() - np.searchsorted(np.sort(odds[~toxic]), at[:-1], "right")
    cost = COST * wrong + missed
    best = np.flatnonzero(cost == cost.min())
    i = best[np.argmax(np.diff(at)[best])]
    return float(1 / (1 + np.exp(-(at[i] + at[i + 1]) / 2)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    return fit(labelled_sample(docs, labels, fit_rows))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, rejected) of every document, from its whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.array([model.link(t) for t in pdf["text"]], dtype=float)
            s = model.above(z)
            some = pdf["text"].str.len().to_numpy() > 0
            B.trim()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "severity": np.where(some, s.sum(1), 0.0), "p_toxic": np.where(some, s[:, 0], 0.0), "grade": (np.where(some, s.sum(1), 0) + 0.5).astype(int), "rejected": some & (s[:, 0] >= model.cut)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, SCORES)


def filter_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not rejected, with all their columns, decided row by row."""
    model = train(docs, labels, fit_rows)

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        p = model.above(np.array([model.link(t) for t in text], dtype=float))[:, 0]
        return pd.Series((text.str.len().to_numpy() > 0) & (p >= model.cut))

    return docs.where(~toxic(whole_text()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "grade", "rejected")
