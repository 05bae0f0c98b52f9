"""Toxicity: a chain of linear classifiers over words and word beginnings.

The categories are predicted in the order `junk`, `severe`, `toxic`; each later model also sees the probabilities of the
earlier ones, in training those that folds predicted which had not seen the document. `toxic` and `junk` (quality 0, where
the labels have it) are labelled; `severe` is a weak label: toxic documents with `SEVERE` and more of the features that were
chosen without them. Features are chosen by the log-odds of their document frequencies in toxic and other documents, each
over its error: for each fold from the other folds alone, and from all for the models that score.

Bounds: the models are fitted on at most `sample` labelled documents (those of least hash, `SAMPLE` unless told), with at
most `most_features` features a fold (`MOST_FEATURES` unless told; of greatest weight), so the driver holds at most sample x
(FOLDS + 1) x most_features numbers of four bytes. Scoring reads every document whole.

Defined results: a null or blank text has no features and the base probability; a very long text counts each of its words
once, like any other; without labels, or with one class only, every probability is 0; label rows that repeat an id count
once, the greatest toxic and the least quality label hold; null labels are left out; document rows that repeat an id, or
have none, are scored each; features of equal weight (ties) are chosen in the order of their names; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import durable, table, with_python

CATEGORIES = ("junk", "severe", "toxic")
SAMPLE, FOLDS, SEVERE = 12_000, 5, 3
MOST_FEATURES, LEAST_Z, LEAST_DOCS = 600, 3.0, 4
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Words as `=word` and their beginnings as `^part`."""
    words = set(_WORD.findall((text or "").lower()))
    out = {"=" + w for w in words}
    for n in PREFIXES:
        out.update("^" + w[:n] for w in words if len(w) > n)
    return out


def _feature_rows(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            ids, found = [], []
            for k, v in enumerate(part.column(0)):
                f = features_of(v.as_py())
                found += f
                ids += [k] * len(f)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), part.column(1).take(at), part.column(2).take(at)], names=["feature", "toxic", "fold"])


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Linear:
    """Logistic regression with a ridge, by Newton's steps."""
    n, m = x.shape
    z = np.column_stack([x, np.ones(n)])
    w = np.zeros(m + 1)
    w[-1] = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    penalty = np.full(m + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Models of the categories in order, over the chosen features and the earlier probabilities."""

    features: dict[str, int]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def counts(self, text: str | None) -> np.ndarray:
        """How many different words of the text bear each feature, damped."""
        out = np.zeros(len(self.features))
        get = self.features.get
        for w in set(_WORD.findall((text or "").lower())):
            if (k := get("=" + w)) is not None:
                out[k] += 1
            for n in PREFIXES:
                if len(w) > n and (k := get("^" + w[:n])) is not None:
                    out[k] += 1
        return np.log1p(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category."""
        seen = np.empty((len(x), 0))
        for m in self.models:
            seen = np.column_stack([seen, m.predict(np.column_stack([x, seen]))])
        return seen


def severe_label(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for toxic documents with SEVERE and more features."""
    return toxic * ((x > 0).sum(axis=1) >= SEVERE)


def fit_chain(features: list[str], chosen: list[np.ndarray], x: np.ndarray, toxic: np.ndarray, junk: np.ndarray, fold: np.ndarray) -> Chain:
    """chosen: per fold the columns of x chosen without it, and last those chosen from all."""
    every = chosen[-1]
    chain = Chain({features[k]: i for i, k in enumerate(every)})
    severe, outside = np.zeros(len(x)), np.empty((len(x), 0))
    for k in range(FOLDS):
        severe[fold == k] = severe_label(x[fold == k][:, chosen[k]], toxic[fold == k])
    for y in (junk, severe, toxic):
        p = np.zeros(len(x))
        for k in range(FOLDS):
            rest = fold != k
            if rest.any() and (~rest).any():
                z = np.column_stack([x[:, chosen[k]], outside])
                p[~rest] = fit_linear(z[rest], y[rest]).predict(z[~rest])
        chain.models.append(fit_linear(np.column_stack([x[:, every], outside]), y))
        outside = np.column_stack([outside, p])
    # The threshold of best F0.5 on folds that had not seen the document: sparing clean ones counts more.
    scores, best = outside[:, -1], -1.0
    for t in np.arange(0.2, 0.96, 0.05):
        hit = scores >= t
        tp, fp, fn = (hit & (toxic > 0)).sum(), (hit & (toxic == 0)).sum(), (~hit & (toxic > 0)).sum()
        f = 1.25 * tp / max(1.25 * tp + 0.25 * fn + fp, 1)
        if f > best + 1e-9:
            best, chain.threshold = f, float(t)
    return chain


def _chosen(counted: DataFrame, n: dict[tuple[int, int], int], without: int | None, most: int) -> list[str]:
    """Features of greatest z over all folds but one. counted: feature, toxic_by_fold, all_by_fold; n: documents by fold and label."""
    folds = [k for k in range(FOLDS) if k != without]
    ones, zeros = (sum(n.get((k, y), 0) for k in folds) for y in (1, 0))
    if not ones or not zeros:
        return []
    a, c = (sum((F.col(x)[k] for k in folds), F.lit(0)) for x in ("toxic_by_fold", "all_by_fold"))
    b = c - a
    odds = F.log((a + 0.5) / (ones - a + 0.5)) - F.log((b + 0.5) / (zeros - b + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = counted.filter(a >= LEAST_DOCS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(most)
    return [r["feature"] for r in best.select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> Chain | None:
    """The chain, fitted on at most `sample` labelled documents; None if they are of one class or have no telling feature."""
    quality = F.col("quality").cast("int") if "quality" in labels.columns else F.lit(1)
    y = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    y = y.agg(F.max(F.col("toxic").cast("int")).alias("toxic"), (1 - F.coalesce(F.min(quality), F.lit(1))).alias("junk"))
    y = y.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    d = with_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), F.col("doc_id") == F.col("label_id"))
    d = durable(d.select("text", "toxic", "junk", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    n = {(r["fold"], r["toxic"]): r["count"] for r in d.groupBy("fold", "toxic").count().collect()}
    if len({t for _, t in n}) < 2:
        return None
    f = d.select("text", "toxic", "fold").mapInArrow(_feature_rows, "feature string, toxic int, fold int")
    by = lambda v: F.array(*[F.sum(F.when(F.col("fold") == k, v).otherwise(0)) for k in range(FOLDS)])
    f = durable(f.groupBy("feature").agg(by(F.col("toxic")).alias("toxic_by_fold"), by(F.lit(1)).alias("all_by_fold")).filter(F.aggregate("toxic_by_fold", F.lit(0).cast("long"), lambda s, v: s + v) >= LEAST_DOCS), "features")
    lists = [_chosen(f, n, k, most_features) for k in (*range(FOLDS), None)]
    if not lists[-1]:
        return None
    features = list(dict.fromkeys(w for some in lists for w in some))
    at = {w: k for k, w in enumerate(features)}
    chosen = [np.array([at[w] for w in some], np.int64) for some in lists]
    blank = Chain(at)

    def rows(batches):
        for batch in batches:
            x = [blank.counts(v.as_py()).astype(np.float32).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *batch.columns[1:]], names=["x", "toxic", "junk", "fold"])

    # At most `sample` rows.
    got = d.mapInArrow(rows, "x binary, toxic int, junk int, fold int").toPandas().sort_values(["fold", "toxic", "junk", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(float)
    return fit_chain(features, chosen, x, *[got[c].to_numpy(float) for c in ("toxic", "junk")], got["fold"].to_numpy())


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, p_junk, p_severe, p_toxic, toxic of every row of docs."""
    d = with_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [f"p_{c}" for c in CATEGORIES]

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                p = chain.predict(np.vstack([chain.counts(v.as_py()) for v in part.column(1)])) if chain else np.zeros((part.num_rows, len(CATEGORIES)))
                flag = p[:, -1] >= chain.threshold if chain else np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.round(p[:, k], 6)) for k in range(len(names))], pa.array(flag)], names=["doc_id", *names, "toxic"])

    return d.mapInArrow(rows, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
