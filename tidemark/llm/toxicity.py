"""Toxicity by a classifier chain of linear models.

The label columns are predicted one after the other.  Each model is a logistic
regression on the presence of words and word beginnings and a few measures of the
text; the models after the first also get the log-odds that the earlier ones give.
For training these are out-of-fold predictions, so that a later model sees
probabilities as uncertain as those it will see on new documents.

Training uses at most ``max_labelled`` labelled rows, picked by the hash of the id; the
vocabulary has at most ``vocabulary`` features a category.  Scoring goes over all
documents and whole texts in one pass without a shuffle.

Cases: a null text counts as empty; rows with a null id or null labels are not trained
on, but every row is scored; an id labelled twice counts with its larger labels; a
category with one class only gets that share as a constant; without labelled rows
nothing is toxic; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, wide_partitions

_LETTERS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6)
_SYMBOLS = "*%$#&@|~^<>{}"
N_MEASURES = 4


def word_features(token: str) -> list[str]:
    """Words of a token and their beginnings (marked by *)."""
    out = []
    for w in _LETTERS.findall(token):
        out.append(w)
        out += [w[:k] + "*" for k in _BEGINNINGS if len(w) >= k]
    return out


def measures(text: str, n_tokens: int) -> list[float]:
    n = len(text)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    return [math.log1p(n), symbols / (n + 1), n / (n_tokens + 1), sum(map(text.count, "0123456789")) / (n + 1)]


@dataclass
class Chain:
    """Weights of the chain; plain data that travels in the closure of the scoring tasks."""

    categories: list[str]
    vocabulary: dict[str, int]
    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def predict(self, hits: list[list[int]], dense: np.ndarray) -> np.ndarray:
        """Probabilities, one column a category; ``hits`` has the features of each row."""
        dense = (dense - self.center) / self.scale
        rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        cols = np.array([j for h in hits for j in h], dtype=np.int64)
        n, v = len(hits), len(self.vocabulary)
        odds: list[np.ndarray] = []
        for w in self.weights:
            z = w[0] + dense @ w[1 : 1 + N_MEASURES] + np.bincount(rows, w[1 + N_MEASURES + cols], minlength=n)[:n]
            for k, earlier in enumerate(odds):
                z = z + w[1 + N_MEASURES + v + k] * earlier
            odds.append(np.clip(z, -12, 12))
        return 1 / (1 + np.exp(-np.array(odds).T)) if odds else np.zeros((n, 0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; column 0 of ``x`` is the intercept."""
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = math.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _labelled(documents, labels, categories, max_labelled, id_col, text_col) -> DataFrame:
    """At most ``max_labelled`` rows (doc_id, text, labels, fold); the labels, so bounded, are broadcast."""
    picked = (
        labels.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), *[(F.expr(e)).cast("int").alias(c) for c, e in categories])
        .dropna()
        .groupBy("doc_id")
        .agg(*[F.max(c).alias(c) for c, _ in categories])
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(max_labelled)
    )
    texts = documents.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts.join(F.broadcast(picked), "doc_id")


def fit_chain(
    documents: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, str]] = (("low_quality", "1 - quality"), ("toxic", "toxic")),
    max_labelled: int = 12_000,
    vocabulary: int = 120,
    folds: int = 4,
    ridge: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Chain:
    """Train the chain on a bounded sample; (name, SQL expression over the label columns) each."""
    names = [c for c, _ in categories]
    sample = _labelled(documents, labels, categories, max_labelled, id_col, text_col)
    sample = materialize(sample.repartition(wide_partitions(documents.sparkSession), "doc_id"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        positive = [Counter() for _ in names]
        of_token = functools.lru_cache(maxsize=200_000)(word_features)
        for b in batches:
            ys = [b.column(c).to_pylist() for c in names]
            for i, text in enumerate(b.column("text").to_pylist()):
                found = {f for t in set(text.lower().split()) for f in of_token(t)}
                seen.update(found)
                for k in range(len(names)):
                    if ys[k][i]:
                        positive[k].update(found)
        features = list(seen)
        cols = [pa.array(features, pa.string()), pa.array([seen[f] for f in features], pa.int64())]
        cols += [pa.array([p[f] for f in features], pa.int64()) for p in positive]
        yield pa.RecordBatch.from_arrays(cols, names=["feature", "n", *names])

    schema = "feature string, n long, " + ", ".join(f"`{c}` long" for c in names)
    counts = (
        sample.mapInArrow(count, schema).groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    )
    total = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first().asDict()
    counts = materialize(counts.where(F.col("n") >= max(3, (total["n"] or 0) // 1000)), "toxicity-counts")
    vocab: dict[str, int] = {}
    for c in names:
        n, pos = total["n"] or 0, total[c] or 0
        if not 0 < pos < n:
            continue
        expected = F.col("n") * F.lit(pos / n)
        chi2 = F.pow(F.col(c) - expected, 2) / (expected * (1 - F.lit(pos / n)) * (1 - F.col("n") / (n + 1)) + 1e-9)
        for r in counts.orderBy(chi2.desc(), "feature").limit(vocabulary).collect():
            vocab.setdefault(r["feature"], len(vocab))

    hits, dense, ys, fold = [], [], [], []
    rows = sample.mapInArrow(
        _hits(vocab, names), "doc_id long, hits array<int>, dense array<double>, ys array<int>"
    ).collect()  # at most max_labelled rows of a few numbers
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["hits"])):
        hits.append(r["hits"])
        dense.append(r["dense"])
        ys.append(r["ys"])
        fold.append(r["doc_id"] * 2654435761 % 2**32 * folds >> 32)
    n = len(hits)
    if not n:
        zero = np.zeros(1 + N_MEASURES + 0)
        zero[0] = -12
        weights = [np.concatenate([zero, np.zeros(k)]) for k in range(len(names))]
        return Chain(names, {}, np.zeros(N_MEASURES), np.ones(N_MEASURES), weights)
    dense = np.array(dense)
    center, scale = dense.mean(0), dense.std(0) + 1e-9
    x = np.zeros((n, 1 + N_MEASURES + len(vocab)))
    x[:, 0] = 1
    x[:, 1 : 1 + N_MEASURES] = (dense - center) / scale
    for i, h in enumerate(hits):
        x[i, [1 + N_MEASURES + j for j in h]] = 1
    y, fold = np.array(ys, dtype=float), np.array(fold)
    chain = Chain(names, vocab, center, scale)
    for k in range(len(names)):
        chain.weights.append(_logistic(x, y[:, k], ridge))
        held_out = np.full(n, -12.0)
        for f in range(folds):
            out = fold == f
            if out.any() and not out.all():
                held_out[out] = x[out] @ _logistic(x[~out], y[~out, k], ridge)
        x = np.hstack([x, np.clip(held_out, -12, 12)[:, None]])
    chain.threshold = _best_threshold(1 / (1 + np.exp(-x[:, -1])), y[:, -1])
    return chain


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold in [0.2, 0.5] with the best F1 on out-of-fold predictions; the largest of equals."""
    best, at = -1.0, 0.5
    for t in np.arange(0.5, 0.19, -0.05):
        hit = float((y[p >= t]).sum())
        f1 = 2 * hit / max(1.0, (p >= t).sum() + y.sum())
        if f1 > best:
            best, at = f1, float(t)
    return at


def _features_of(vocab: dict[str, int]):
    """Maps texts to (features present, measures); tokens are looked at once per task."""
    known: dict[str, list[int]] = {}
    plain: set[str] = set()

    def features(text: str) -> tuple[list[int], list[float]]:
        tokens = text.lower().split()
        present = set(tokens)
        if len(plain) + len(known) > 1_000_000:
            plain.clear()
            known.clear()
        for t in present - plain:
            if t not in known:
                found = [vocab[f] for f in word_features(t) if f in vocab]
                if found:
                    known[t] = found
                else:
                    plain.add(t)
        return sorted({j for t in present if t in known for j in known[t]}), measures(text, len(tokens))

    return features


def _hits(vocab, names):
    def run(batches):
        features = _features_of(vocab)
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            ys = list(zip(*[b.column(c).to_pylist() for c in names]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([g[0] for g in got], pa.list_(pa.int32())),
                    pa.array([g[1] for g in got], pa.list_(pa.float64())),
                    pa.array([list(y) for y in ys], pa.list_(pa.int32())),
                ],
                names=["doc_id", "hits", "dense", "ys"],
            )

    return run


def score(documents: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ``p_<category>`` for each category of the chain."""
    names = chain.categories

    def run(batches):
        features = _features_of(chain.vocabulary)
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            p = chain.predict([g[0] for g in got], np.array([g[1] for g in got]).reshape(-1, N_MEASURES))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(names))]],
                names=["doc_id", *[f"p_{c}" for c in names]],
            )

    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"`p_{c}` double" for c in names))


def classify(documents: DataFrame, labels: DataFrame, threshold: float | None = None, **fit) -> DataFrame:
    """Fit on the labelled documents, score all: doc_id, p_<category>..., toxic (last category).

    Without a ``threshold`` the chain's own is taken, set on out-of-fold predictions.
    """
    chain = fit_chain(documents, labels, **fit)
    limit = chain.threshold if threshold is None else threshold
    names = {k: fit[k] for k in ("id_col", "text_col") if k in fit}
    return score(documents, chain, **names).withColumn("toxic", F.col(f"p_{chain.categories[-1]}") >= limit)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float | None = None, **fit) -> DataFrame:
    """The documents that are not toxic, with their own columns; texts are scored in place."""
    chain = fit_chain(documents, labels, **fit)
    limit = chain.threshold if threshold is None else threshold
    text_at = documents.columns.index(fit.get("text_col", "text"))
    schema = documents.schema

    def run(batches):
        features = _features_of(chain.vocabulary)
        for b in batches:
            texts = b.column(text_at).to_pylist()
            got = [features(t or "") for t in texts]
            p = chain.predict([g[0] for g in got], np.array([g[1] for g in got]).reshape(-1, N_MEASURES))
            yield b.filter(pa.array(p[:, -1] < limit))

    return documents.mapInArrow(run, schema)
