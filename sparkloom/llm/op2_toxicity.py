"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each link is a logistic regression over the words of a
text and the probabilities that the earlier links give it. In training those probabilities are out of fold:
a link's models for each fold see the other folds only, vocabulary included, so a later link learns from what an
earlier one says about texts it hasn't seen. A text's fold is the least hash of its words, so copies and nearly all
near copies share one. When scoring, the links trained on all of the sample are used.

Training reads a sample of labelled ids, ``sample`` at most in expectation (all, where there are fewer labels), chosen by
a hash of the id; it is the one bounded part. The scan, which keeps its own tasks, turns the sampled texts into their
distinct words, and of several texts of one id one stays (the least digest of its words), before they go to one task.
A link looks at ``features`` words at most, the most telling ones, and only at words of ``min_rows`` sampled texts and a
400th of them. All documents are scored whole.
The flag is raised where the last link's probability reaches a threshold that is set on out-of-fold
predictions: the lowest one with the wanted precision.

Cases: null and empty text has no words and gets the probabilities of the intercepts, never the flag; texts of any
length are read whole, in training and in scoring; null labels and labels of missing documents are left out; a
document labelled twice counts as toxic if one label says so; repeated rows are scored each; extra columns are
ignored, whatever their names; without a label of each kind no document is flagged and probabilities are null; an
empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker

_WORD = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> set[str]:
    """The text's words, the first six letters (``^``) of longer ones, and those that two words share (``2^``)."""
    if not text:
        return set()
    out, stems = set(_WORD(text.lower())), set()
    twice = []
    for w in out:
        if len(w) > 6:
            stem = "^" + w[:6]
            if stem in stems:
                twice.append("2" + stem)
            else:
                stems.add(stem)
    out |= stems
    out.update(twice)
    return out


class Csr:
    """Rows of a 0/1 matrix, and the two products that training needs."""

    def __init__(self, rows: list[np.ndarray], n: int):
        self.n, self.ptr = n, np.cumsum([0, *map(len, rows)])
        self.col = np.concatenate([np.empty(0, np.int32), *rows])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.ptr))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], len(self.ptr) - 1)

    def t_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, v[self.row], self.n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Csr, dense: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Accelerated gradient descent, each coordinate scaled by its curvature bound; rows where ``use`` is 0 have no say."""
    k, width = dense.shape[1], 1 + dense.shape[1] + float(np.max(np.diff(x.ptr), initial=1))
    rate_w, rate_d = 4 / (width * (x.t_dot(use) + l2)), 4 / (width * ((dense**2 * use[:, None]).sum(0) + l2))
    rate_b = 4 / (width * max(use.sum(), 1))
    w, d, b = np.zeros(x.n), np.zeros(k), float(np.log((y @ use + 1) / (use.sum() - y @ use + 1)))
    pw, pd_, pb, t = w, d, b, 1.0
    for _ in range(steps):
        g = (_sigmoid(x.dot(w) + dense @ d + b) - y) * use
        nw, nd, nb = w - rate_w * (x.t_dot(g) + l2 * w), d - rate_d * (dense.T @ g + l2 * d), b - rate_b * g.sum()
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        m, t = (t - 1) / u, u
        w, d, b, pw, pd_, pb = nw + m * (nw - pw), nd + m * (nd - pd_), nb + m * (nb - pb), nw, nd, nb
    return pw, pd_, pb


class Words:
    """The texts' words as numbers, each word kept once."""

    def __init__(self, texts: list[str | None | list[str]], folds: int):
        number: dict[str, int] = {}
        self.rows, self.fold = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = set(t) if isinstance(t, (list, np.ndarray)) else words(t)
            self.fold[k] = fold_of(own, folds)
            self.rows.append(np.array(sorted(number.setdefault(w, len(number)) for w in own), np.int32))
        self.names = list(number)

    def counts(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([np.empty(0, np.int32), *(self.rows[i] for i in at)]), minlength=len(self.names))

    def vocabulary(self, at: np.ndarray, y: np.ndarray, features: int, min_rows: int) -> list[int]:
        """The words whose rate of positive texts among ``at`` is farthest from the usual rate, in standard deviations; ties by word."""
        seen, hits = self.counts(at), self.counts(at[y[at] > 0])
        base = float(y[at].mean()) if len(at) else 0.0
        some = np.flatnonzero(seen >= max(min_rows, len(at) // 400))  # rarer words tell copies apart, not toxicity
        score = np.abs(hits[some] - seen[some] * base) / np.sqrt(np.maximum(seen[some] * base * (1 - base), 1e-9))
        return [w for _, _, w in sorted(zip((-score).tolist(), (self.names[w] for w in some), some.tolist(), strict=True))[:features]]

    def matrix(self, chosen: list[int]) -> Csr:
        column = np.full(len(self.names), -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        return Csr([c[c >= 0] for c in (column[r] for r in self.rows)], max(len(chosen), 1))


def fold_of(s: set[str], folds: int) -> int:
    """Texts with the same words, and mostly those with nearly the same, share a fold."""
    return min(map(xxhash.xxh3_64_intdigest, s)) // 65536 % folds if s else 0


def train_chain(texts: list[str | None], labels: np.ndarray, folds: int, features: int, min_rows: int, l2: float, steps: int, precision: float) -> dict | None:
    """labels: a row per text, a column per category in chain order. The model, or None without both outcomes of the last category."""
    if not len(labels) or labels[:, -1].min() == labels[:, -1].max():
        return None
    y_last, own, every = labels[:, -1], Words(texts, folds), np.arange(len(texts))
    fold, base = own.fold, y_last.mean()
    used, chosen = np.unique(fold), own.vocabulary(every, y_last, features, min_rows)
    x = own.matrix(chosen)
    held = {f: own.matrix(own.vocabulary(every[fold != f], y_last, features, min_rows)) for f in used}
    chain, links, oof = np.zeros((len(texts), 0)), [], None
    for c in range(labels.shape[1]):
        y, oof = labels[:, c].astype(float), np.zeros(len(texts))
        for f in used:
            w, d, b = fit_logistic(held[f], chain, y, (fold != f).astype(float), l2, steps)
            oof[fold == f] = _sigmoid(held[f].dot(w) + chain @ d + b)[fold == f]
        links.append(fit_logistic(x, chain, y, np.ones(len(y)), l2, steps))
        chain = np.column_stack([chain, oof])
    order = np.argsort(-oof, kind="stable")
    right = np.cumsum(y_last[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((right >= precision) & (oof[order] > base))
    threshold = float(oof[order][good[-1]]) if len(good) else 0.5
    flagged = oof >= threshold
    return {
        "words": {own.names[w]: k for k, w in enumerate(chosen)}, "weights": np.stack([w for w, _, _ in links], 1), "chain": [d for _, d, _ in links], "bias": [b for _, _, b in links], "threshold": threshold,
        "precision": float(y_last[flagged].mean()) if flagged.any() else 0.0, "recall": float(flagged[y_last == 1].mean()), "rows": len(texts),
    }


def predict(model: dict, text: str | None) -> tuple[list[float], bool]:
    index, weights = model["words"], model["weights"]
    own = [index[w] for w in words(text) if w in index]
    z, out = weights[own].sum(0), []
    for c, (d, b) in enumerate(zip(model["chain"], model["bias"], strict=True)):
        out.append(float(_sigmoid(np.float64(z[c] + np.dot(d, out) + b))))
    return out, bool(own) and out[-1] >= model["threshold"]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int, folds: int = 3, features: int = 2000, min_rows: int = 5, l2: float = 1.0, steps: int = 150, precision: float = 0.99) -> dict | None:
    """``docs``: _id, _text. ``labels``: _id and a 0/1 column per category. One task trains on the words of the bounded sample,
    a row for each id, and gives back the model alone."""
    n = labels.count()
    some = labels.filter(F.pmod(F.xxhash64("_id"), F.lit(max(n, 1))) < sample)
    own = docs.join(F.broadcast(some), "_id").select("_id", "_text", *categories)  # ``sample`` labels at most, in expectation

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op2")
        for b in batches:
            sets = pa.array([sorted(words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets, *b.columns[2:]], names=["_id", "words", *categories])

    sets = own.mapInArrow(to_words, "_id long, words array<string>, " + ", ".join(f"`{c}` int" for c in categories))
    one = sets.groupBy("_id").agg(F.min(F.struct(F.xxhash64("words").alias("h"), "words", *categories)).alias("o")).select("_id", "o.words", *(f"o.{c}" for c in categories))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker.starts("op2")
        got = [*frames]
        model = None
        if got:
            d = pd.concat(got).sort_values("_id")
            model = train_chain(d["words"].tolist(), d[list(categories)].to_numpy(np.int64), folds, features, min_rows, l2, steps, precision)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})
        got = d = model = None
        worker.trim()

    rows = one.repartition(1).mapInPandas(run, "model binary").collect()  # the model alone
    return pickle.loads(rows[0].model) if rows else None


#: Toxicity categories in chain order, as conditions on the label columns.
CATEGORIES = {"toxic_junk": "toxic = 1 AND quality = 0", "toxic_prose": "toxic = 1 AND quality = 1", "toxic": "toxic = 1"}


def toxicity(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, **options
) -> DataFrame:
    """doc_id, p_<category> in chain order and toxic (the flag) of every row; with ``keep`` all columns of the clean rows alone."""
    categories = categories or CATEGORIES
    known = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), *[F.expr(f"CAST({c} AS INT)").alias(k) for k, c in categories.items()])
    known = known.dropna().groupBy("_id").agg(*[F.max(k).alias(k) for k in categories])
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    model = train(texts, known, categories, sample, **options)
    names = list(categories)

    def judge(texts: list[str | None]) -> list[tuple[list[float | None], bool]]:
        return [([None] * len(names), False) if model is None else predict(model, t) for t in texts]

    if keep:

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.starts("op2")
            for b in batches:
                yield b.filter(pa.array([not flag for _, flag in judge(b.column(at).to_pylist())], pa.bool_()))

        at, plain = docs.columns.index(text_col), docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots can't go into a task
        return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op2")
        for b in batches:
            got = judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([p[k] for p, _ in got], pa.float64()) for k in range(len(names))], pa.array([f for _, f in got], pa.bool_())], names=["doc_id", *[f"p_{c}" for c in names], "toxic"])

    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in names) + ", toxic boolean")
