"""Quality classifier from positive and unlabelled documents.

Trusted positives are documents labelled good; the unlabelled ones are web text of unknown quality. A small
network over text statistics minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss; when the bracket falls below zero, its gradient is followed upwards instead. The
prior is estimated: for any set of scores, unlabelled share / positive share bounds it from above, so the
smallest such ratio over the upper tails of a first classifier's scores is taken.

Documents labelled bad are never used. Features are of the text alone. The model learns from bounded samples
(``max_positive``, ``max_unlabelled`` documents, by the order of a hash of their ids); every document is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternfield.llm.common import free_name, small_batches

FEATURES = ("chars", "upper", "lower", "digit", "blank", "stops", "marks", "beyond", "word_length", "long_words", "distinct", "top_word", "capital_words", "marked_words", "line_length", "repeated_lines", "packing", "bars")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(0x250, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER = _table("".join(chr(i) for i in range(0x250) if chr(i).isupper()))
_LOWER = _table("".join(chr(i) for i in range(0x250) if chr(i).islower()))
_DIGIT = _table("0123456789")
_BLANK = _table("".join(chr(i) for i in range(0x250) if chr(i).isspace()))
_STOPS = _table(".,;:'?-")


def features(text: str | None) -> list[float]:
    """Statistics of a text; a null or empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x24F)
    n = len(codes)
    seen = np.bincount(codes, minlength=0x250)
    share = [float(seen[t].sum()) / n for t in (_UPPER, _LOWER, _DIGIT, _BLANK, _STOPS)]
    beyond = float(seen[0x24F]) / n
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "replace")
    return [
        float(np.log1p(n)),
        *share,
        1.0 - sum(share) - beyond,
        beyond,
        (n - seen[_BLANK].sum()) / m / 10,
        sum(c for w, c in counts.items() if len(w) > 12) / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(c for w, c in counts.items() if w[:2].isupper()) / m,
        sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:'?")) / m,
        float(np.log1p(n / max(len(lines), 1))),
        1.0 - len(set(lines)) / max(len(lines), 1),
        len(zlib.compress(raw, 1)) / len(raw),
        counts.get("|", 0) / m,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, *, hidden: int, steps: int, rate: float, seed: int) -> list[np.ndarray]:
    """Adam on the risk above; prior None: plain logistic loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    theta = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    x = np.vstack([p, u])
    of_p = np.arange(len(x)) < len(p)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), 2048) if len(x) > 2048 else np.arange(len(x))
        xb, pb = x[pick], of_p[pick]
        n_p, n_u = max(pb.sum(), 1), max((~pb).sum(), 1)
        a = np.tanh(xb @ theta[0] + theta[1])
        z = a @ theta[2] + theta[3]
        s = _sigmoid(z)
        if prior is None:
            g = np.where(pb, (s - 1) / n_p, s / n_u)
        else:
            bad = np.logaddexp(0, z)
            rest = bad[~pb].sum() / n_u - prior * bad[pb].sum() / n_p
            minus = np.where(pb, -prior * s / n_p, s / n_u)
            g = np.where(pb, prior * (s - 1) / n_p, 0) + minus if rest >= 0 else -minus
        back = (g[:, None] * theta[2]) * (1 - a * a)
        grads = [xb.T @ back + 1e-4 * theta[0], back.sum(0), a.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return theta


def class_prior(of_positive: np.ndarray, of_unlabelled: np.ndarray, *, least: float = 0.5) -> float:
    """Smallest ratio of unlabelled to positive share over the scores' upper tails that hold ``least`` of the positives."""
    if not len(of_positive) or not len(of_unlabelled):
        return 0.5
    cuts = np.quantile(of_positive, np.linspace(0, 1 - least, 60))
    p = np.array([(of_positive >= c).mean() for c in cuts])
    u = np.array([(of_unlabelled >= c).mean() for c in cuts])
    return float(np.clip((u / p).min(), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, hidden: int = 16, steps: int = 1500, rate: float = 0.01, seed: int = 0) -> Model:
    """Without positives or unlabelled rows the model gives one half to every text."""
    d = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = _train(p[::2], u[::2], None, hidden=hidden, steps=steps // 5, rate=rate, seed=seed)
    out = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2]
    prior = class_prior(out(p[1::2]), out(u[1::2]))  # on rows that the first classifier has not seen
    w = _train(p, u, prior, hidden=hidden, steps=steps, rate=rate, seed=seed + 1)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def text_features(docs: DataFrame, *, text_col: str, out: str) -> DataFrame:
    """docs without their text, with the features as ``out``."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, out)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(rows, pa.list_(pa.float64()))], [*rest, out])

    return docs.select(*rest, text_col).mapInArrow(each, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{out}` array<double>"]))


def train(docs: DataFrame, labels: DataFrame, *, train_if: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 8000, max_unlabelled: int = 12000, seed: int = 0) -> Model:
    """The model from rows of ``labels`` with label 1 and from documents, both where ``train_if`` (on the id) holds."""
    ok = F.lit(True) if train_if is None else train_if
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    good = labels.where(ok & (F.col(label_col) == 1)).select(id_col).distinct().orderBy(*order).limit(max_positive)
    web = docs.where(ok & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(*order).limit(max_unlabelled)
    picked = good.withColumn("__good", F.lit(True)).unionByName(web.withColumn("__good", F.lit(False)))
    texts = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)  # bounded: max_positive + max_unlabelled ids
    rows = text_features(texts, text_col=text_col, out="x").select("__good", "x", id_col)
    rows = rows.orderBy(*order, F.xxhash64("x"), "__good").limit(max_positive + max_unlabelled).collect()  # and rows, where ids repeat
    rows.sort(key=lambda r: (r[id_col], r["x"]))
    x = lambda good: np.array([r["x"] for r in rows if r["__good"] == good]).reshape(-1, len(FEATURES))
    return fit(x(True), x(False), seed=seed)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every row, null and empty texts too; a column named like it is replaced."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != score_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(text_col).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(model.score(x))], [*rest, score_col])

    return docs.select(*rest).mapInArrow(each, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{score_col}` double"]))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, with their columns as they were."""
    name = free_name("__score", docs.columns)
    return score(docs, model, text_col=text_col, score_col=name).where(F.col(name) >= threshold).drop(name)
