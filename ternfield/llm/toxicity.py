"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own embedding (by hash; one of its coordinates starts as the word's log odds in the
training documents) beside the mean embedding of its character n-grams, which start likewise. Two gated recurrent networks read a
window of words, one from each end; attention pools their states; one unit scores the window. Windows of
``WIDTH`` words start every ``STRIDE`` words, so they overlap, and every window of every document is scored.
A document's score is its highest.

Labels are of whole documents: in training, each document's highest windows stand for it. Training uses whole
texts: at most ``max_each`` documents of each label, of at most ``max_chars`` characters together; scoring has no
bound.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternfield.llm.common import small_batches

WORD = re.compile(r"[^\W\d_]+")
WIDTH, STRIDE, CHUNK = 32, 24, 1024
N_WORDS, N_GRAMS, D_WORD, D_CHAR, H = 1 << 18, 1 << 17, 8, 8, 8
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
#: A word's log odds count as if so many further documents had shown none.
SHRINK = 20
#: Most words whose inputs a worker keeps.
CACHE_WORDS = 300_000


def word_ids(word: str) -> tuple[int, list[int]]:
    raw = f"<{word}>"
    return zlib.crc32(word.encode()) % N_WORDS, [zlib.crc32(raw[i : i + n].encode()) % N_GRAMS for n in GRAMS for i in range(max(1, len(raw) - n + 1))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def init(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = D_WORD + D_CHAR
    make = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
    return {
        "word": make(N_WORDS, D_WORD, by=0.1), "char": make(N_GRAMS, D_CHAR, by=0.1),
        "wx": make(2, d, 3 * H, by=d**-0.5), "wh": make(2, H, 3 * H, by=H**-0.5), "bx": np.zeros((2, 3 * H), np.float32),
        "att": make(2 * H, by=0.3), "out": make(2 * H, by=0.3), "bias": np.full(1, -1.0, np.float32),
    }


def inputs(net: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    """[word, embedding and mean n-gram embedding]."""
    ids = [word_ids(w) for w in words]
    own = net["word"][[i for i, _ in ids]] if ids else np.zeros((0, D_WORD), np.float32)
    sizes = np.array([len(g) for _, g in ids], np.int64)
    grams = np.fromiter((g for _, gs in ids for g in gs), np.int64, int(sizes.sum()))
    chars = np.add.reduceat(net["char"][grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] if ids else np.zeros((0, D_CHAR), np.float32)
    return np.hstack([own, chars]).astype(np.float32)


def project(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """[direction, word, gates]: what each word adds to the gates, the same wherever it stands."""
    return np.stack([x @ net["wx"][k] + net["bx"][k] for k in (0, 1)])


def forward(net: dict[str, np.ndarray], rows: np.ndarray, ids: np.ndarray, *, keep: bool = False):
    """Scores (before the sigmoid) of windows. rows: project() of the words; ids: [window, place], -1 is no word."""
    n, width = ids.shape
    mask = ids >= 0
    states = np.zeros((2, width, n, H), np.float32)
    tape = []
    for k in (0, 1):
        h, wh = np.zeros((n, H), np.float32), net["wh"][k]
        for t in range(width) if k == 0 else range(width - 1, -1, -1):
            m = mask[:, t]
            x = rows[k][ids[:, t]]
            hu = h @ wh
            zr = _sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
            new = h + z * (c - h)
            new = np.where(m[:, None], new, h) if not m.all() else new
            if keep:
                tape.append((k, t, h, z, r, c, hu[:, 2 * H :]))
            states[k, t] = h = new
    both = np.concatenate([states[0], states[1]], axis=2)
    e = both @ net["att"]
    e = np.where(mask.T, e, -1e9)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, both)
    score = pooled @ net["out"] + net["bias"][0]
    return (score, (mask, both, a, pooled, tape)) if keep else score


def backward(net: dict[str, np.ndarray], rows: np.ndarray, ids: np.ndarray, tape, g: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients for the network, and those of rows, where g is the gradient of the scores."""
    mask, both, a, pooled, steps = tape
    grads = {"out": pooled.T @ g, "bias": np.array([g.sum()]), "wh": np.zeros_like(net["wh"])}
    d_pooled = g[:, None] * net["out"]
    d_a = np.einsum("nh,tnh->tn", d_pooled, both)
    d_e = a * (d_a - (a * d_a).sum(0))
    grads["att"] = np.einsum("tn,tnh->h", d_e, both)
    d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * net["att"]
    d_rows = np.zeros_like(rows)
    d_h, was = None, None
    for k, t, h, z, r, c, hc in reversed(steps):
        if k != was:
            d_h, was = np.zeros_like(h), k
        d_h = d_h + d_both[t][:, k * H : (k + 1) * H]
        m = mask[:, t][:, None]
        d_new = d_h * m
        d_c = d_new * z * (1 - c * c)
        d_z = d_new * (c - h) * z * (1 - z)
        d_r = d_c * hc * r * (1 - r)
        d_x = np.hstack([d_z, d_r, d_c])
        d_hu = np.hstack([d_z, d_r, d_c * r])
        grads["wh"][k] += h.T @ d_hu
        ok = m[:, 0]
        np.add.at(d_rows[k], ids[ok, t], d_x[ok])
        d_h = d_h * ~m + d_new * (1 - z) + d_hu @ net["wh"][k].T
    return grads, d_rows


def windows(ids: np.ndarray) -> np.ndarray:
    """[window, place] of a document's word numbers; one window without words if it has none."""
    n = len(ids)
    starts = np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE) if n > WIDTH else np.zeros(1, np.int64)
    at = starts[:, None] + np.arange(WIDTH)
    return np.where(at < n, ids[np.minimum(at, n - 1)] if n else -1, -1)


def _gram_odds(docs: list[set[int]], grams: list[list[int]], toxic: np.ndarray, n: list[int]) -> np.ndarray:
    """Log odds of each n-gram by the training documents that hold it, shrunk like those of words."""
    seen = np.zeros((2, N_GRAMS))
    for words, y in zip(docs, toxic.tolist(), strict=True):
        seen[y, list({g for w in words for g in grams[w]})] += 1
    total = seen.sum(0)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.where(total >= 5, odds * total / (total + SHRINK), 0)


def train(texts: list[str], toxic: np.ndarray, *, epochs: int = 10, rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """The network from texts and labels 0 or 1; without both kinds of label it is untrained and scores low."""
    net = init(seed)
    if not toxic.any() or toxic.all():
        net["out"] *= 0
        return net
    split = [WORD.findall(t.lower()) for t in texts]
    vocab = {w: i for i, w in enumerate(sorted({w for s in split for w in s}))}
    words = list(vocab)
    seen = [Counter(w for s, y in zip(split, toxic, strict=True) if y == c for w in set(s)) for c in (0, 1)]
    n = [max(1, int((toxic == c).sum())) for c in (0, 1)]
    odds = np.array([np.log((seen[1][w] + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1)) for w in words])
    number = [word_ids(w) for w in words]
    own = np.array([i for i, _ in number])
    best = np.zeros(N_WORDS)
    common = np.flatnonzero([seen[0][w] + seen[1][w] >= 5 for w in words])
    seen_in = np.array([seen[0][w] + seen[1][w] for w in words])
    odds *= seen_in / (seen_in + SHRINK)
    order = common[np.argsort(np.abs(odds[common]))]
    best[own[order]] = odds[order]
    net["word"][:, 0] = np.clip(best, -3, 3)
    net["char"][:, 0] = 2 * np.clip(_gram_odds([{vocab[w] for w in x} for x in split], [g for _, g in number], toxic, n), -3, 3)
    parts = [windows(np.fromiter((vocab[w] for w in s), np.int64, len(s))) for s in split]
    every, doc = np.vstack(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sizes = np.array([len(g) for _, g in number])
    grams = np.fromiter((g for _, gs in number for g in gs), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(words)), sizes)
    rng = np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(epochs):
        rows = project(net, inputs(net, words))
        z = np.concatenate([forward(net, rows, every[i : i + CHUNK]) for i in range(0, len(every), CHUNK)])
        ranked = np.lexsort((-z, doc))
        starts = np.searchsorted(doc[ranked], np.arange(len(parts)))
        top = ranked[starts]
        more = rng.integers(0, len(every), len(parts) // 2)
        more = more[toxic[doc[more]] == 0]
        pick = rng.permutation(np.concatenate([top, more]))
        batch = max(16, min(256, len(pick) // 12))
        for i in range(0, len(pick), batch):
            b = pick[i : i + batch]
            used, ids = np.unique(every[b], return_inverse=True)
            ids = ids.reshape(len(b), WIDTH) - (used[0] < 0)
            used = used[used >= 0]
            if not len(used):
                continue
            x = inputs(net, [words[u] for u in used])
            rows = project(net, x)
            score, tape = forward(net, rows, ids, keep=True)
            g = ((_sigmoid(score) - toxic[doc[b]]) / len(b)).astype(np.float32)
            grads, d_rows = backward(net, rows, ids, tape, g)
            grads["wx"] = np.stack([x.T @ d_rows[k] for k in (0, 1)])
            grads["bx"] = d_rows.sum(1)
            d_x = sum(d_rows[k] @ net["wx"][k].T for k in (0, 1))
            step += 1
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            np.subtract.at(net["word"], own[used], rate * 0.5 * d_x[:, :D_WORD])
            inside = np.isin(of, used)
            back = np.zeros(len(words), np.int64)
            back[used] = np.arange(len(used))
            np.subtract.at(net["char"], grams[inside], rate * 0.5 * d_x[back[of[inside]], D_WORD:] / sizes[of[inside]][:, None])
    return net


class Scorer:
    """Scores texts; keeps what words add to the gates, up to CACHE_WORDS words."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows, self.used = np.zeros((2, 1024, 3 * H), np.float32), 0

    def learn(self, words: list[str]) -> None:
        need = self.used + len(words)
        if need > self.rows.shape[1]:
            grown = np.zeros((2, max(need, 2 * self.rows.shape[1]), 3 * H), np.float32)
            grown[:, : self.used] = self.rows[:, : self.used]
            self.rows = grown
        self.rows[:, self.used : need] = project(self.net, inputs(self.net, words))
        self.number.update(zip(words, range(self.used, need), strict=True))
        self.used = need

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), 200):
            split = [WORD.findall(t.lower()) if t else [] for t in texts[i : i + 200]]
            if self.used > CACHE_WORDS:
                self.clear()
            self.learn(list(set().union(*split) - self.number.keys()))
            parts = [windows(np.array([self.number[w] for w in s], np.int64)) for s in split]
            every = np.vstack(parts)
            z = np.concatenate([forward(self.net, self.rows, every[j : j + CHUNK]) for j in range(0, len(every), CHUNK)])
            sizes = np.array([len(p) for p in parts])
            out.append(np.maximum.reduceat(z, np.cumsum(sizes) - sizes))
        return _sigmoid(np.concatenate(out).astype(np.float64)) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, train_if: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_each: int = 1500, max_chars: int = 2_000_000, seed: int = 0) -> dict[str, np.ndarray]:
    """The network from the labelled documents where ``train_if`` (on the id) holds; null labels and texts are left out.

    Documents are taken by the order of a hash of their ids, whole; one that would exceed ``max_chars`` characters
    in its label's sample is passed over.
    """
    ok = F.lit(True) if train_if is None else train_if
    known = labels.where(ok & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("__y")).groupBy(id_col).agg(F.max("__y").alias("__y"))
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    one = lambda y: known.where(F.col("__y") == y).orderBy(*order).limit(2 * max_each)
    picked = one(0).unionByName(one(1))
    texts = docs.select(id_col, F.col(text_col).alias("__t")).where(F.col("__t").isNotNull()).join(F.broadcast(picked), id_col)  # bounded: 4 * max_each ids
    rows = []
    for y in (0, 1):
        mine = texts.where(F.col("__y") == y).select("__t", "__y", *[c.alias(f"__o{i}") for i, c in enumerate([*order, F.xxhash64("__t")])])
        sizes = mine.select("__o0", "__o1", "__o2", F.length("__t").alias("n")).orderBy("__o0", "__o1", "__o2").limit(2 * max_each).collect()
        left, take = max_chars, []
        for r in sizes:
            if len(take) < max_each and r["n"] <= left:
                left -= r["n"]
                take.append(tuple(r)[:3])
        if take:
            of = docs.sparkSession.createDataFrame(sorted(set(take)), mine.select("__o0", "__o1", "__o2").schema)
            got = mine.join(F.broadcast(of), ["__o0", "__o1", "__o2"], "left_semi").orderBy("__o0", "__o1", "__o2", "__t").limit(max_each)
            rows += got.select("__t", "__y").collect()
    return train([r["__t"] for r in rows], np.array([r["__y"] for r in rows], np.int64), seed=seed)


def score(docs: DataFrame, net: dict[str, np.ndarray], *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every row, null and empty texts too; a column named like it is replaced."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != score_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(scorer.score(b.column(text_col).to_pylist()))], [*rest, score_col])

    return docs.select(*rest).mapInArrow(each, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{score_col}` double"]))
