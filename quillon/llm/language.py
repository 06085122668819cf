"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut, whole, into windows of WINDOW bytes. Filters of several widths run over the one-hot bytes of a window, are
max-pooled over its places and feed a softmax layer; since the input is one-hot, a filter is a table per place and its
response a sum of table rows. A text's answer is the softmax of the mean of its windows' logits, weighted by the bytes
that they hold.

Training is supervised, on a bounded sample of labelled rows: about TRAIN_DOCS documents, drawn by hash in proportion to
their languages but LABEL_DOCS of each language, if it has as many, with at most WINDOWS_PER_DOC windows each at hashed
places of the whole text. Weights start from a fixed seed and windows come in
a fixed order, so reruns agree. The loss weighs a language by the root of its share. Prediction reads nothing but the text.

Ties between languages go to the first by name. Repeated rows are predicted one by one and learned from once.

Defined results: `und` with score 0 for a null text, one without any letter, or if nothing labelled was there to learn
from. Very long texts are read to the end, in bounded batches. An empty table gives an empty result. Columns that
predict() adds carry a prefix, so input columns of other names survive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, spread

P = "__language_"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound of the training sample.
TRAIN_DOCS = 2500
#: Documents of a language that are learned from at least, and most languages.
LABEL_DOCS = 40
MOST_LABELS = 1000
WINDOWS_PER_DOC = 4
EPOCHS = 8
#: Steps that even a small sample is given.
LEAST_STEPS = 300
#: Windows whose responses are held at once.
BLOCK = 32

LETTER = regex.compile(r"\p{L}")


class ByteCNN:
    """The network; labels are the learned languages in order."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled responses of windows x (n, WINDOW), and the places they come from."""
        out, where = [], []
        for t, w in zip(self.tables, WIDTHS, strict=True):
            m = x.shape[1] - w + 1
            r = t[0][x[:, :m]]
            for j in range(1, w):
                r += t[j][x[:, j : j + m]]
            if places:
                at = r.argmax(axis=1)
                where.append(at)
                out.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            else:
                out.append(r.max(axis=1))
        return np.concatenate(out, axis=1), where

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.pooled(x[i : i + BLOCK])[0] for i in range(0, len(x), BLOCK)]
        return np.tanh(np.concatenate(parts)) @ self.dense + self.bias

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11, rate: float = 0.02, epochs: int = EPOCHS) -> None:
        """Adam on the class-weighted cross entropy; a pooled response passes its gradient to the place it came from."""
        rng = np.random.default_rng(seed)
        # between equal weights for windows and for languages, so that a few wrong labels can't speak for a language
        share = np.maximum(np.bincount(y, minlength=len(self.labels)), 1) / len(y)
        weight = (np.sqrt(1 / (len(self.labels) * share))).astype(np.float32)
        params = [*self.tables, self.dense, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        batch = 64
        turns = max(epochs, -(-LEAST_STEPS * batch // len(y)))
        for epoch in range(turns):
            lr = rate * 0.5 ** (epoch * epochs / turns / 3)
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                xb, yb = x[i], y[i]
                pre, places = self.pooled(xb, places=True)
                h = np.tanh(pre)
                z = h @ self.dense + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p
                d[np.arange(len(i)), yb] -= 1
                d *= weight[yb][:, None] / len(i)
                back = (d @ self.dense.T) * (1 - h * h)
                grads = []
                for k, (t, w) in enumerate(zip(self.tables, WIDTHS, strict=True)):
                    g = np.zeros_like(t)
                    part, f = back[:, k * FILTERS : (k + 1) * FILTERS], np.arange(FILTERS)[None, :]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, places[k] + j, 1), np.broadcast_to(f, part.shape)), part)
                    grads.append(g)
                grads += [h.T @ d, d.sum(axis=0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Labels and scores of texts, all windows of each."""
        sums, sizes = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        held, owner, fill, count = [], [], [], 0

        def flush() -> None:
            nonlocal count
            if held:
                z = self.logits(np.concatenate(held))
                f = np.concatenate(fill)
                np.add.at(sums, np.concatenate(owner), z * f[:, None])
                np.add.at(sizes, np.concatenate(owner), f)
                held.clear(), owner.clear(), fill.clear()
                count = 0

        for i, t in enumerate(texts):
            for at in range(0, len(t), WINDOW * 1024):
                x, f = windows(t[at : at + WINDOW * 1024])
                held.append(x), fill.append(f), owner.append(np.full(len(x), i))
                count += len(x)
                if count >= 1024:
                    flush()
        flush()
        z = sums / np.maximum(sizes, 1)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.labels[b] for b in best], p[np.arange(len(texts)), best]


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zero bytes, and how many bytes each holds."""
    n = -(-len(text) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    f = np.full(n, WINDOW, np.float64)
    if n:
        f[-1] = len(text) - WINDOW * (n - 1)
    return x.reshape(n, WINDOW), f


def held_out(id_col: str) -> Column:
    """The fold that is never learned from; a null id belongs to none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs: int = TRAIN_DOCS) -> ByteCNN | None:
    """A network trained on about `docs` labelled rows outside the held-out fold; None if there are none."""
    text = F.col(text_col)
    usable = df.where(~held_out(id_col) & F.col(label_col).isNotNull() & text.rlike(r"\p{L}"))
    known = df.where(~held_out(id_col) & F.col(label_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label_col).count().limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    if not sizes:
        return None
    n = sum(sizes.values())
    # rows by the hash of id and text: the expected number is the bound
    chance = {k: int(min(1.0, max(docs / n, LABEL_DOCS / m)) * 2**30) for k, m in sizes.items()}
    drawing = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(chance.items()) for x in kv]), F.col(label_col))
    drawn = usable.where(F.xxhash64(F.col(id_col), text, F.lit("train")).bitwiseAND(2**30 - 1) < drawing)
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)),
        lambda i: F.substring(
            text,
            (F.pmod(F.xxhash64(F.col(id_col), i), F.greatest(F.char_length(text) - WINDOW, F.lit(0)) + 1) + 1).cast("int"),
            F.lit(WINDOW),
        ),
    )
    rows = drawn.select(F.col(label_col).alias("label"), F.array_sort(F.array_distinct(spots)).alias("spots")).distinct().collect()
    pieces = sorted({(r["label"], s) for r in rows for s in r["spots"] if LETTER.search(s)})
    if not pieces:
        return None
    labels = sorted({p[0] for p in pieces})
    x = np.concatenate([windows(s.encode()[:WINDOW])[0] for _, s in pieces])
    net = ByteCNN(labels)
    net.train(x, np.array([labels.index(a) for a, _ in pieces]))
    return net


def predict(df: DataFrame, net: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """df with the prefixed columns lang and score. The network, some 200 KB, travels with the function."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            lang, score = np.full(len(series), "und", object), np.zeros(len(series))
            # a few texts at a time, so that long ones don't pile up
            for at in range(0, len(series), 512):
                part = series.iloc[at : at + 512]
                ask = [i for i, t in enumerate(part) if t is not None and t == t and LETTER.search(t)]
                if net is not None and ask:
                    found, p = net.predict([part.iloc[i].encode() for i in ask])
                    lang[at + np.array(ask)], score[at + np.array(ask)] = found, p
            yield pd.DataFrame({"lang": lang, "score": score})

    bound_batches(df.sparkSession)
    # so called, it is not run again for each use of its answer
    asked = F.pandas_udf(answer, "lang string, score double").asNondeterministic()
    out = spread(df).withColumn(P + "answer", asked(F.col(text_col)))
    return out.withColumns({P + "lang": F.col(P + "answer.lang"), P + "score": F.col(P + "answer.score")}).drop(P + "answer")
