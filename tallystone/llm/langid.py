"""Operator 6: language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's maximum over the
window, rectified, goes to a softmax layer. A document is cut into windows that cover all its bytes (the last one
padded by zeros), and its prediction is the mean of the windows' probabilities, weighted by their lengths.

Null texts and texts without letters are `und` with score 0. One-letter texts and texts of any length are predicted;
repeated rows get equal results; an empty table gives no rows. If nothing is labelled, or in one language only, there
is no network: every text with letters gets that language (score 1) or `und` (score 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, col, small_batches, utf8

WINDOW = 192
#: Most labelled documents in training, and windows of each. The sample is the rows with the least hashes of text and id.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 3
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 6


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width * EMBED x FILTERS
    bias: np.ndarray  # len(widths) * FILTERS
    out: np.ndarray  # (len(widths) * FILTERS + 1) x labels

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of byte windows (n x WINDOW)."""
        return _softmax(_add_one(np.maximum(self._pooled(x)[0], 0)) @ self.out)

    def _pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        e = self.embed[x]
        n, length, d = e.shape
        flat, best, at = np.ascontiguousarray(e).reshape(n, length * d), [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            steps = length - w + 1
            view = np.lib.stride_tricks.as_strided(flat, (n, steps, w * d), (flat.strides[0], d * flat.strides[1], flat.strides[1]))
            y = np.ascontiguousarray(view).reshape(n * steps, w * d) @ f
            y = y.reshape(n, steps, -1)
            if where:
                at.append(y.argmax(1))
            best.append(y.max(1))
        return np.concatenate(best, 1) + self.bias, at


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _add_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)


def train(windows: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> Network:
    """Adam on the cross entropy, with hand-written gradients; labels weigh equally."""
    rng = np.random.default_rng(seed)
    k = len(WIDTHS) * FILTERS
    net = Network(
        labels, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(k, np.float32), rng.normal(0, 0.1, (k + 1, len(labels))).astype(np.float32),
    )
    params = [net.embed, *net.filters, net.bias, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(y) / (len(labels) * np.maximum(np.bincount(y, minlength=len(labels)), 1))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x, target = windows[rows], y[rows]
            z, at = net._pooled(x, True)
            h = np.maximum(z, 0)
            p = _softmax(_add_one(h) @ net.out)
            g = p.copy()
            g[np.arange(len(rows)), target] -= 1
            g *= weight[target][:, None] / len(rows)
            d_out = _add_one(h).T @ g + 1e-4 * net.out
            d_h = (g @ net.out[:-1].T) * (z > 0)
            d_embed, d_filters = np.zeros_like(net.embed), []
            for j, w in enumerate(WIDTHS):
                d = d_h[:, j * FILTERS : (j + 1) * FILTERS]
                seen = x[np.arange(len(rows))[:, None, None], at[j][:, :, None] + np.arange(w)]  # row, filter, offset
                e = net.embed[seen].reshape(len(rows), FILTERS, w * EMBED)
                d_filters.append(np.einsum("nf,nfe->ef", d, e))
                back = (d[:, :, None] * net.filters[j].T[None]).reshape(-1, EMBED)
                np.add.at(d_embed, seen.reshape(-1), back)
            t += 1
            for q, (param, grad) in enumerate(zip(params, [d_embed, *d_filters, d_h.sum(0), d_out], strict=True)):
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.999 * v[q] + 0.001 * grad * grad
                param -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    return net


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all rows' bytes, zero padded; the row of each, and its number of bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    start = offsets[row] + (np.arange(len(row)) - first[row]) * WINDOW
    n = np.minimum(offsets[row + 1] - start, WINDOW)
    padded = np.concatenate([buf, np.zeros(WINDOW, np.uint8)])
    x = padded[start[:, None] + np.arange(WINDOW)]
    short = np.flatnonzero(n < WINDOW)
    x[short] = np.where(np.arange(WINDOW) < n[short][:, None], x[short], 0)
    return x, row, n


def training_sample(docs: DataFrame, text_col: str, lang_col: str, usable, docs_bound: int) -> list[tuple[bytes, str]]:
    """At most docs_bound * TRAIN_WINDOWS windows, picked by hashes over all usable rows, short enough to collect."""
    rows = docs.where(usable & col(lang_col).isNotNull() & col(text_col).isNotNull())
    n = rows.count()
    if not n:
        return []
    h = F.xxhash64(col(text_col), col(lang_col))
    limit = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * (1.3 * docs_bound / n)))
    picked = rows.where(h <= F.lit(limit)).select(h.alias("h"), F.encode(col(text_col), "UTF-8").alias("b"), col(lang_col).alias("lang"))
    spans = F.greatest(F.octet_length("b") - WINDOW, F.lit(0)) + 1
    parts = F.transform(F.sequence(F.lit(1), F.lit(TRAIN_WINDOWS)), lambda i: F.substring(F.col("b"), (F.pmod(F.xxhash64("h", i), spans) + 1).cast("int"), F.lit(WINDOW)))
    picked = picked.select("h", "lang", parts.alias("parts")).dropDuplicates(["h", "lang"])  # copies count once
    got = picked.orderBy("h", "lang").limit(docs_bound).collect()
    return [(bytes(w), r["lang"]) for r in got for w in r["parts"]]


def fit(docs: DataFrame, usable, text_col: str = "text", lang_col: str = "lang", docs_bound: int = TRAIN_DOCS) -> Network | list[str]:
    """A network, or the list of the labels where there are fewer than two."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, text_col, lang_col, usable, docs_bound)
    labels = sorted({lang for _, lang in sample})
    if len(labels) < 2:
        return labels
    x = np.zeros((len(sample), WINDOW), np.uint8)
    for i, (b, _) in enumerate(sample):
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    y = np.array([labels.index(lang) for _, lang in sample])
    return train(x, y, labels, epochs=max(8, min(40, 40_000 // len(sample))))


def predict(docs: DataFrame, net: Network | list[str], id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None) -> DataFrame:
    """(doc_id, the extra columns, lang_pred, score) of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c.alias(k) for k, c in (extra or {}).items()], col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            letters = [any(map(str.isalpha, t)) if t else False for t in column.to_pylist()]
            if isinstance(net, list):
                langs, scores = [net[0] if x and net else "und" for x in letters], [float(x and len(net) > 0) for x in letters]
            else:
                langs, scores = [], []
                buf, offsets = utf8(column)
                for i, j in chunks(offsets, 1 << 20):
                    total = np.zeros((j - i, len(net.labels)))
                    x, row, n = cut(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for a in range(0, len(x), 256):
                        p = net.windows(x[a : a + 256]) * n[a : a + 256, None]
                        np.add.at(total, row[a : a + 256], p)
                    total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
                    best = total.argmax(1)
                    for k in range(j - i):
                        langs.append(net.labels[best[k]] if letters[i + k] else "und")
                        scores.append(float(total[k, best[k]]) if letters[i + k] else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*schema, "lang_pred string", "score double"]))


def held_out(doc_id: str = "doc_id"):
    return F.expr(f"crc32(cast({doc_id} as string)) % 5 = 0")


def op6(docs: DataFrame) -> DataFrame:
    net = fit(docs, F.expr("crc32(cast(doc_id as string)) % 5 <> 0"))
    out = predict(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
