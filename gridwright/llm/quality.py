"""Quality by random indexing and a small network.

Every word has two random index vectors, sparse and ternary, drawn from a hash: one of its lower-cased form, one of its
shape (letters, capitals, digits and marks, runs collapsed). A word vector is the sum of the index vectors around the
word over the sample, learned for ``BUCKETS`` hash buckets; a bucket never seen keeps its index vector. A document is the
pooled mean of its word vectors with a few norms and shares, fed to a two-layer network in numpy. The temperature that
divides the network's output is fitted on a part of the sample the network has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.sample import SAMPLE_ROWS, labelled_sample
from gridwright.llm.textblocks import U, blocks, held_out_ids, lowered, mix, prefix_sums, span_hash, words

BUCKETS, DIMS, REACH = 1 << 14, 24, 2
HIDDEN, STEPS = 16, 400
PASS = 0.7

_KIND = np.arange(256, dtype=np.uint8)  # shapes: a letter, A capital, 0 digit; marks stay as they are
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


def index_vectors(salt: int) -> np.ndarray:
    """BUCKETS x DIMS, entries -1, 0, 1; one in four is not 0."""
    h = mix(np.arange(BUCKETS * DIMS, dtype=U) + U(salt << 40))
    return np.where(h & U(3) == 0, np.where(h & U(4) == 0, 1, -1), 0).reshape(BUCKETS, DIMS).astype(np.int8)


def _terms(data: np.ndarray, offs: np.ndarray):
    """Row, word bucket, shape bucket of each word, and whether it repeats the word before."""
    low = lowered(data)
    starts, ends, rows = words(data, offs)
    form = span_hash(prefix_sums(low), starts, ends)
    kind = _KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    at = np.concatenate([[0], np.cumsum(change)])
    shape = span_hash(prefix_sums(kind[change]), at[starts], at[ends]) if len(starts) else np.zeros(0, U)
    again = np.zeros(len(rows), bool)
    again[1:] = (form[1:] == form[:-1]) & (rows[1:] == rows[:-1])
    return rows, (form % U(BUCKETS)).astype(np.int64), (shape % U(BUCKETS)).astype(np.int64), again


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors around the words of each bucket, over all batches of a task."""
    form_index, shape_index = index_vectors(1).astype(np.float64), index_vectors(2).astype(np.float64)
    total = np.zeros((BUCKETS, DIMS))
    for batch in batches:
        for _, _, data, offs in blocks(batch.column("text")):
            rows, form, shape, _ = _terms(data, offs)
            for step in range(1, REACH + 1):
                if len(rows) <= step:
                    break
                near = rows[step:] == rows[:-step]
                for here, there in ((form[step:], slice(None, -step)), (form[:-step], slice(step, None))):
                    add = form_index[form[there][near]] + shape_index[shape[there][near]]
                    for d in range(DIMS):
                        total[:, d] += np.bincount(here[near], add[:, d], BUCKETS)
    seen = np.flatnonzero(np.abs(total).sum(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.ListArray.from_arrays(pa.array(np.arange(0, len(seen) * DIMS + 1, DIMS, dtype=np.int32)), pa.array(total[seen].ravel().astype(np.int64)))],
        ["bucket", "v"],
    )


def _pooled(vectors: np.ndarray, shapes: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Features of each text: mean word vector, mean shape vector, their norms, share of repeats, distinct share, length."""
    n = len(offs) - 1
    rows, form, shape, again = _terms(data, offs)
    out = np.zeros((n, 2 * DIMS + 5), np.float32)
    count = np.bincount(rows, minlength=n).astype(float)
    some = np.flatnonzero(count)
    if len(some):
        begin = np.searchsorted(rows, some)
        out[some, :DIMS] = np.add.reduceat(vectors[form], begin, axis=0)
        out[some, DIMS : 2 * DIMS] = np.add.reduceat(shapes[shape], begin, axis=0)
        out[:, : 2 * DIMS] /= np.maximum(count, 1)[:, None]
        out[:, 2 * DIMS] = np.linalg.norm(out[:, :DIMS], axis=1)
        out[:, 2 * DIMS + 1] = np.linalg.norm(out[:, DIMS : 2 * DIMS], axis=1)
        out[:, 2 * DIMS + 2] = np.bincount(rows, again, n) / np.maximum(count, 1)
        distinct = np.bincount(np.unique(rows * BUCKETS + form) // BUCKETS, minlength=n)
        out[:, 2 * DIMS + 3] = distinct / np.maximum(np.minimum(count, BUCKETS), 1)
    out[:, 2 * DIMS + 4] = np.log1p(count) / 10
    return out


@dataclass(frozen=True)
class Quality:
    """A fitted model of fixed size."""

    vectors: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        logit = np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(logit[:, 0] / self.temperature, -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score for every row of (doc_id, text). A null or empty text has the features of no words; repeated rows
        get equal scores."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offs in blocks(batch.column("text")):
                    p = self.probability(_pooled(self.vectors, self.shapes, data, offs))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(p.astype(float))], ["doc_id", "score"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> tuple:
    """Two layers (tanh, linear) by Adam on the whole sample, cross-entropy with smoothed labels and weight decay."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    smooth = 0.01 + 0.98 * y
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = (p - smooth[:, None]) / len(y)
        dh = (d @ params[2].T) * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], d.sum(0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(params)


def best_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross-entropy, from a fine grid."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 101))
    loss = [np.logaddexp(0, -np.where(y > 0, 1, -1) * logit / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, rows: int = SAMPLE_ROWS) -> Quality:
    """Learns from at most ``rows`` labelled documents that are not held out. Without any labelled text every score is 0.5."""
    sample = labelled_sample(docs, labels, "quality", modulus, remainder, rows)
    sums = sample.select("text").mapInArrow(_contexts, "bucket bigint, v array<bigint>").groupBy("bucket").agg(*[F.sum(F.col("v")[d]).alias(f"d{d}") for d in range(DIMS)])
    sums = sums.orderBy("bucket").toPandas()  # BUCKETS rows at most
    vectors, shapes = index_vectors(1).astype(np.float32), index_vectors(2).astype(np.float32)
    if len(sums):
        vectors[sums["bucket"].to_numpy()] = sums.drop(columns="bucket").to_numpy(np.float32)
    for v in (vectors, shapes):
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("text")):
                x = _pooled(vectors, shapes, data, offs)
                size = x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * size + 1, size, dtype=np.int32)), pa.array(x.ravel())), batch.column("label").slice(lo, hi - lo), batch.column("part").slice(lo, hi - lo)],
                    ["x", "label", "part"],
                )

    seen = sample.mapInArrow(run, "x array<float>, label int, part int").toPandas()  # at most ``rows`` rows
    seen = seen.assign(key=[np.asarray(v, np.float32).tobytes() for v in seen["x"]]).sort_values(["part", "label", "key"])  # the same order in every run
    size = 2 * DIMS + 5
    if not len(seen):
        zero = (np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1))
        return Quality(vectors, shapes, np.zeros(size), np.ones(size), zero, 1.0)
    x, y, part = np.stack(seen["x"].to_numpy()).astype(float), (seen["label"].to_numpy() > 0).astype(float), seen["part"].to_numpy()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / scale
    learn = part != 0 if 0 < (part != 0).sum() < len(part) else np.ones(len(part), bool)
    layers = train_network(z[learn], y[learn])
    rest = ~learn if (~learn).any() else learn
    logit = (np.tanh(z[rest] @ layers[0] + layers[1]) @ layers[2] + layers[3])[:, 0]
    return Quality(vectors, shapes, mean, scale, layers, best_temperature(logit, y[rest]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``. Labels serve learning only."""
    scored = fit_quality(docs, labels).score(docs)
    return scored.select("doc_id", held_out_ids("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= PASS, 1).otherwise(0).alias("predicted"))
