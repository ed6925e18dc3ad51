"""Toxicity by maximum-scoring segments.

Learning: every token gives its word and the word's prefixes of 4 to 8 bytes. A feature's count in a class is the number
of different words it follows there, so copies of a passage count once. The log-odds of the two classes have a Dirichlet
prior in proportion to the counts of both; features that are significant become the lexicon.

Scoring: a token has the largest log-odds of its features in the lexicon, or a constant penalty. A linear-time scan finds
all maximal scoring segments. Their scores are calibrated by the extreme-value distribution of segment scores in clean
text: a segment of score S among n tokens has the expectation ``n * exp(-lambda * S)``. A document's evidence is the sum
over its significant segments; a logistic curve fitted on the sample turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.sample import SAMPLE_ROWS, labelled_sample
from gridwright.llm.storage import stored
from gridwright.llm.textblocks import U, blocks, held_out_ids, lowered, mix, prefix_sums, span_hash, tokens

PREFIXES = (4, 5, 6, 7, 8)
#: Strength of the prior as a share of all counts, least z-score and log-odds of a lexicon entry.
PRIOR, LEAST_Z, LEAST_ODDS = 0.1, 3.3, 1.5
#: Share of lexicon tokens expected in a toxic passage; other tokens score log(1 - DENSITY).
DENSITY = 0.2
#: Bound of the lexicon; a sample of SAMPLE_ROWS stays far below it.
MAX_LEXICON = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _features(data: np.ndarray, offs: np.ndarray):
    """Tokens (runs of letters): start, end, row, and one hash a feature: the word, then each proper prefix (0: none)."""
    low = lowered(data)
    starts, ends, rows = tokens(_LETTER[low], offs)
    sums = prefix_sums(low)
    out = [span_hash(sums, starts, ends)]
    for n in PREFIXES:
        cut = np.minimum(starts + n, ends)
        h = mix(span_hash(sums, starts, cut) + U(n))
        out.append(np.where(ends - starts > n, h, U(0)))
    return starts, ends, rows, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (feature, word before, label) of each block."""
    for batch in batches:
        labels = np.asarray(batch.column("label")).astype(np.int64)
        for lo, _, data, offs in blocks(batch.column("text")):
            _, _, rows, features = _features(data, offs)
            if not len(rows):
                continue
            before = np.where(np.append([-1], rows[:-1]) == rows, np.append(U(0), features[0][:-1]), U(0))
            before = (before << U(1)) | labels[lo + rows].astype(U)
            f, b = np.concatenate(features), np.tile(before, len(features))
            keep = f != 0
            both = np.unique(np.stack([f[keep], b[keep]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array((both[:, 1] & U(1)).astype(np.int32))], ["feature", "before", "label"])


def segments(places: list[int], scores: list[float], penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a token sequence in which only ``places`` have positive ``scores`` and every other
    token costs ``penalty``: (first, last, score). Linear: each candidate is merged or left once."""
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    links: list[int] = []  # the nearest candidate to the left with a smaller total before
    total, last = 0.0, None
    for place, score in zip(places, scores, strict=True):
        total -= penalty * (place - (last + 1 if last is not None else 0))
        last = place
        here = (place, place, total, total + score)
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= here[2]:
                j = links[j]
            if j < 0 or found[j][3] >= here[3]:
                found.append(here)
                links.append(j)
                break
            here = (found[j][0], here[1], found[j][2], here[3])
            del found[j:], links[j:]
    return [(a, b, after - before) for a, b, before, after in found]


@dataclass(frozen=True)
class Toxicity:
    """A fitted model; its size is bounded by the sample it was fitted on."""

    keys: np.ndarray  # sorted feature hashes
    odds: np.ndarray
    rate: float  # lambda of the extreme-value distribution
    slope: float = 1.0
    offset: float = 0.0

    @property
    def penalty(self) -> float:
        return -math.log(1 - DENSITY)

    def _token_scores(self, features: list[np.ndarray]) -> np.ndarray:
        best = np.zeros(len(features[0]))
        if len(self.keys):
            for f in features:
                at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
                best = np.maximum(best, np.where(self.keys[at] == f, self.odds[at], 0.0))
        return best

    def passages(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], np.ndarray]:
        """Evidence of each text, its significant passages (first byte, end byte, expectation) and its tokens."""
        n = len(offs) - 1
        starts, ends, rows, features = _features(data, offs)
        score = self._token_scores(features)
        count = np.bincount(rows, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)])
        evidence, spans = np.zeros(n), [[] for _ in range(n)]
        hits = np.flatnonzero(score > 0)
        begin = np.flatnonzero(np.diff(rows[hits], prepend=-1))
        for part in np.split(hits, begin[1:]) if len(hits) else []:
            row = int(rows[part[0]])
            for a, b, s in segments((part - first[row]).tolist(), score[part].tolist(), self.penalty):
                expected = math.log(max(count[row], 1)) - self.rate * s
                if expected < 0:
                    evidence[row] -= expected
                    spans[row].append((int(starts[first[row] + a]), int(ends[first[row] + b]), math.exp(expected)))
        return evidence, spans, count

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score (0 to 1), passages (code points, end exclusive) for every row of (doc_id, text). A null, empty or
        letterless text has no evidence and gets the score of no evidence; repeated rows get equal scores."""
        schema = "doc_id bigint, score double, passages array<struct<start:int,end:int,expectation:double>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expectation", pa.float64())]))
            for batch in batches:
                for lo, hi, data, offs in blocks(batch.column("text")):
                    evidence, spans, _ = self.passages(data, offs)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    out = [[{"start": int(points[a] - points[offs[i]]), "end": int(points[b] - points[offs[i]]), "expectation": e} for a, b, e in sorted(s)] for i, s in enumerate(spans)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(self.probability(evidence)), pa.array(out, kind)], ["doc_id", "score", "passages"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)

    def keep_clean(self, docs: DataFrame, limit: float = 0.7) -> DataFrame:
        """The rows of ``docs``, with all their columns, that score less than ``limit``; no shuffle."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offs in blocks(batch.column("text")):
                    clean = self.probability(self.passages(data, offs)[0]) < limit
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)


def _decay(odds: np.ndarray, share: np.ndarray, penalty: float) -> float:
    """lambda with mean(exp(lambda * score)) = 1 over clean tokens."""
    if not len(odds):
        return 1.0
    value = lambda x: float((share * np.exp(x * odds)).sum() + (1 - share.sum()) * math.exp(-x * penalty))
    low, high = 1e-3, 1e-3
    while value(high) < 1 and high < 16:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull towards 1 and -2."""
    w, start = np.array([1.0, -2.0]), np.array([1.0, -2.0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(2), z.T @ (p - y) + (w - start))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, rows: int = SAMPLE_ROWS) -> Toxicity:
    """Learns from at most ``rows`` labelled documents that are not held out. Without labels of both classes, or without a
    significant feature, the lexicon is empty and every text gets the same score."""
    sample = labelled_sample(docs, labels, "toxic", modulus, remainder, rows)
    pairs = sample.select("text", "label").mapInArrow(_count, "feature bigint, before bigint, label int").distinct()
    counts = stored(pairs.groupBy("feature").agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0")), "counts")
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    n = max(n1 + n0, 1.0)
    prior = PRIOR * n
    alpha = (F.col("y1") + F.col("y0")) * F.lit(prior / n)
    odds = F.log((F.col("y1") + alpha) / (n1 + prior - F.col("y1") - alpha)) - F.log((F.col("y0") + alpha) / (n0 + prior - F.col("y0") - alpha))
    z = odds / F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    kept = counts.where("y1 > 1").select("feature", "y0", odds.alias("odds"), z.alias("z")).where(f"z >= {LEAST_Z} and odds >= {LEAST_ODDS}")
    kept = kept.orderBy(F.desc("z"), "feature").limit(MAX_LEXICON).toPandas() if n1 and n0 else None
    keys = kept["feature"].to_numpy(np.int64).view(U) if kept is not None else np.zeros(0, U)
    order = np.argsort(keys)
    odds_of = kept["odds"].to_numpy(float)[order] if kept is not None else np.zeros(0)
    clean = (kept["y0"].to_numpy(float)[order] + 0.5 / max(len(keys), 1)) / (n0 + 0.5) if kept is not None else np.zeros(0)
    model = Toxicity(keys[order], odds_of, _decay(odds_of, clean, -math.log(1 - DENSITY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(model.passages(data, offs)[0]), batch.column("label").slice(lo, hi - lo)], ["x", "label"])

    seen = sample.select("text", "label").mapInArrow(run, "x double, label int").toPandas().sort_values(["x", "label"])  # at most ``rows`` rows
    if not len(seen):
        return model
    slope, offset = _logistic(seen["x"].to_numpy(float), (seen["label"].to_numpy() > 0).astype(float))
    return Toxicity(model.keys, model.odds, model.rate, slope, offset)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of ``docs``. Labels serve learning only."""
    scored = fit_toxicity(docs, labels).score(docs)
    return scored.select("doc_id", held_out_ids("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "passages")
