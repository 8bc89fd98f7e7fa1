"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its leading 4, 5 and 6 bytes, so inflected
forms share what was learned of their stem. Filters of widths 1, 2 and 3 run over the words, each
keeps its maximum over the whole text, and a logistic layer turns the maxima into a score. Texts
are lowered (A-Z) before hashing; id, source and language are no inputs.

The embeddings' first dimension starts from the words' log odds in the training rows and a few
width-1 filters start by reading it; all weights are then trained together.

Training takes a seeded sample of about ``sample`` labelled rows (the documented bound of what the
driver holds), Adagrad on minibatches, and gives the same model for the same rows. A threshold for
each language comes from the rows set aside for it (one in five), by best F1; languages with too
few labels take the overall one. Scoring runs over whole texts in Arrow batches, without a shuffle.

A null or empty text has no words and takes the score of all-zero maxima; without labels of both
kinds the score is the labels' mean (0 without labels). Repeated rows score alike, other columns
are kept, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.frames import apart, fresh, pick
from corpusweave.llm.textblocks import LOWER, Block, blocks, lean, mix, trim

SAMPLE = 6_000
BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
PREFIXES = (4, 5, 6)
EPOCHS = 3
BATCH = 48
FEWEST = 30
TRAIN_BLOCK = 256 << 10
TRAIN_ROWS = 256
SCORE_BLOCK = 1 << 20


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for every word, and each text's bounds in the words."""
    low = Block(block.first, block.last, LOWER[block.data], block.bounds)
    starts, ends, texts = low.words()
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), texts
    shift = np.uint64(64 - BITS)
    out = [low.span_hashes(starts, ends) >> shift]
    for k, n in enumerate(PREFIXES):
        out.append(mix(low.span_hashes(starts, np.minimum(ends, starts + n)) + np.uint64(k + 1)) >> shift)
    return np.stack(out, 1).astype(np.int32), texts


@dataclass
class Model:
    """Weights; ``thresholds``: by language, with the overall one under None."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict = field(default_factory=dict)

    def convolve(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter outputs at each start, by width; a text of fewer words than a width is padded with zeros by the caller."""
        n = len(x)
        return [sum(x[j : n - w + 1 + j] @ f[j] for j in range(w)) for w, f in zip(WIDTHS, self.filters, strict=True)]

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified maxima of one text's words and where they are, -1 for none."""
        top, at = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1)
        for k, z in enumerate(self.convolve(x)):
            if len(z):
                i = z.argmax(0)
                v = z[i, np.arange(FILTERS)] + self.bias[k]
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                top[s], at[s] = np.maximum(v, 0), np.where(v > 0, i, -1)
        return top, at

    def scores(self, block: Block) -> np.ndarray:
        return self.scores_of(*features(block))

    def scores_of(self, rows: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Scores of texts by their words' table rows and the texts' bounds in them."""
        x = self.table[rows].sum(1) if len(rows) else np.zeros((0, DIM), np.float32)
        n, tops = len(texts) - 1, []
        for k, (w, z) in enumerate(zip(WIDTHS, self.convolve(x) if len(x) >= max(WIDTHS) else [np.zeros((0, FILTERS), np.float32)] * len(WIDTHS), strict=True)):
            top = np.zeros((n, FILTERS), np.float32)
            if len(x) < max(WIDTHS):
                z = sum(x[j : len(x) - w + 1 + j] @ self.filters[k][j] for j in range(w)) if len(x) >= w else z
            lo, hi = texts[:-1], texts[1:] - w + 1
            use = np.flatnonzero(hi > lo)
            if len(use):
                edges = np.stack([lo[use], hi[use]], 1).ravel()
                full = np.concatenate([z, np.full((1, FILTERS), -np.inf, np.float32)])
                top[use] = np.maximum(np.maximum.reduceat(full, np.minimum(edges, len(z)), axis=0)[::2] + self.bias[k], 0)
            tops.append(top)
        return 1 / (1 + np.exp(-(np.concatenate(tops, 1) @ self.out + self.out_bias).astype(np.float64)))


def _constant(p: float) -> Model:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(np.zeros((1 << BITS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), float(np.log(p / (1 - p))), {None: 0.5})


def _adagrad(value: np.ndarray, seen: np.ndarray, grad: np.ndarray, rate: float) -> None:
    seen += grad * grad
    value -= rate * grad / (np.sqrt(seen) + 1e-6)


def log_odds(rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Where the embeddings' first dimension starts: each row's log odds of label 1, by texts, shrunk to 0 for what one text alone has."""
    counts = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
    for i in np.flatnonzero(use).tolist():
        counts[int(labels[i])][np.unique(rows[bounds[i] : bounds[i + 1]])] += 1
    zero, one = counts
    prior = np.log((labels[use] == 0).sum() / (labels[use] == 1).sum())
    most = np.maximum(one, zero)
    return ((np.log((one + 0.5) / (zero + 0.5)) + prior) * np.maximum(0, (most - 1) / (most + 1))).clip(-2, 8).astype(np.float32)


def sample_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of all texts, taken in small blocks."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for lo in range(0, len(texts), TRAIN_ROWS):
        for block in blocks(texts.slice(lo, TRAIN_ROWS), TRAIN_BLOCK):
            rows, bounds = features(block)
            parts.append(rows)
            sizes.append(np.diff(bounds))
    bounds = np.cumsum(np.concatenate(sizes))
    out, at = np.empty((int(bounds[-1]), 1 + len(PREFIXES)), np.int32), 0
    parts.reverse()
    while parts:
        rows = parts.pop()
        out[at : at + len(rows)] = rows
        at += len(rows)
    return out, bounds


def fit(rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, langs: list[str | None], seed: int = 42, epochs: int = EPOCHS) -> Model:
    """Trains on whole texts, given as ``sample_features``; every fifth is set aside for the thresholds."""
    if not len(labels) or labels.min() == labels.max():
        return _constant(float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(labels)) % 5 == 4
    if len(set(labels[~aside])) < 2:
        aside[:] = False
    model = _constant(float(labels[~aside].mean()))
    model.table = 0.05 * rng.standard_normal(model.table.shape, np.float32)
    model.filters = [rng.normal(0, 0.5, f.shape).astype(np.float32) for f in model.filters]
    model.bias += 0.05
    model.out = rng.normal(0, 0.3, model.out.shape).astype(np.float32)
    model.table[:, 0] = 0.15 * log_odds(rows, bounds, labels, ~aside)
    model.filters[0][0][0, :4], model.bias[0, :4], model.out[:4] = 1.0, [-0.2, -0.6, -1.0, -1.4], 1.0
    seen = [np.zeros_like(model.table), [np.zeros_like(f) for f in model.filters], np.zeros_like(model.bias), np.zeros_like(model.out)]
    train, lanes = np.flatnonzero(~aside), np.arange(FILTERS)
    for epoch in range(epochs):
        rate = 0.06 if epoch < epochs - 1 else 0.02
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            g_f, g_b, g_o, g_ob = [np.zeros_like(f) for f in model.filters], np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            hit_rows, hit_grads = [], []
            for i in batch.tolist():
                own = rows[bounds[i] : bounds[i + 1]]
                x = model.table[own].sum(1)
                top, at = model.pool(x)
                p = 1 / (1 + np.exp(-float(top @ model.out + model.out_bias)))
                d = (p - float(labels[i])) / len(batch)
                g_o += d * top
                g_ob += d
                back = d * model.out
                for k, w in enumerate(WIDTHS):
                    a = at[k * FILTERS : (k + 1) * FILTERS]
                    live = a >= 0
                    if not live.any():
                        continue
                    a, b, lane = a[live], back[k * FILTERS : (k + 1) * FILTERS][live].astype(np.float32), lanes[live]
                    np.add.at(g_b[k], lane, b)
                    for j in range(w):
                        words = x[a + j]
                        g_f[k][j][:, lane] += words.T * b
                        hit_rows.append(own[a + j])
                        hit_grads.append(model.filters[k][j][:, lane].T * b[:, None])
            if hit_rows:
                index, place = np.unique(np.concatenate(hit_rows), return_inverse=True)
                grads = np.zeros((len(index), DIM), np.float32)
                np.add.at(grads, place.reshape(-1), np.repeat(np.concatenate(hit_grads), rows.shape[1], axis=0))
                part = seen[0][index] + grads * grads
                seen[0][index] = part
                model.table[index] -= rate * grads / (np.sqrt(part) + 1e-6)
            for k in range(len(WIDTHS)):
                _adagrad(model.filters[k], seen[1][k], g_f[k], rate * 0.3)
            _adagrad(model.bias, seen[2], g_b, rate * 0.3)
            _adagrad(model.out, seen[3], g_o, rate * 0.5)
            model.out_bias -= rate * g_ob
    held = aside if aside.any() else ~aside
    chosen = np.flatnonzero(held)
    scores = np.array([model.scores_of(rows[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))[0] for i in chosen])
    model.thresholds = calibrate(scores, labels[held], [x for x, h in zip(langs, held, strict=True) if h])
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict:
    """The threshold of best F1 by language; None has the one over all."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        cuts = np.linspace(0.2, 0.8, 25)
        f = [2 * (y[s >= c].sum()) / max(1, (s >= c).sum() + y.sum()) for c in cuts]
        near = cuts[np.flatnonzero(np.array(f) >= max(f) - 1e-9)]
        return float(near[np.abs(near - 0.4).argmin()])

    out: dict = {None: best(scores, labels)}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if labels[mine].sum() >= FEWEST and (1 - labels[mine]).sum() >= FEWEST:
            out[lang] = best(scores[mine], labels[mine])
    return out


def train(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = SAMPLE, seed: int = 42) -> Model:
    """A model from about ``sample`` labelled rows, by a seeded hash of the id; ``allowed`` filters the labels first."""
    marks = pick(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    marks = marks.filter(allowed) if allowed is not None else marks
    n = marks.count()
    share = min(1.0, sample / max(1, n))
    marks = marks.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).limit(2 * sample)
    rows = pick(docs, "doc_id", "text", "lang").join(F.broadcast(marks), "doc_id").select("doc_id", "text", "lang", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    toxic, langs = np.array(rows["toxic"].to_pylist(), np.float64), rows["lang"].to_pylist()
    texts = rows["text"]
    del rows
    words, bounds = sample_features(texts)
    del texts
    trim()
    model = fit(words, bounds, toxic, langs, seed)
    del words
    trim()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher where label 1 is likelier."""
    name, at = fresh(docs, "score"), docs.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.scores(block) for block in blocks(batch.column(at), SCORE_BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found) if found else [], pa.float64())], schema=batch.schema)

    return out.mapInArrow(lean(run), out.schema)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold."""
    scored = score(apart(docs, "text", "lang"), model)
    name = scored.columns[-1]
    limit = F.lit(model.thresholds[None])
    for lang, cut in model.thresholds.items():
        if lang is not None:
            limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(cut)).otherwise(limit)
    return scored.filter(F.col(name) < limit).drop(name).toDF(*docs.columns)
