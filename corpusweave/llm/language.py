"""Language identification: script ranges, then Viterbi over words with a switching penalty.

Learning counts byte trigrams (with word edges) and whole words by language in a seeded sample of
about ``SAMPLE`` labelled documents, whose number bounds the work; all partitions count, the counts
are summed by language on the executors, and at most ``MOST_LANGS`` rows of them come to the driver
(more languages are refused, as each is a column of the broadcast model). The scripts that at least one in a
hundred of a language's letters use are its scripts.

Scoring: a word's script narrows the languages; its score for each is the smoothed log likelihood
of its trigrams, plus that of the word where it was seen, less the best language's, no lower than
``-CLIP`` so that one odd word can't decide a text. Viterbi then labels every word, paying
``PENALTY`` for each switch; words without letters follow their neighbours. The language with most
letter bytes in its spans is the text's, and its share of them is the score.

Where one language's path can't be beaten, which running sums show exactly, the path is not
traced word by word. A row depends on itself and the model alone: there is no shuffle. Null texts
and texts without a letter are ``und`` with score 0; without any learned language every text is.
Repeated rows agree, other columns are kept, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.frames import fresh, pick
from corpusweave.llm.textblocks import LOWER, Block, blocks, lean, mix

SAMPLE = 20_000
TRI_BITS, WORD_BITS = 16, 17
CLIP = 5.0
PENALTY = 20.0
MOST_LANGS = 400

#: Scripts by the lead byte of their letters in UTF-8: (name, first lead, last lead).
SCRIPTS = (("latin", 0x41, 0x7A), ("latin+", 0xC3, 0xC9), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD3), ("semitic", 0xD6, 0xDD), ("indic", 0xE0, 0xE0), ("asian", 0xE1, 0xE2), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED), ("other", 0xF0, 0xF4))


def script_table() -> np.ndarray:
    """Lead byte to 1 + script, 0 where the byte leads no letter."""
    t = np.zeros(256, np.uint8)
    for k, (_, lo, hi) in enumerate(SCRIPTS):
        t[lo : hi + 1] = k + 1
    t[0x5B:0x61] = 0
    return t


SCRIPT = script_table()
#: Latin letters with marks are of the Latin script.
SCRIPT[SCRIPT == 2] = 1


def word_features(block: Block) -> dict:
    """Bounds, trigram slots by byte, word slots, script and letter bytes by word."""
    low = Block(block.first, block.last, LOWER[block.data], block.bounds)
    starts, ends, texts = low.words()
    n = len(low.data)
    inside = np.zeros(n + 2, np.uint32)
    inside[1:-1] = low.data
    edge = np.zeros(n + 1, bool)
    edge[starts] = edge[ends] = True
    left = np.where(edge[:n], 0, inside[:-2])
    right = np.where(edge[1:], 0, inside[2:])
    tri = ((left * np.uint32(0x9E3779B1)) ^ (inside[1:-1] * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    kind = SCRIPT[low.data]
    letters = np.concatenate(([0], np.cumsum(kind > 0)))
    by_word = letters[ends] - letters[starts]
    script = np.zeros(len(starts), np.uint8)
    if len(starts):
        pieces = np.zeros(2 * len(starts), np.int64)
        pieces[::2], pieces[1::2] = starts, ends
        padded = np.concatenate([kind, [0]]).astype(np.uint8)
        script = np.maximum.reduceat(padded, pieces)[::2]
    return {"starts": starts, "ends": ends, "texts": texts, "tri": (tri >> np.uint32(32 - TRI_BITS)).astype(np.int32), "word": (mix(low.span_hashes(starts, ends)) >> np.uint64(64 - WORD_BITS)).astype(np.int32) if len(starts) else np.zeros(0, np.int32), "script": script, "letters": by_word}


@dataclass
class Model:
    langs: list[str]
    tri: np.ndarray
    word: np.ndarray
    scripts: np.ndarray

    def emissions(self, f: dict) -> np.ndarray:
        """Each word's score by language: 0 for the best, down to -CLIP."""
        sums = np.zeros((len(f["tri"]) + 1, len(self.langs)))
        np.cumsum(self.tri[f["tri"]], axis=0, out=sums[1:])
        e = sums[f["ends"]] - sums[f["starts"]] + self.word[f["word"]]
        e += np.where(self.scripts[f["script"]], 0.0, -50.0)
        e = np.maximum(e - e.max(1, keepdims=True), -CLIP)
        e[f["letters"] == 0] = 0
        return e


def viterbi(e: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of every row, where each change of label costs ``penalty``."""
    n, k = e.shape
    best, back = e[0].copy(), np.zeros((n, k), np.int32)
    own = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - penalty) + e[t]
    path = np.zeros(n, np.int32)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def settled(e: np.ndarray, texts: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language of the highest sum, and whether no path that switches can beat it.

    It can't where no stretch gains over half the penalty in another language: every stretch of
    another label costs half a switch at least.
    """
    sums = np.concatenate([np.zeros((1, e.shape[1])), np.cumsum(e, axis=0)])
    total = sums[texts[1:]] - sums[texts[:-1]]
    top = total.argmax(1)
    n = len(texts) - 1
    sure = np.ones(n, bool)
    if len(e):
        owner = np.repeat(np.arange(n), np.diff(texts))
        base = sums[np.arange(1, len(e) + 1), top[owner]]
        before = sums[np.arange(len(e)), top[owner]]
        far = 4.0 * (CLIP * len(e) + 1)
        for k in range(e.shape[1]):
            low = np.minimum.accumulate(sums[:-1, k] - before - far * owner)
            gain = sums[1:, k] - base - far * owner - low
            over = np.flatnonzero(gain > penalty / 2 + 1e-9)
            sure[owner[over]] = False
    return top, sure


def label_spans(block: Block, model: Model) -> tuple[dict, list[np.ndarray | int]]:
    """Word features and, by text, the labels of its words, or one label for all."""
    f = word_features(block)
    if not len(f["starts"]) or not model.langs:
        return f, [0] * (len(f["texts"]) - 1)
    e = model.emissions(f)
    top, sure = settled(e, f["texts"])
    return f, [int(top[i]) if sure[i] else viterbi(e[a:b]) for i, (a, b) in enumerate(zip(f["texts"][:-1], f["texts"][1:], strict=True))]


def _has_letter(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict_block(block: Block, model: Model) -> tuple[list[str], list[float]]:
    f, labels = label_spans(block, model)
    names, scores = [], []
    for i, own in enumerate(labels):
        a, b = f["texts"][i : i + 2]
        weight = f["letters"][a:b]
        if not model.langs or not _has_letter(block.text(i)):
            names.append("und")
            scores.append(0.0)
        elif isinstance(own, int) or not weight.any():
            names.append(model.langs[own if isinstance(own, int) else int(own[0])])
            scores.append(1.0)
        else:
            mass = np.bincount(own, weights=weight, minlength=len(model.langs))
            names.append(model.langs[int(mass.argmax())])
            scores.append(float(mass.max() / mass.sum()))
    return names, scores


SLOTS = (1 << TRI_BITS, 1 << WORD_BITS, len(SCRIPTS) + 1)
COUNTS = "lang string, slots binary, counts binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram, word and script counts by language over a block of texts, as slots that aren't 0 and their counts."""
    edges = np.cumsum([0, *SLOTS])
    for batch in batches:
        langs, out = batch.column(1).to_pylist(), []
        for block in blocks(batch.column(0)):
            f = word_features(block)
            by_text = np.array(langs[block.first : block.last], object)
            owner = np.repeat(np.arange(len(by_text)), np.diff(f["texts"]))
            byte_owner = np.repeat(owner, f["ends"] - f["starts"])
            at = np.repeat(f["starts"] - np.concatenate(([0], np.cumsum(f["ends"] - f["starts"])[:-1])), f["ends"] - f["starts"]) + np.arange(len(byte_owner)) if len(owner) else np.zeros(0, np.int64)
            for lang in sorted(set(by_text)):
                mine = by_text == lang
                words = mine[owner]
                sums = np.zeros(edges[-1], np.int64)
                sums[: edges[1]] = np.bincount(f["tri"][at[mine[byte_owner]]], minlength=SLOTS[0])
                sums[edges[1] : edges[2]] = np.bincount(f["word"][words], minlength=SLOTS[1])
                sums[edges[2] :] = np.bincount(f["script"][words], weights=f["letters"][words], minlength=SLOTS[2])
                some = np.flatnonzero(sums)
                out.append((lang, some.astype(np.int32).tobytes(), sums[some].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "slots", "counts"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a language: all its counts together."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, slots, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(lang, np.zeros(sum(SLOTS), np.int64))[np.frombuffer(slots, np.int32)] += np.frombuffer(counts, np.int64)
    for lang, sums in found.items():
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([sums[some].tobytes()], pa.binary())], ["lang", "slots", "counts"])


def train(docs: DataFrame, allowed=None, sample: int = SAMPLE, seed: int = 42) -> Model:
    """A model from about ``sample`` labelled documents of ``docs``; ``allowed`` filters them first."""
    rows = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(allowed) if allowed is not None else rows
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    partial = rows.select("text", "lang").mapInArrow(lean(_counts), COUNTS)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: dict[str, np.ndarray] = {}
    for lang, slots, counts in partial.repartition(width, "lang").mapInArrow(lean(_sums), COUNTS).limit(MOST_LANGS + 1).collect():
        if len(found) == MOST_LANGS:
            raise ValueError(f"over {MOST_LANGS} languages")
        found[lang] = np.zeros(sum(SLOTS), np.int64)
        found[lang][np.frombuffer(bytes(slots), np.int32)] = np.frombuffer(bytes(counts), np.int64)
    langs = sorted(found)
    if not langs:
        return Model([], np.zeros((1 << TRI_BITS, 0), np.float32), np.zeros((1 << WORD_BITS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    tri, word, script = np.split(np.stack([found[x] for x in langs], 1).astype(np.float64), np.cumsum(SLOTS)[:2])
    tri_log = np.log((tri + 0.2) / (tri.sum(0) + 0.2 * len(tri)))
    word_log = np.log((word + 0.5) / (word.sum(0) + 0.5 * len(word)))
    word_log -= word_log.max(1, keepdims=True)
    word_log[word.sum(1) < 3] = 0
    scripts = script >= 0.01 * np.maximum(1, script[1:].sum(0))
    scripts[0] = True
    scripts[~scripts.any(1)] = True
    return Model(langs, tri_log.astype(np.float32), np.maximum(word_log, -4).astype(np.float32), scripts)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    names, at = (fresh(docs, "lang_pred"), fresh(docs, "lang_score")), docs.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(names[0], F.lit(None).cast("string")).withColumn(names[1], F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for block in blocks(batch.column(at)):
                a, b = predict_block(block, shipped.value)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(langs, batch.schema.field(batch.num_columns - 2).type), pa.array(scores, pa.float64())], schema=batch.schema)

    return out.mapInArrow(lean(run), out.schema)
