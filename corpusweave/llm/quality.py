"""Quality rules: compression bands over whole documents and fixed chunks.

Each text is compressed with zstandard as a whole and in chunks of ``CHUNK`` bytes. A text is
rejected when its whole ratio (compressed by raw bytes) leaves the band for its length, as
repetitive below or incompressible above, or when over ``CHUNK_SHARE`` of its full chunks leave
``CHUNK_BAND``. Short texts have wider bands, as the frame's overhead and the little context move
their ratios; under the first band's length the ratio says nothing and nothing is rejected by it.

The base counts come along: words, code points in words, symbols, repeated lines and words in
repeated three-word windows. A row depends on itself alone: there is no shuffle. Null and empty
texts have zero counts and fail the base rule (fewer than 50 words); repeated rows give repeated
results; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.frames import fresh
from corpusweave.llm.textblocks import SPACE, Block, blocks, lean, mix, rolling, whole_windows

LEVEL = 3
CHUNK = 4096
#: (from so many bytes on, lowest ratio kept, highest ratio kept)
BANDS = ((128, 0.20, 1.20), (256, 0.22, 1.00), (1024, 0.20, 0.85), (4096, 0.15, 0.75), (65536, 0.12, 0.72))
CHUNK_BAND = (0.12, 0.80)
CHUNK_SHARE = 0.30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

KIND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("ratio", T.DoubleType()), T.StructField("bad_chunks", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("verdict", T.StringType())]
)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, texts: np.ndarray, width: int = 3) -> np.ndarray:
    """True at the words inside windows of ``width`` that their text has twice or more."""
    n = len(hashes)
    change = np.zeros(n + 1, np.int32)
    valid = np.flatnonzero(whole_windows(texts, width, n))
    if len(valid):
        owner = np.searchsorted(texts, valid, "right").astype(np.uint64)
        keys = mix(rolling(hashes, width)[valid] + mix(owner))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        at = valid[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
    return np.cumsum(change[:n]) > 0


def verdict(n_bytes: int, ratio: float, bad: int, chunks: int) -> str:
    """``keep``, ``repetitive``, ``incompressible`` or ``chunks``."""
    band = next((b for b in reversed(BANDS) if n_bytes >= b[0]), None)
    if band and ratio < band[1]:
        return "repetitive"
    if band and ratio > band[2]:
        return "incompressible"
    return "chunks" if chunks and bad > CHUNK_SHARE * chunks else "keep"


def measure(block: Block, compressor) -> list[dict]:
    starts, ends, texts = block.words()
    repeat = np.concatenate(([0], np.cumsum(repeated_words(block.span_hashes(starts, ends), texts)))) if len(starts) else np.zeros(1, np.int64)
    points = np.concatenate(([0], np.cumsum(~SPACE[block.data] & ((block.data & 0xC0) != 0x80))))
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[block.data])))
    rows = []
    for i in range(block.last - block.first):
        text, (lo, hi), (a, b) = block.text(i), texts[i : i + 2], block.bounds[i : i + 2]
        ratio = len(compressor.compress(text)) / len(text) if text else 0.0
        chunk = [len(compressor.compress(text[j : j + CHUNK])) / CHUNK for j in range(0, len(text) - CHUNK + 1, CHUNK)]
        bad = sum(not CHUNK_BAND[0] <= x <= CHUNK_BAND[1] for x in chunk)
        rows.append({"n_words": int(hi - lo), "word_chars": int(points[b] - points[a]), "n_symbols": int(symbols[b] - symbols[a]), "n_dup_lines": repeated_lines(text), "n_repeat_words": int(repeat[hi] - repeat[lo]), "ratio": ratio, "bad_chunks": bad, "n_chunks": len(chunk), "verdict": verdict(len(text), ratio, bad, len(chunk))})
    return rows


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``quality`` of counts, ratios and the bands' verdict."""
    name, at = fresh(docs, "quality"), docs.columns.index(text)
    out = docs.withColumn(name, F.lit(None).cast(KIND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = [r for block in blocks(batch.column(at)) for r in measure(block, compressor)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    return out.mapInArrow(lean(run), out.schema)


def base_failed(q: str = "quality"):
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the base rule or the bands reject."""
    found = assess(docs)
    q = found.columns[-1]
    return found.filter(~base_failed(q) & (F.col(f"{q}.verdict") == "keep")).drop(q)
