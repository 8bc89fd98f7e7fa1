"""Substring dedup: a count-min prefilter, then exact grouping of what may repeat.

A window is ``WINDOW`` consecutive words of a document. Its value is the least hash among the
``GRAM``-word grams inside it, so equal windows have equal values and neighbouring windows mostly
share one. First pass: each partition counts the values of its documents, once a document, in a
count-min sketch of ``DEPTH`` rows; partial sketches travel as lists of touched cells, cut into
slices, and are merged slice by slice, saturating at two. About eight cells a value are taken, at
any size. Up to ``2**MOST_BITS`` cells a row the merged sketch, one bit a cell for "twice or more",
is broadcast. A larger one never leaves its slices (``suspects``): values go to the slice that
counts them, wait there until it is complete, and only those counted twice go back to their texts.
A value met twice within a chunk needs no answer, so a common one brings one question a chunk.

Second pass: windows whose value is estimated to be in two documents are grouped by a 128-bit hash
of their words. A chunk of rows first settles what repeats inside it: only the smallest document
of each window goes on, so even a window that a third of all documents hold brings one row a
chunk. The smallest document over all chunks decides the rest. What a chunk settles and what it
leaves come out of one run of the pass, so the result doesn't depend on how chunks form. Removed
stretches go back to their documents by id and a hash of the text.

A window counts as seen earlier only in a smaller ``doc_id``; rows of one id don't remove each
other's words; rows without an id come last. Null texts and those under ``WINDOW`` words lose
nothing. Empty tables give empty results; other columns are kept; a lost task is run again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.frames import fresh
from corpusweave.llm.textblocks import BLOCK_BYTES, Block, blocks, from_planes, lean, mix, planes, rolling, whole_windows

WINDOW = 50
GRAM = 25
DEPTH = 2
LEAST_BITS, MOST_BITS = 20, 29
SLICES = 256
HOME_BITS = 25
MOST_PARTITIONS = 20_000
HELD = 1_000_000
LAST = (1 << 63) - 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n, out, have = len(values) - width + 1, values, 1
    if n <= 0:
        return values[:0]
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def window_values(block: Block, window: int = WINDOW, gram: int = GRAM):
    """Word bounds and text bounds, word hashes, starts of all windows and the value of each."""
    starts, ends, texts = block.words()
    n = len(starts)
    hashes = block.span_hashes(starts, ends) if n else np.zeros(0, np.uint64)
    if n < window:
        return starts, ends, texts, hashes, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(whole_windows(texts, window, n))
    return starts, ends, texts, hashes, at, sliding_min(rolling(hashes, gram), window - gram + 1)[at]


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(values + np.uint64(0xA0761D6478BD642F * (row + 1) & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_by_text(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, each once for every text that has it, and these texts."""
    if not len(values):
        return values, owner
    change = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
    values, owner = values[change], owner[change]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
    return values[first], owner[first]


def text_marks(window: int = WINDOW, gram: int = GRAM):
    """What a block of texts brings to the sketch: the values of its windows, each once a text, and the places of these texts."""

    def of(block: Block) -> tuple[np.ndarray, np.ndarray]:
        _, _, texts, _, starts, values = window_values(block, window, gram)
        return distinct_by_text(values, np.searchsorted(texts, starts, "right") - 1)

    return of


def text_values(window: int = WINDOW, gram: int = GRAM):
    """The values of ``text_marks`` alone."""
    marks = text_marks(window, gram)
    return lambda block: marks(block)[0]


def sketch(docs: DataFrame, bits: int, values_of, text: str = "text", block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """The merged sketch of ``values_of`` all blocks: for each row of cells, packed bits for counts of two and more."""
    at, low = docs.columns.index(text), bits - int(math.log2(SLICES))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held)
            held.clear()
            for row in range(DEPTH):
                cell, n = np.unique(cells(values, row, bits), return_counts=True)
                edges = np.searchsorted(cell, np.arange(SLICES + 1) << low)
                own = (cell & ((1 << low) - 1)).astype(np.uint32)
                parts = [(own[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row * SLICES + s for s in range(SLICES)], pa.int32()), pa.array([planes(c[k == 1]) for c, k in parts], pa.binary()), pa.array([planes(c[k > 1]) for c, k in parts], pa.binary())], ["slice", "once", "more"])

        for batch in batches:
            for block in blocks(batch.column(at), block_bytes):
                held.append(values_of(block))
                if sum(map(len, held)) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["slice", "bits"])

        for batch in batches:
            for s, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield packed()
                    now, counts = s, np.zeros(1 << low, np.uint8)
                one = from_planes(once, np.uint32)
                counts[one] = np.minimum(counts[one] + 1, 2)
                counts[from_planes(more, np.uint32)] = 2
        if now is not None:
            yield packed()

    parts = docs.mapInArrow(lean(partial), "slice int, once binary, more binary")
    merged = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slice").sortWithinPartitions("slice").mapInArrow(lean(merge), "slice int, bits binary")
    out = np.zeros((DEPTH, 1 << max(0, bits - 3)), np.uint8).reshape(DEPTH * SLICES, -1)
    for row in merged.toLocalIterator():
        out[row["slice"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.reshape(DEPTH, -1)


def maybe_repeated(values: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """True where the sketch has counted a value twice or more."""
    ok = np.ones(len(values), bool)
    for row in range(DEPTH):
        c = cells(values, row, bits)
        ok &= (table[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def suspects(rows: DataFrame, bits: int, marks_of, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, row, maybe): by text of (doc, row, text), its values that a sketch of ``2**bits`` cells a row has counted twice or more.

    The sketch is dealt over slices of ``2**HOME_BITS`` cells. A slice's counts come before the
    values that ask for them, so a task holds one slice and streams the rest.
    """
    slices = 1 << max(0, bits - HOME_BITS)

    def home(values: np.ndarray) -> np.ndarray:
        return ((cells(values, DEPTH, 32).astype(np.uint64) * np.uint64(slices)) >> np.uint64(32)).astype(np.int32)

    def listed(kind: int, where: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        offsets = pa.array(np.append(first, len(where)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order].view(np.int64))) for c in columns]
        lists += [pa.nulls(len(first), pa.list_(pa.int64()))] * (3 - len(lists))
        return pa.RecordBatch.from_arrays([pa.array(where[first]), pa.array(np.full(len(first), kind, np.int32)), *lists], ["slice", "kind", "value", "doc", "row"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values, doc, row = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((row, doc, values))
            values, doc, row = values[order], doc[order], row[order]
            new = np.concatenate(([True], values[1:] != values[:-1]))
            twice = (np.diff(np.append(np.flatnonzero(new), len(values))) > 1)[np.cumsum(new) - 1]
            own = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))) | new
            for kind, some, columns in ((0, new & twice, (values,)), (1, ~twice, (values,)), (2, ~twice, (values, doc, row)), (3, own & twice, (values, doc, row))):
                if some.any():
                    picked = [c[some] for c in columns]
                    yield listed(kind, home(picked[0] if kind < 3 else picked[0] ^ mix(picked[1].view(np.uint64))), *picked)

        for batch in batches:
            docs_of, rows_of = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for block in blocks(batch.column(2), block_bytes):
                values, owner = marks_of(block)
                if len(values):
                    held.append((values, docs_of[block.first + owner], rows_of[block.first + owner]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros((DEPTH, 0), np.uint8)
        for batch in batches:
            where, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (kinds[1:] != kinds[:-1])))) if len(where) else []
            for a, b in itertools.pairwise([*edges, len(where)]):
                if where[a] != now:
                    now, counts = where[a], np.zeros((DEPTH, 1 << HOME_BITS), np.uint8)
                values, doc, row = (batch.column(k).slice(a, b - a).flatten().to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                at = [cells(values.view(np.uint64), r, HOME_BITS) for r in range(DEPTH)]
                if kinds[a] == 0:
                    for r in range(DEPTH):
                        counts[r][at[r]] = 2
                elif kinds[a] == 1:
                    for r in range(DEPTH):
                        cell, n = np.unique(at[r], return_counts=True)
                        counts[r][cell] = np.minimum(counts[r][cell] + np.minimum(n, 2), 2)
                else:
                    ok = np.logical_and.reduce([counts[r][at[r]] > 1 for r in range(DEPTH)]) if kinds[a] == 2 else np.ones(len(values), bool)
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (doc, row, values)], ["doc", "row", "value"])

    parts = min(MOST_PARTITIONS, max(slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.mapInArrow(lean(deal), "slice int, kind int, value array<long>, doc array<long>, row array<long>")
    found = dealt.repartition(parts, "slice").sortWithinPartitions("slice", "kind").mapInArrow(lean(answer), "doc long, row long, value long")
    return found.groupBy("doc", F.col("row").cast(rows.schema["row"].dataType).alias("row")).agg(F.collect_set("value").alias("maybe"))


def prefiltered(rows: DataFrame, size: int, per_value: float, marks_of, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Callable]:
    """``rows`` (doc, row, text) to scan again, and the filter of their values: (batch, block, values) to those that may repeat.

    By a broadcast sketch up to ``MOST_BITS``; beyond that rows come with their own list of such values, those without any stay away.
    """
    bits = sketch_bits(size, per_value)
    if bits > MOST_BITS:

        def among(batch: pa.RecordBatch, block: Block, values: np.ndarray) -> np.ndarray:
            return np.isin(values, batch.column(3).slice(block.first, block.last - block.first).flatten().to_numpy(zero_copy_only=False).view(np.uint64))

        return rows.join(suspects(rows, bits, marks_of, block_bytes), ["doc", "row"]).select("doc", "row", "text", "maybe"), among
    shipped = rows.sparkSession.sparkContext.broadcast(sketch(rows, bits, lambda block: marks_of(block)[0], block_bytes=block_bytes))
    return rows, lambda batch, block, values: maybe_repeated(values, shipped.value, bits)


def _candidates(docs: DataFrame, maybe: Callable, window: int, gram: int) -> DataFrame:
    """From (doc, row, text): the windows left to settle with their keys, and ``settled`` stretches, known to repeat from within a chunk."""

    def batch_of(k1, k2, doc, row, at, settled: bool) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (np.diff(at) > 1))))
        end = at[np.concatenate((first[1:] - 1, [len(at) - 1]))] + 1
        return pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), pa.array(doc[first]), pa.array(row[first]), pa.array(at[first].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(len(first), settled))], ["k1", "k2", "doc", "row", "start", "end", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            k1, k2, doc, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((at, row, doc, k2, k1))
            k1, k2, doc, row, at = (x[order] for x in (k1, k2, doc, row, at))
            new_key = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            own = doc == doc[new_key][np.cumsum(new_key) - 1]
            yield batch_of(k1[own], k2[own], doc[own], row[own], at[own], False)
            doc, row, at = doc[~own], row[~own], at[~own]
            if len(doc):
                order = np.lexsort((at, row, doc))
                doc, row, at = doc[order], row[order], at[order]
                yield batch_of(mix(doc.view(np.uint64) + mix(row.astype(np.uint64))).view(np.int64), np.zeros(len(doc), np.int64), doc, row, at, True)

        for batch in batches:
            docs_of, rows_of = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in blocks(batch.column(2)):
                _, _, texts, hashes, starts, values = window_values(block, window, gram)
                if not len(starts):
                    continue
                pick = starts[maybe(batch, block, values)]
                if len(pick):
                    owner = np.searchsorted(texts, pick, "right") - 1
                    held.append((rolling(hashes, window)[pick].view(np.int64), rolling(mix(hashes + np.uint64(0x2545F4914F6CDD1D)), window)[pick].view(np.int64), docs_of[block.first + owner], rows_of[block.first + owner], pick - texts[owner]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(lean(run), "k1 long, k2 long, doc long, row int, start int, end int, settled boolean")


def row_hash(text: str):
    """Tells texts of one id apart."""
    return F.coalesce(F.hash(text), F.lit(0))


def sketch_bits(size: int, per_value: float) -> int:
    """Bits of a cell's number: about eight cells for each value that ``size`` bytes bring."""
    return max(LEAST_BITS, math.ceil(math.log2(max(2.0, 8 * size / per_value))))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """(doc, row, at): by document and text hash, stretches of window starts seen in a smaller document."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), row_hash(text).alias("row"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = _candidates(*prefiltered(rows, size, 6 * (window - gram + 2) / 2, text_marks(window, gram)), window, gram)
    least = F.min(F.when(~F.col("settled"), F.col("doc"))).over(Window.partitionBy("k1", "k2"))
    both = found.withColumn("least", least).filter("settled or doc > least")
    return both.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("at"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``substrings``: n_words, n_removed and kept (the other words, joined by one space)."""
    name = fresh(docs, "substrings")
    doc, row, at = (fresh(docs, c) for c in ("repeat_doc", "repeat_row", "repeat_at"))
    gone = repeats(docs, window, gram, text).toDF(doc, row, at)
    joined = docs.join(gone, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(doc)) & (row_hash(text) == F.col(row)), "left").drop(doc, row)
    out = joined.withColumn(name, F.lit(None).cast("struct<n_words:bigint,n_removed:bigint,kept:string>"))
    text_at, stretch_at = docs.columns.index(text), joined.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretches, n_words, n_removed, kept = batch.column(stretch_at), [], [], []
            for block in blocks(batch.column(text_at)):
                starts, ends, texts = block.words()
                for i in range(block.last - block.first):
                    lo, hi = int(texts[i]), int(texts[i + 1])
                    keep = np.ones(hi - lo, bool)
                    if stretches[block.first + i].is_valid:
                        own = stretches[block.first + i].values
                        change = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(change, own.field("start").to_numpy(zero_copy_only=False), 1)
                        np.add.at(change, own.field("end").to_numpy(zero_copy_only=False) + window - 1, -1)
                        keep = np.cumsum(change[:-1]) == 0
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - int(keep.sum()))
                    words = block.text(i).split()
                    kept.append((b" ".join(words) if keep.all() else b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])], schema=batch.schema)

    return out.mapInArrow(lean(run), out.schema).drop(at)
