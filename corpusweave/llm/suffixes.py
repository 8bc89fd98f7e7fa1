"""Suffix-array dedup of byte strings by a common-prefix-aware distributed merge sort.

A byte is removed when a string of ``LENGTH`` bytes that covers it starts earlier: in a smaller
document, or earlier in the same one. Equal strings hold the same anchor at the same offset: the
place of the least hash among their ``GRAM``-byte grams. So only suffixes at anchors are sorted,
about one in thirty-three, and of these only those whose gram a count-min sketch (see
``substrings``; merged from partial sketches, losing none, broadcast or dealt over slices by its
size) has counted twice or more.

Each task sorts its suffixes, with the bytes left of the anchor as the rest of the key, folds equal
keys into the earliest of them, and cuts the sorted run at fixed splitters of the order. What it
folds goes out beside the run, from one run of the pass, so results don't depend on tasks. Runs are
exchanged front-coded: for each suffix the length of the prefix it shares with the one before, and
the other bytes. Each receiver merges its runs with a loser tree whose nodes carry common prefix
lengths: the longer one wins unseen, and equal ones are compared from there on, so known prefixes
are never compared again, neither those within a run nor those met in the merge.

Neighbours' common prefixes in the merged order then settle every string around an anchor: with
``o`` bytes left of it and the rest right, strings are equal when the common prefix reaches the
rest and the left bytes agree; all but the earliest are repeats. Anchors give each document the
stretches to remove.

The order's first part is the gram's hash, so ranges are even whatever the texts are. Copies fold
within each run and then in the merge, and a receiver holds one part at a time: the number of parts
grows with the input, of tasks up to ``MOST_PARTITIONS``. Rows of equal id and text count as one occurrence; rows without an id come last;
texts under ``LENGTH`` bytes lose nothing; null is an empty text; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.frames import fresh
from corpusweave.llm.substrings import LAST, MOST_PARTITIONS, prefiltered, sliding_min
from corpusweave.llm.textblocks import _BYTES, Block, blocks, from_planes, lean, mix, planes, whole_windows

LENGTH = 100
GRAM = 36
LEFT = LENGTH - GRAM
HEAD = 8
KEY = HEAD + LENGTH + LEFT + 2
HELD = 80_000
PART_BYTES = 8 << 20
SMALL_BLOCK = 256 << 10

RUN = "part int, shared binary, rest binary, doc binary, row binary, at binary"
STRETCHES = "doc long, row long, at array<int>"


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~values, width)


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors of a block's texts, and their grams' hashes."""
    n = len(block.data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _BYTES.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((block.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    width = LENGTH - GRAM + 1
    least = sliding_min(grams, width)
    least[~whole_windows(block.bounds, LENGTH, n)] = 0
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding_max(np.concatenate([none, least, none]), width) == grams)
    return at, grams[at]


def keys_at(block: Block, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Sort keys of anchors: gram hash (mixed again, as anchors have the least hashes), bytes from the anchor on, bytes before it (nearest first), both lengths; zero-padded."""
    owner = np.searchsorted(block.bounds, at, "right") - 1
    right = np.minimum(block.bounds[owner + 1] - at, LENGTH)
    left = np.minimum(at - block.bounds[owner], LEFT)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), block.data, np.zeros(LENGTH, np.uint8)])
    spans = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[at]
    out = np.zeros((len(at), KEY), np.uint8)
    out[:, :HEAD] = mix(grams).astype(">u8").view(np.uint8).reshape(-1, HEAD)
    out[:, HEAD : HEAD + LENGTH] = spans[:, LEFT:] * (np.arange(LENGTH) < right[:, None])
    out[:, HEAD + LENGTH : -2] = spans[:, :LEFT][:, ::-1] * (np.arange(LEFT) < left[:, None])
    out[:, -2], out[:, -1] = right, left
    return out


def shared_prefixes(keys: np.ndarray) -> np.ndarray:
    """Bytes that each key shares with the one before; 0 for the first."""
    out = np.zeros(len(keys), np.int16)
    for lo in range(1, len(keys), 1 << 16):
        differ = keys[lo : lo + (1 << 16)] != keys[lo - 1 : lo - 1 + len(keys[lo : lo + (1 << 16)])]
        out[lo : lo + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), KEY)
    return out


def fold(shared: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order: the earliest of each set of equal keys, and all the other occurrences."""
    group = np.cumsum(shared < KEY)
    order = np.lexsort((at, row, doc, group))
    first = np.concatenate(([True], group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, bool)
    earliest = order[first]
    which = np.cumsum(first) - 1
    same = (doc[order] == doc[earliest][which]) & (row[order] == row[earliest][which]) & (at[order] == at[earliest][which])
    return earliest, order[~same]


def whole_stretch(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For occurrences of a key seen earlier: whether any string fits it, and the bytes that all its strings cover."""
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    return right + left >= LENGTH, at - left, at + right


def united(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches in order, united where they meet in a document."""
    order = np.lexsort((start, row, doc))
    doc, row, start, end = (x[order] for x in (doc, row, start, end))
    n = len(doc)
    apart = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))[:n]
    base = np.cumsum(apart) * (1 << 40)
    reach = np.maximum.accumulate(end + base)
    gap = np.flatnonzero(apart | np.concatenate(([True], (start + base)[1:] > reach[:-1]))[:n])
    last = np.concatenate((gap[1:] - 1, [n - 1])).astype(np.int64) if n else gap
    return doc[gap], row[gap], start[gap], (reach - base)[last]


def by_document(doc: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """United stretches (starts, then ends) as one list a document."""
    each = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))[: len(doc)])
    offsets = (2 * np.append(each, len(doc))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc[each]), pa.array(row[each]), pa.ListArray.from_arrays(offsets, pa.array(bounds.reshape(2, -1).T.ravel()))], ["doc", "row", "at"])


def by_stretch(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row a stretch: a document's anchors are spread over the parts, so there is little to unite in one."""
    offsets = pa.array(np.arange(0, 2 * len(doc) + 1, 2, dtype=np.int32))
    bounds = pa.array(np.stack([start, end], 1).ravel().astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.ListArray.from_arrays(offsets, bounds)], ["doc", "row", "at"])


RUN_COLUMNS = ["part", "shared", "rest", "doc", "row", "at"]


def anchor_marks(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's anchor grams and the places of their texts."""
    at, grams = anchors(block)
    return grams, np.searchsorted(block.bounds, at, "right") - 1


def sorted_run(keys: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One sorted run, cut into parts and front-coded, and the stretches that it settles by itself (no ``shared``; ``at`` holds starts, then ends)."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}").ravel(), kind="stable")
    keys, doc, row, at = keys[order], doc[order], row[order], at[order]
    earliest, others = fold(shared_prefixes(keys), doc, row, at)
    fits, start, end = whole_stretch(keys[others], at[others])
    if fits.any():
        gone = united(doc[others][fits], row[others][fits], start[fits], end[fits])
        part = int(mix(gone[0][:1].view(np.uint64) + np.uint64(len(gone[0])))[0] % np.uint64(parts))
        ends = np.concatenate(gone[2:]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (None, None, *map(planes, (*gone[:2], ends))))], RUN_COLUMNS)
    keys, doc, row, at = keys[earliest], doc[earliest], row[earliest], at[earliest]
    head = keys[:, :4].copy().view(">u4").ravel().astype(np.uint64)
    part = (head * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    shared = shared_prefixes(keys)
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    shared[edges] = 0
    out = []
    for a, b in itertools.pairwise([*edges.tolist(), len(part)]):
        rest = keys[a:b][np.arange(KEY) >= shared[a:b, None]]
        out.append((int(part[a]), shared[a:b].astype(np.uint8).tobytes(), rest.tobytes(), planes(doc[a:b]), planes(row[a:b]), planes(at[a:b].astype(np.int32))))
    for a in range(0, len(out), 64):
        columns = zip(*out[a : a + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.int32()), *(pa.array(list(c), pa.binary()) for c in columns)], RUN_COLUMNS)


class FrontCoded:
    """A front-coded run, read key by key."""

    def __init__(self, shared: bytes, rest: bytes):
        self.shared, self.rest, self.i, self.at, self.key = shared, rest, 0, 0, b""

    def next(self) -> int:
        """Steps to the next key; the prefix it shares with the one before, or -1 at the end."""
        if self.i == len(self.shared):
            return -1
        same = self.shared[self.i]
        self.key = self.key[:same] + self.rest[self.at : self.at + KEY - same]
        self.at += KEY - same
        self.i += 1
        return same


def merge_runs(runs: list[FrontCoded]) -> Iterator[tuple[int, int]]:
    """(run, shared): runs in the order of their keys, with the prefix each key shares with the one before.

    A loser tree: every entry carries the prefix it shares with the last key given out. Of two
    entries the one that shares more comes first; only equal ones are compared, from there on.
    """
    n = len(runs)
    size = 1 << max(0, (n - 1).bit_length())
    shares = [r.next() for r in runs] + [-1] * (size - n)

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = shares[a], shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0 or x == KEY:
            return (a, b) if a < b else (b, a)
        p, q = runs[a].key, runs[b].key
        differ = int.from_bytes(p[x:], "big") ^ int.from_bytes(q[x:], "big")
        same = KEY - (differ.bit_length() + 7) // 8
        if p <= q:
            shares[b] = same
            return a, b
        shares[a] = same
        return b, a

    losers, winners = [0] * size, list(range(size))
    width, base = size, size
    while width > 1:
        width, base = width // 2, base // 2
        games = [play(winners[2 * i], winners[2 * i + 1]) for i in range(width)]
        for i, (_, b) in enumerate(games):
            losers[base + i] = b
        winners = [a for a, _ in games]
    top = winners[0]
    while shares[top] >= 0:
        yield top, shares[top]
        shares[top] = runs[top].next()
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def settle(keys: np.ndarray, shared: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most and the least bytes left of each anchor of a string that is a repeat; -1 where there is none."""
    n = len(keys)
    reach = np.where(shared >= HEAD, shared - HEAD, 0).astype(np.int64)
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    most, least = np.full(n, -1), np.full(n, -1)
    met = np.zeros(n, bool)
    met[1:] = reach[1:] >= GRAM
    live = np.flatnonzero(met | np.concatenate((met[1:], [False])))
    if not len(live):
        return most, least
    hashes = np.zeros(len(live), np.uint64)
    for o in range(LEFT + 1):
        if o:
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + keys[live, HEAD + LENGTH + o - 1].astype(np.uint64) + np.uint64(1)
        group = np.cumsum(reach < LENGTH - o)[live]
        ok = np.flatnonzero((right[live] >= LENGTH - o) & (left[live] >= o))
        if len(ok) < 2:
            continue
        key = mix(mix(hashes[ok]) + group[ok].astype(np.uint64))
        order = np.lexsort((rank[live[ok]], key))
        later = np.concatenate(([False], key[order][1:] == key[order][:-1]))
        hit = live[ok[order[later]]]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return most, least


def merge_part(blobs: list[tuple]) -> pa.RecordBatch | None:
    """Merges one part's runs and gives the stretches to remove."""
    doc, row = (np.concatenate([from_planes(b[k], np.int64) for b in blobs]) for k in (2, 3))
    at = np.concatenate([from_planes(b[4], np.int32) for b in blobs]).astype(np.int64)
    first = np.concatenate(([0], np.cumsum([len(b[0]) for b in blobs]))).tolist()
    runs = [FrontCoded(b[0], b[1]) for b in blobs]
    seen, index, shared, keys = [0] * len(runs), array("i"), bytearray(), bytearray()
    for run, same in merge_runs(runs):
        index.append(first[run] + seen[run])
        seen[run] += 1
        shared.append(same)
        if same < KEY:
            keys += runs[run].key
    index, shared = np.frombuffer(index, np.int32), np.frombuffer(shared, np.uint8).astype(np.int64)
    shared[:1] = 0
    doc, row, at = doc[index], row[index], at[index]
    table = np.frombuffer(keys, np.uint8).reshape(-1, KEY)
    earliest, others = fold(shared, doc, row, at)
    of = np.cumsum(shared < KEY) - 1
    fits, start, end = whole_stretch(table[of[others]], at[others])
    out = [(doc[others][fits], row[others][fits], start[fits], end[fits])]
    doc, row, at, shared = doc[earliest], row[earliest], at[earliest], shared[shared < KEY]
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((at, row, doc))] = np.arange(len(doc))
    most, least = settle(table, shared, rank)
    hit = most >= 0
    out.append((doc[hit], row[hit], at[hit] - most[hit], at[hit] - least[hit] + LENGTH))
    merged = [np.concatenate(x) for x in zip(*out, strict=True)]
    return by_stretch(*merged) if len(merged[0]) else None


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, row, at): by document and text hash, bounds of the byte stretches to remove."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, maybe = prefiltered(rows, size, (LEFT + 2) / 2, anchor_marks, SMALL_BLOCK)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield from sorted_run(*columns, parts)

        for batch in batches:
            docs_of, rows_of = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in blocks(batch.column(2), SMALL_BLOCK):
                at, grams = anchors(block)
                ok = maybe(batch, block, grams)
                at, grams = at[ok], grams[ok]
                for lo in range(0, len(at), HELD):
                    some = at[lo : lo + HELD]
                    owner = np.searchsorted(block.bounds, some, "right") - 1
                    held.append((keys_at(block, some, grams[lo : lo + HELD]), docs_of[block.first + owner], rows_of[block.first + owner], some - block.bounds[owner]))
                    if sum(len(x[1]) for x in held) >= HELD:
                        yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in batch.columns]
                if values[0] != now and blobs:
                    if (out := merge_part(blobs)) is not None:
                        yield out
                    blobs = []
                now = values[0]
                if values[1] is None:
                    yield by_document(*(from_planes(v, t) for v, t in zip(values[3:], (np.int64, np.int64, np.int32), strict=True)))
                else:
                    blobs.append(values[1:])
        if blobs and (out := merge_part(blobs)) is not None:
            yield out

    runs = rows.mapInArrow(lean(sort), RUN)
    merged = runs.repartition(min(parts, MOST_PARTITIONS), "part").sortWithinPartitions("part").mapInArrow(lean(merge), STRETCHES)
    return merged.groupBy("doc", "row").agg(F.flatten(F.collect_list("at")).alias("at"))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``suffixes``: n_bytes, n_removed, n_spans and kept (the other bytes)."""
    name = fresh(docs, "suffixes")
    doc, row, at = (fresh(docs, c) for c in ("repeat_doc", "repeat_row", "repeat_at"))
    gone = repeats(docs, text).toDF(doc, row, at)
    joined = docs.join(gone, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(doc)) & (F.xxhash64(text) == F.col(row)), "left").drop(doc, row)
    out = joined.withColumn(name, F.lit(None).cast("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"))
    text_at, stretch_at = docs.columns.index(text), joined.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretches, columns = batch.column(stretch_at), [[], [], [], []]
            for block in blocks(batch.column(text_at)):
                for i in range(block.last - block.first):
                    data = block.data[block.bounds[i] : block.bounds[i + 1]]
                    keep = np.ones(len(data), bool)
                    if stretches[block.first + i].is_valid:
                        pairs = stretches[block.first + i].values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                        change = np.zeros(len(data) + 1, np.int64)
                        np.add.at(change, pairs[:, 0], 1)
                        np.add.at(change, pairs[:, 1], -1)
                        keep = np.cumsum(change[:-1]) == 0
                    edges = np.diff(np.concatenate(([0], (~keep).astype(np.int8))))
                    for column, value in zip(columns, (len(data), len(data) - int(keep.sum()), int((edges == 1).sum()), data[keep].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])], schema=batch.schema)

    return out.mapInArrow(lean(run), out.schema).drop(at)
