"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts are lowered (A-Z only) and cut into words of letters, digits and bytes from 0x80. Every
window of ``width`` consecutive item words, or a shorter item's whole sequence, goes into a hash
set that is broadcast. Documents are scanned batch by batch: rolling hashes of their word windows
are looked up in the set, and each hit is verified word for word before it counts.

The set is flat arrays (sorted hashes, places in the items' normalised texts), about 26 bytes a
window and the texts, and is broadcast in blocks of about ``BLOCK_WINDOWS`` windows, at least one
item each. A benchmark of more blocks is scanned in as many stages, each written to the checkpoint
folder before the next, so a worker holds one block at a time; the hits are united. There is no
shuffle: a document's result depends on its row alone, so hot sources and repeated rows cost what
other rows cost, and a lost task is simply run again.

``decontaminate`` drops a document that holds a whole window of ``width`` words of any item, however
long the document is, since that much verbatim text is no accident; windows of shorter items count
by their share of the document's words only. Or it cuts the hit runs and keeps the documents.

Nulls and empty texts have no words and are never contaminated; rows of equal content give equal
results; a null ``item_id`` marks words but is not listed; columns may clash in case; empty tables give empty results or
clean documents. Other columns of the documents are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.frames import apart, cut, fresh, pick
from corpusweave.llm.textblocks import LOWER, Block, blocks, lean, rolling, whole_windows

WIDTH = 13
BLOCK_WINDOWS = 1_000_000

PARTS = np.ones(256, bool)
PARTS[48:58] = PARTS[97:123] = PARTS[128:] = False

RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of one text."""
    block = Block(0, 1, LOWER[np.frombuffer(text, np.uint8)], np.array([0, len(text)]))
    starts, ends, _ = block.words(PARTS)
    return [block.data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


@dataclass
class Windows:
    """All windows of one length: sorted hashes, bounds in the items' text, places of the items, a bit for each leading part of a hash."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    first: np.ndarray
    shift: np.uint64


class WindowSet:
    """Windows of benchmark items, by length, with the items each belongs to."""

    def __init__(self):
        self.items: list[str | None] = []
        self.text = bytearray()
        self.windows: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.n = 0

    def add(self, item: str | None, words: list[bytes], width: int) -> None:
        m = min(width, len(words))
        if not m:
            return
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        text = b" ".join(words)
        block = Block(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        hashes = rolling(block.span_hashes(starts, ends), m)
        base = len(self.text)
        self.windows.setdefault(m, []).append((hashes, starts[: len(hashes)] + base, ends[m - 1 :] + base, np.full(len(hashes), len(self.items), np.int32)))
        self.items.append(item)
        self.text += text
        self.n += len(hashes)

    def tables(self) -> tuple[bytes, list[str | None], dict[int, Windows]]:
        """The items' text, their names, and the windows by length."""
        out = {}
        for m, found in self.windows.items():
            hashes, starts, ends, owners = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            bits = min(24, max(16, int(8 * len(hashes)).bit_length()))
            first = np.zeros(1 << bits, bool)
            first[hashes >> np.uint64(64 - bits)] = True
            out[m] = Windows(hashes[order], starts[order], ends[order], owners[order], first, np.uint64(64 - bits))
        return bytes(self.text), self.items, out


def window_blocks(benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_WINDOWS) -> Iterator[WindowSet]:
    """The benchmark's windows in sets of about ``most``; rows come to the driver a partition at a time."""
    found = WindowSet()
    for row in pick(benchmark, "item_id", "text").toLocalIterator():
        found.add(None if row[0] is None else str(row[0]), words_of((row[1] or "").encode()), width)
        if found.n >= most:
            yield found
            found = WindowSet()
    yield found


def scan_block(block: Block, tables: tuple, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]], set[int]]:
    """Word starts, ends and text bounds; True at hit words; the items found in each text; the texts with windows of ``width`` words."""
    text, names, by_length = tables
    low = Block(block.first, block.last, LOWER[block.data], block.bounds)
    starts, ends, texts = low.words(PARTS)
    n = len(starts)
    change, items, whole = np.zeros(n + 1, np.int32), {}, set()
    if n:
        hashes = low.span_hashes(starts, ends)
        for m, table in by_length.items():
            h = rolling(hashes, m)
            at = np.flatnonzero(table.first[h >> table.shift])
            at = at[whole_windows(texts, m, n)[at]] if len(at) else at
            lo, hi = (np.searchsorted(table.hashes, h[at], side) for side in ("left", "right"))
            known = np.flatnonzero(hi > lo)
            at, lo, hi = at[known], lo[known], hi[known]
            owner = np.searchsorted(texts, at, "right") - 1
            for i, o, a, b in zip(at.tolist(), owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
                own = b" ".join(low.data[s:e].tobytes() for s, e in zip(starts[i : i + m], ends[i : i + m], strict=True))
                seen = [names[table.owners[k]] for k in range(a, b) if text[table.starts[k] : table.ends[k]] == own]
                if seen:
                    change[i] += 1
                    change[i + m] -= 1
                    items.setdefault(o, set()).update(x for x in seen if x is not None)
                    if m == width:
                        whole.add(o)
    return starts, ends, texts, np.cumsum(change[:n]) > 0, items, whole


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, most: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with one struct column ``hits``: n_words, n_hit, items (sorted strings), runs (word bounds of hit runs), spans (their UTF-8 byte bounds) and whole (true with a window of ``width`` words)."""
    spark, column = docs.sparkSession, fresh(docs, "hits")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", RUNS), T.StructField("spans", RUNS), T.StructField("whole", T.BooleanType())])
    at = docs.columns.index(text)
    out = docs.withColumn(column, F.lit(None).cast(kind))
    for number, block_set in enumerate(window_blocks(benchmark, width, most)):
        out = cut(out) if number else out
        shipped = spark.sparkContext.broadcast(block_set.tables())

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            tables = shipped.value
            for batch in batches:
                before, rows = batch.column(batch.num_columns - 1), []
                for block in blocks(batch.column(at)):
                    starts, ends, texts, hit, items, whole = scan_block(block, tables, width)
                    for i in range(block.last - block.first):
                        lo, hi = int(texts[i]), int(texts[i + 1])
                        mine, found, base = hit[lo:hi], items.get(i, set()), int(block.bounds[i])
                        old = before[block.first + i].as_py() if before.null_count < len(before) else None
                        if old:
                            mine, found = mine.copy(), found | set(old["items"])
                            for r in old["runs"]:
                                mine[r["start"] : r["end"]] = True
                        runs = _runs(mine) if mine.any() else []
                        rows.append({"n_words": hi - lo, "n_hit": int(mine.sum()), "items": sorted(found), "runs": [{"start": a, "end": b} for a, b in runs], "spans": [{"start": int(starts[lo + a]) - base, "end": int(ends[lo + b - 1]) - base} for a, b in runs], "whole": i in whole or bool(old and old["whole"])})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, before.type)], schema=batch.schema)

        out = out.mapInArrow(lean(run), out.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", share: float = 0.05, width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with hit runs cut from their texts.

    A document is contaminated when a window of ``width`` words is hit, or at least ``share`` of its words, and one at least, are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    found = scan(apart(docs, "text"), benchmark, width=width)
    hits = found.columns[-1]
    if remove == "documents":
        bad = F.col(f"{hits}.whole") | ((F.col(f"{hits}.n_hit") > 0) & (F.col(f"{hits}.n_hit") >= F.lit(share) * F.col(f"{hits}.n_words")))
        return found.filter(~F.coalesce(bad, F.lit(False))).drop(hits).toDF(*docs.columns)
    raw = F.col("text").cast("binary")
    bounds = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col(f"{hits}.spans"), F.array(F.struct(F.octet_length("text").alias("start"), F.octet_length("text").alias("end"))))
    pieces = F.transform(F.sequence(F.lit(2), F.size(bounds)), lambda i: F.substring(raw, F.element_at(bounds, i - 1)["end"] + 1, F.element_at(bounds, i)["start"] - F.element_at(bounds, i - 1)["end"]))
    rest = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).cast("string")
    return found.withColumn("text", F.when(F.col(f"{hits}.n_hit") > 0, rest).otherwise(F.col("text"))).drop(hits).toDF(*docs.columns)
