"""The numeric kernels against plain code."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.llm import substrings, suffixes
from corpusweave.llm.textblocks import Block, blocks, rolling, whole_windows


def run_of(keys: list[bytes]) -> suffixes.FrontCoded:
    table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, suffixes.KEY)
    shared = suffixes.shared_prefixes(table)
    rest = table[np.arange(suffixes.KEY) >= shared[:, None]] if len(table) else np.zeros(0, np.uint8)
    return suffixes.FrontCoded(shared.astype(np.uint8).tobytes(), rest.tobytes())


KEYS = st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3).map(lambda x: bytes(x[:1]) * 60 + bytes(x[1:2]) * 60 + bytes(x[2:]) * (suffixes.KEY - 120)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(KEYS.map(sorted), min_size=1, max_size=7))
def test_merge_is_the_sorted_order(parts):
    runs, merged, shares = [run_of(p) for p in parts], [], []
    for run, shared in suffixes.merge_runs(runs):
        merged.append(runs[run].key)
        shares.append(shared)
    assert merged == sorted(k for p in parts for k in p)
    for i in range(1, len(merged)):
        same = next((n for n, (a, b) in enumerate(zip(merged[i - 1], merged[i], strict=True)) if a != b), suffixes.KEY)
        assert shares[i] == same


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 9))
def test_sliding(values, width):
    v = np.array(values, np.uint64)
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert substrings.sliding_min(v, width).tolist() == want
    assert suffixes.sliding_max(v, width).tolist() == [max(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=20), max_size=8), st.integers(1, 40))
def test_words_and_hashes(texts, most):
    seen = {}
    for block in blocks(pa.array(texts, pa.string()), most):
        starts, ends, bounds = block.words()
        hashes = block.span_hashes(starts, ends) if len(starts) else []
        for i in range(block.last - block.first):
            words = [block.data[s:e].tobytes() for s, e in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
            assert words == texts[block.first + i].encode().split()
            for w, h in zip(words, hashes[bounds[i] : bounds[i + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(map(int, seen.values()))) == len(seen)


def test_every_string_has_the_same_anchor_wherever_it_stands():
    rng = np.random.default_rng(1)
    for _ in range(30):
        core = rng.integers(97, 100, 130).astype(np.uint8)
        sides = [rng.integers(97, 100, n).astype(np.uint8) for n in (40, 7, 90, 33)]
        data = np.concatenate([sides[0], core, sides[1], sides[2], core, sides[3]])
        cut = 40 + 130 + 7
        at, _ = suffixes.anchors(Block(0, 2, data, np.array([0, cut, len(data)])))
        for p in range(len(core) - suffixes.LENGTH + 1):
            one, two = (set((at[(at >= q) & (at <= q + suffixes.LENGTH - suffixes.GRAM)] - q).tolist()) for q in (40 + p, cut + 90 + p))
            assert one & two


def test_rolling_stays_in_its_text():
    assert whole_windows(np.array([0, 3, 3, 5]), 2, 5).tolist() == [True, True, False, True]
    v = np.arange(6, dtype=np.uint64)
    assert rolling(np.concatenate([v, v]), 3)[:4].tolist() == rolling(v, 3).tolist()
    assert len(rolling(v, 7)) == 0


def test_sketch_never_undercounts(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i % 7) * 1000 + j}" for j in range(120))) for i in range(20)], "doc_id long, text string")
    bits = substrings.LEAST_BITS
    table = substrings.sketch(rows.select("doc_id", "text"), bits, substrings.text_values(), "text")
    texts = [r["text"] for r in rows.collect()]
    values = substrings.text_values()(next(iter(blocks(pa.array([texts[0]])))))
    assert substrings.maybe_repeated(values, table, bits).all()
    alone = substrings.text_values()(next(iter(blocks(pa.array([texts[6]])))))
    assert substrings.maybe_repeated(alone, table, bits).all()
