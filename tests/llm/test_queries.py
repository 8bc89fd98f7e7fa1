"""Every query of the subpackage over hard cases, and against brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusweave.llm import queries as Q

WORD = r"[^\x20\x09-\x0D]+"
NAMES = sorted(Q.queries())


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def by_id(spark, name, folder):
    return {r["doc_id"]: r for r in Q.queries()[name](spark, folder).collect()}


@pytest.mark.parametrize("name", NAMES)
def test_hard_cases(spark, odd_dir, name):
    found = Q.queries()[name](spark, odd_dir)
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == sorted(str(i) for i, _ in documents(spark, odd_dir))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert Q.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, plain_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{plain_dir}/{t}.parquet/*.parquet')")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, plain_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("most_sources", [62_500, 2])
def test_mixing(spark, plain_dir, most_sources, monkeypatch):
    from corpusweave.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SOURCES", most_sources)
    monkeypatch.setattr(mixing, "BUCKET_SOURCES", 2)
    first, again = (by_id(spark, "op1_mixing", plain_dir) for _ in range(2))
    assert {k: r["taken"] for k, r in first.items()} == {k: r["taken"] for k, r in again.items()}
    sums, largest = collections.Counter(), collections.Counter()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{plain_dir}/documents.parquet").collect()}
    words = collections.Counter()
    for i, t in documents(spark, plain_dir):
        words[sources[i]] += len(re.findall(WORD, t or ""))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1), strict=True))
    aims, capped = {}, set()
    while True:
        left = 1.5 * words.total() - sum(2 * words[s] for s in capped)
        free = [s for s in order if s not in capped]
        aims = {s: 2.0 * words[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        if not (over := {s for s in free if aims[s] > 2 * words[s]}):
            break
        capped |= over
    assert all(first[i]["source_size"] == words[s] and first[i]["target"] == pytest.approx(aims[s]) for i, s in sources.items())
    for i, t in documents(spark, plain_dir):
        assert first[i]["size"] == len(re.findall(WORD, t or ""))
        assert first[i]["taken"] in (0, first[i]["size"], 2 * first[i]["size"])
        key = first[i]["target"], first[i]["source_size"]
        sums[key] += first[i]["taken"]
        largest[key] = max(largest[key], first[i]["size"])
    for (target, size), taken in sums.items():
        assert 0 <= target - taken < max(largest[target, size], 1)


def test_mixed_rows_are_the_planned_draws(spark, plain_dir):
    """Each copy is of a whole row, shards hold it once, columns may clash in case."""
    from corpusweave.llm.mixing import mix

    docs = spark.read.parquet(f"{plain_dir}/documents.parquet").select("doc_id", "text", "source", "copy", F.lit("x").alias("TEXT"))
    out = mix(docs, n_shards=3)
    assert out.columns == ["doc_id", "text", "source", "copy", "TEXT", "copy_", "shard"]
    rows, plan = out.collect(), by_id(spark, "op1_mixing", plain_dir)
    assert collections.Counter(r[0] for r in rows if plan[r[0]]["size"]) == {i: r["taken"] // r["size"] for i, r in plan.items() if r["taken"]}
    assert len({(r[0], r[5]) for r in rows}) == len(rows) and {r[6] for r in rows} == {0, 1, 2}


def test_mixing_of_many_sources(spark, monkeypatch):
    """Tables of sources give the targets that the driver's plan gives, whole turns, and even shards."""
    from corpusweave.llm import mixing

    rows = [(i, f"s{i % 307}" if i % 307 else None, " ".join(["w"] * (i * i % (41 if i % 3 else 11)))) for i in range(3000)]
    sizes = mixing.sized(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    near = mixing.make_plan(sizes, n_shards=3)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 100)
    monkeypatch.setattr(mixing, "BUCKET_SOURCES", 40)
    far, again = (mixing.make_plan(sizes, n_shards=3) for _ in range(2))
    got = {r[0]: r[1:] for r in far.source_table(spark).collect()}
    assert sorted(got, key=str) == sorted((s for s, *_ in near.sources), key=str)
    assert all(got[s][0] == n and got[s][1] == pytest.approx(aim) for s, n, aim in near.sources)
    cells = {(r[0], r[1]): sorted((d["copy"], d["shard"]) for d in r[2]) for r in far.cells.collect()}
    assert cells == {(r[0], r[1]): sorted((d["copy"], d["shard"]) for d in r[2]) for r in again.cells.collect()}
    taken, shards, largest = collections.Counter(), collections.Counter(), collections.Counter()
    words = {(r["source"], r["cell"]): r["n"] for r in sizes.groupBy("source", mixing.cell_of(far.n_cells, far.seed).alias("cell")).agg(F.sum("size").alias("n")).collect()}
    assert words.keys() == cells.keys()
    for key, draws in cells.items():
        assert [c for c, _ in draws] == list(range(len(draws))) and len(draws) <= 2
        taken[key[0]] += len(draws) * words[key]
        largest[key[0]] = max(largest[key[0]], words[key])
        shards.update(s for _, s in draws)
    assert all(0 <= got[s][1] - taken[s] + 1e-6 and got[s][1] - taken[s] < max(largest[s], 1) for s in got)
    assert max(shards.values()) - min(shards.values()) <= 2


def test_mixing_targets():
    from corpusweave.llm.mixing import split_quotas, targets

    assert targets([100, 100, 100]) == [200.0, 200 / 3 * 2.5, 250 / 3] or sum(targets([100, 100, 100])) == pytest.approx(450)
    assert targets([10, 1000]) == [20.0, 1495.0]
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]
    shares = split_quotas(np.array([17, 0, 1000, 3]), 7, np.random.default_rng(1))
    assert shares.shape == (7, 4) and shares.sum(0).tolist() == [17, 0, 1000, 3] and shares.min() >= 0


def test_suffixes(spark, plain_dir):
    got, seen = by_id(spark, "op2_suffixes", plain_dir), set()
    for i, t in sorted(documents(spark, plain_dir)):
        data = (t or "").encode()
        keep = bytearray(b"\1" * len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                keep[p : p + 100] = bytes(100)
            seen.add(data[p : p + 100])
        kept = bytes(c for c, k in zip(data, keep, strict=True) if k)
        spans = len(re.findall(b"\0+", bytes(keep)))
        assert tuple(got[i])[1:] == (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_sharding(spark, odd_dir):
    rows = Q.queries()["op3_sharding"](spark, odd_dir).collect()
    again = Q.queries()["op3_sharding"](spark, odd_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    counts = collections.Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    want = sorted(zlib.crc32((t or "").encode()) for _, t in documents(spark, odd_dir))
    assert sorted(r["text_crc32"] for r in rows) == want


def test_sharding_of_odd_tables(spark):
    """A third of all rows under one id, texts of one kind under null ids, columns without an order or that clash in case."""
    from corpusweave.llm.sharding import shard

    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "same text" if i % 3 == 1 else f"text {i}", "c", {"k": i}, i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, tags map<string,int>, place int")
    for bucket_bytes in (1 << 20, 2000):
        found = shard(docs, 7, bucket_bytes=bucket_bytes)
        assert found.columns == [*docs.columns, "shard", "slot"]
        got = found.collect()
        assert sorted(r[4] for r in got) == list(range(900))
        assert sorted((r[6], r[5]) for r in got) == [(g // 7, g % 7) for g in range(900)]
        assert [r[4] for r in sorted(got, key=lambda r: (r[6], r[5]))] != sorted(range(900))
    assert shard(docs.limit(0)).count() == 0


def test_toxicity(spark, tmp_path):
    from tests.llm.conftest import prose, write
    import random

    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(rng, 30).split()
        if bad:
            words.insert(rng.randrange(30), rng.choice(("grubwurz", "grubwurzen", "vilesnark")))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    folder = write(spark, tmp_path / "t", docs, labels)
    rows = Q.queries()["op5_toxicity"](spark, folder).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in labels]
    others = [(i, t, "xx", "other") for i, t, *_ in docs]
    again = Q.queries()["op5_toxicity"](spark, write(spark, tmp_path / "f", others, flipped)).collect()
    before = {r["doc_id"]: r["score"] for r in rows}
    assert all(r["score"] == pytest.approx(before[r["doc_id"]], abs=1e-6) for r in again)


def test_toxicity_scores_are_pooled_convolutions():
    import pyarrow as pa

    from corpusweave.llm.textblocks import blocks
    from corpusweave.llm.toxicity import FILTERS, WIDTHS, _constant, features

    rng, model = np.random.default_rng(7), _constant(0.3)
    model.table = rng.standard_normal(model.table.shape, np.float32)
    model.filters = [rng.standard_normal(f.shape, np.float32) for f in model.filters]
    model.bias, model.out = rng.standard_normal(model.bias.shape, np.float32), rng.standard_normal(model.out.shape, np.float32)
    for texts in (["one", "", None, "two words", "a b c d e a b"], [""], ["x"], [None, "a b"]):
        block = next(blocks(pa.array(texts, pa.string())))
        rows, bounds = features(block)
        for i, got in enumerate(model.scores(block)):
            x, top = model.table[rows[bounds[i] : bounds[i + 1]]].sum(1), []
            for k, w in enumerate(WIDTHS):
                values = [[sum(float(x[t + j] @ model.filters[k][j][:, c]) for j in range(w)) + float(model.bias[k, c]) for c in range(FILTERS)] for t in range(len(x) - w + 1)]
                top += [max([0.0, *(v[c] for v in values)]) for c in range(FILTERS)]
            assert got == pytest.approx(1 / (1 + np.exp(-(np.array(top) @ model.out + model.out_bias))), abs=1e-5)


def shingle_print(text):
    words = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [2000, 1])
def test_simhash(spark, plain_dir, crowd, monkeypatch):
    from corpusweave.llm import simhash

    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.MOST_BITS, crowd))
    got, docs = by_id(spark, "op6_simhash", plain_dir), sorted(documents(spark, plain_dir))
    prints = {i: shingle_print(t) for i, t in docs}
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    for i in prints:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (format(prints[i], "016x"), top(i))


def test_simhash_pivots_lose_no_link():
    from corpusweave.llm.simhash import bucket_links, pivots

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 30, np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(7 << 40)]))
    found, root = bucket_links(prints, pivots()), list(range(len(prints)))
    group = lambda pairs: _groups(len(prints), pairs)
    every = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 2]
    assert group(found) == group(every) and len(root) == len(prints)


def _groups(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_by_similarity(spark):
    from corpusweave.llm import simhash
    import random

    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    changed = words.copy()
    changed[150] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{rng.randrange(5000)}" for _ in range(300))), (4, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.keep_first(docs).collect()) == ["1", "3", "4", "None"]


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids, repeated rows, columns that differ in case alone, columns without an order."""
    from corpusweave.llm import simhash

    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, "x", {"k": 1}), (1, one, "y", {}), (1, two, "z", None), (2, two, "z", None), (None, one, "n", {}), (None, "c d", "n", {}), (None, "c d", "n", {}), (None, None, "n", {}), (7, "", "e", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, tags map<string,int>")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r[0]), r[1]) for r in kept.collect()) == [("1", one), ("1", two), ("7", ""), ("None", "c d")]


def test_large_groups_of_near_copies_leave_one(spark):
    """6,000 texts of 300 words with three words changed each, among unlike texts."""
    from corpusweave.llm import simhash
    import random

    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(100)]
    for i in range(100, 6100):
        near = words.copy()
        for k in rng.sample(range(300), 3):
            near[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == list(range(101))


def jaccard_groups(sets, least):
    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least]
    return _groups(len(sets), every), every


def test_crowded_seeds_lose_no_link(spark):
    from corpusweave.llm import simhash

    rng = np.random.default_rng(4)
    sets = [set(range(100 * g, 100 * g + 20)) - set(rng.choice(20, k, replace=False) + 100 * g) for g in range(6) for k in rng.integers(0, 8, 12)]
    prints = [int(x) for x in rng.integers(0, 2, len(sets))]
    rows = spark.createDataFrame([(i, prints[i], len(sets[i]), 0, 7) for i in range(len(sets))], "f long, p long, size int, band int, value long")
    made = spark.createDataFrame([(i, sorted(map(int, x))) for i, x in enumerate(sets)], "f long, shingles array<long>")
    want, every = jaccard_groups(sets, 0.8)
    for crowd in (300, 10**6):
        got = [(r["a"], r["b"]) for r in simhash.similar_links(rows, made, 0.8, crowd).collect()]
        assert every and set(map(lambda p: tuple(sorted(p, reverse=True)), got)) <= set(every) and _groups(len(sets), got) == want


def test_near_duplicates_are_exactly_those_of_the_shingle_sets(spark):
    """Pairs on both sides of 0.8, which fingerprints can't tell apart."""
    from corpusweave.llm import simhash
    import random

    rng, rows = random.Random(3), []
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        for changed in (0, 4, 5, 8, 12):
            near = words.copy()
            for k in range(changed):
                near[8 + 15 * k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = jaccard_groups(sets, 0.8)[0]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8)
    assert [c for _, c in sorted((r["doc_id"], r["component_id"]) for r in found.collect())] == want


def test_similar_texts_without_a_least_shingle_in_common_leave_one(spark):
    """Pairs of similarity 45/55 of which least-hash seeds in eight orders find none; fingerprints find them."""
    from corpusweave.llm import simhash
    import random

    rows = []
    for seed in (22258, 37102, 38849, 44678):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(54)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:20], "x", *words[21:]]))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]


def test_table_groups_are_those_of_the_links():
    from corpusweave.llm.simhash import table_groups

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (12, 4), np.uint64)
    prints = np.concatenate([base[rng.integers(0, 12, 300)]] * 2)
    prints[:, 1] ^= rng.integers(0, 1 << 30, 600, np.uint64)
    key = rng.integers(0, 7, 600)
    got = table_groups(key, prints, rng.integers(0, 1 << 64, (4, 4), np.uint64), 12).tolist()
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    every = [(i, j) for i in range(600) for j in range(i) if key[i] == key[j] and bits[i, j] <= 12]
    want = list(range(600))
    while (new := [min([want[i], *(want[j] for j in np.flatnonzero((key == key[i]) & (bits[i] <= 12)))]) for i in range(600)]) != want:
        want = new
    assert every and len(set(want)) < 500
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    assert len(table_groups(key[:0], prints[:0], prints[:4], 12)) == 0


def test_fingerprint_tables_find_pairs_at_the_bound(spark):
    """Pairs of similarity 0.8 of any size share a group of candidates; unlike sets are in none."""
    from corpusweave.llm import simhash

    rng, rows, pairs = np.random.default_rng(9), [], []
    for both, one, two in [(4, 0, 1), (8, 1, 1), (12, 0, 3), (40, 5, 5), (200, 0, 50), (200, 25, 25)] * 50:
        hashes = rng.integers(0, 1 << 64, both + one + two, np.uint64)
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + k, len(x), simhash.wide_print(x)) for k, x in enumerate((hashes[: both + one], np.concatenate([hashes[:both], hashes[both + one :]])))]
    rows += [(len(rows) + k, 50, simhash.wide_print(rng.integers(0, 1 << 64, 50, np.uint64))) for k in range(200)]
    distinct = spark.createDataFrame(rows, "f long, size int, bits array<long>").selectExpr("*", "bits[0] AS p")
    got = {r["f"]: r["value"] for r in simhash.candidates(distinct, len(rows), 0.8).collect()}
    assert sum(a in got and got[a] == got.get(b) for a, b in pairs) == len(pairs) and len(got) == 2 * len(pairs) == 2 * len(set(got.values()))


def test_tables_name_members_of_large_groups_a_few_times(spark, monkeypatch):
    """2,000 near copies, pairs and chains: links in proportion to the members, not once for each table, and the groups of all tables at once."""
    from corpusweave.llm import simhash

    rng, counts, real = np.random.default_rng(4), [], simhash.components
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.concatenate([np.delete(base, rng.choice(300, 15, replace=False)), rng.integers(0, 1 << 64, 15, np.uint64)]) for _ in range(2000)]
    chain = rng.integers(0, 1 << 64, 400, np.uint64)
    sets += [chain[k : k + 100] for k in range(0, 300, 10)]
    sets += [x for one in rng.integers(0, 1 << 64, (50, 55), np.uint64) for x in (one[:50], one[5:])]
    sets += list(rng.integers(0, 1 << 64, (100, 50), np.uint64))
    rows = [(k, len(x), simhash.wide_print(x)) for k, x in enumerate(sets)]
    distinct = spark.createDataFrame(rows, "f long, size int, bits array<long>").selectExpr("*", "bits[0] AS p").repartition(4).cache()

    def counted(edges):
        counts.append(edges.distinct().count())
        return real(edges)

    monkeypatch.setattr(simhash, "components", counted)
    groups = lambda: {r["f"]: r["value"] for r in simhash.candidates(distinct, len(rows), 0.8).collect()}
    got = groups()
    assert {got[k] for k in range(2000)} == {0} and len(got) == 2000 + 30 + 100
    assert sum(counts) <= 6 * len(got)
    monkeypatch.setattr(simhash, "FIRST_TABLES", 0, raising=False)
    assert groups() == got


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def spans(text):
    found = [(m.start(), k, n, m.end()) for k, (n, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def test_pii(spark, tmp_path):
    from tests.llm.conftest import write

    cases = [
        None, "", "mail é@b.co a@b.co\x01\x02 4111111111111111", "a@b.c_d@e.f x@y @ z@q..com a.b@c.d.e.", "1.2.3.4.5 256.1.1.1 001.002.003.0255 99999999999999.1.1.1 1.2.3",
        "4111 1111 1111 1111-4111111111111111 4111-1111-1111-1111 0", "+1 (017) 555-7713 +12 +1----2 ++33 1 22 33 44 55", "GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, order 123-45-6780",
        "9" * 20_000 + "@", "a" * 20_000 + "@", "1 " * 20_000, "x@y.z," * 500, "𝄞 +49 30 1234567 ip 10.0.0.1",
    ]
    folder = write(spark, tmp_path / "p", [(i, t, "en", "s") for i, t in enumerate(cases)])
    got = by_id(spark, "op7_pii", folder)
    for i, t in enumerate(cases):
        assert got[i]["base_sha256"] == hashlib.sha256(spans(t).encode()).hexdigest()
        assert [got[i][f"n_{n}"] for n, *_ in KINDS] == [spans(t).count(f"{n}:") for n, *_ in KINDS]
        assert set(filter(None, spans(t).split(","))) <= set(got[i]["spans"].split(","))
    assert got[7]["spans"] == "iban:0:27,ssn:33:44"


def test_pii_secrets(spark):
    from corpusweave.llm.pii import detect

    value = "aB3" * 8
    cases = {
        "id AKIA" + "Z9" * 8 + " end": ["key:3:23"],
        "example: AKIA" + "Z9" * 8: [],
        "AKIA" + "ZZ" * 8: [],
        "AKIA" + "Z9" * 9: [],
        "-----BEGIN RSA PRIVATE KEY-----": ["key:0:31"],
        f"secret = {value}": ["token:9:33"],
        f"a name, {value}": [],
        f"sha of the key {value}": [],
        "token " + "0af1" * 8: ["token:6:38"],
        "token " + "a" * 40: [],
        "password " + "x" * 30_000: [],
        "key " + "a1B" * 10_000: ["token:4:30004"],
        f"\U0001d11e é bearer {value}==.": ["token:11:37"],
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None, ""]], "text string")
    found = {r["text"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"]] for r in detect(rows).collect()}
    assert found == cases | {None: [], "": []}


def test_pii_redacts(spark):
    from corpusweave.llm.pii import redact

    rows = spark.createDataFrame([("write to a@b.co now",), (None,), ("",)], "text string")
    assert [r["text"] for r in redact(rows).collect()] == ["write to [email] now", None, ""]


def test_decontamination_cuts_spans(spark):
    from corpusweave.llm.decontamination import decontaminate

    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"Before {item.title()}, after é."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r["text"] for r in decontaminate(docs, bench, "spans").orderBy("doc_id").collect()] == ["Before , after é.", "clean", None]
    assert [r["doc_id"] for r in decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_decontamination_drops_long_documents_with_a_whole_item(spark):
    from corpusweave.llm.decontamination import decontaminate

    item = " ".join(f"item{i}" for i in range(40))
    filler = " ".join(f"w{i}" for i in range(2000))
    rows = [(1, f"{filler} {item} {filler}", None), (2, f"{filler} {' '.join(item.split()[:12])}", "short of a window"), (3, f"{filler} word", "a short item"), (4, "word", None), (5, None, None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    bench = spark.createDataFrame([(7, item), (8, "word"), (9, None)], "item_id long, text string")
    assert sorted(r[0] for r in decontaminate(docs, bench).collect()) == [2, 3, 5, 6]


def test_decontamination_in_blocks(spark, plain_dir):
    from corpusweave.llm import decontamination

    docs, bench = (spark.read.parquet(f"{plain_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parts = (decontamination.scan(docs.select("doc_id", "text"), bench, most=m).select("doc_id", "hits").collect() for m in (10**6, 20))
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and any(r["hits"]["n_hit"] for r in whole)


def test_quality(spark, odd_dir):
    rows = Q.queries()["op9_quality"](spark, odd_dir).collect()
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows}
    for i, t in documents(spark, odd_dir):
        words = re.findall(WORD, t or "")
        counts, inside = collections.Counter(zip(words, words[1:], words[2:])), [0] * len(words)
        for k in range(len(words) - 2):
            if counts[tuple(words[k : k + 3])] > 1:
                inside[k : k + 3] = [1] * 3
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        failed = len(words) < 50 or 100 * sum(inside) > 50 * len(words)
        assert (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(inside), failed) in got
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_bands():
    import random

    import zstandard

    from corpusweave.llm.quality import LEVEL, measure
    from corpusweave.llm.textblocks import Block
    from tests.llm.conftest import prose

    rng = random.Random(1)
    cases = {"keep": prose(rng, 900).encode(), "repetitive": b"again and " * 500, "incompressible": bytes(rng.randrange(33, 255) for _ in range(6000))}
    for want, data in cases.items():
        block = Block(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert measure(block, zstandard.ZstdCompressor(level=LEVEL))[0]["verdict"] == want


def test_language(spark, tmp_path):
    from tests.llm.conftest import write
    import random

    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "sh", "er"], "bb": ["ung", "ich", "sch", "keit"], "ru": ["пра", "ска", "ние"]}
    say = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(n))
    docs = [(i, say(lang := ("aa", "bb", "ru")[i % 3], 25), lang, "s") for i in range(300)]
    docs += [(300, None, "aa", "s"), (301, "123 !!", "aa", "s"), (302, "", None, "s"), (306, say("aa", 8) + " " + say("bb", 30), None, "s")]
    got = by_id(spark, "op10_language", write(spark, tmp_path / "l", docs))
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in docs[:300])
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 306)] == ["und", "und", "und", "bb"]
    assert 0.7 < got[306]["score"] < 0.9
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other") for i, t, lang, _ in docs]
    again = by_id(spark, "op10_language", write(spark, tmp_path / "h", changed))
    assert again == got


def test_language_path_is_the_best():
    import itertools

    from corpusweave.llm.language import settled, viterbi

    rng = np.random.default_rng(0)
    for _ in range(60):
        e = -rng.integers(0, 6, (6, 3)).astype(float)
        cost = lambda p: sum(e[t, k] for t, k in enumerate(p)) - 4.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(map(cost, itertools.product(range(3), repeat=6)))
        assert cost(viterbi(e, 4.0)) == pytest.approx(best)
        top, sure = settled(e, np.array([0, 6]), 4.0)
        assert not sure[0] or cost([top[0]] * 6) == pytest.approx(best)


@pytest.mark.parametrize("name", ["op2_suffixes", "op4_substrings"])
@pytest.mark.parametrize("held", [500, 100_000])
def test_sliced_sketch_gives_the_same_rows(spark, plain_dir, monkeypatch, name, held):
    """With a sketch too large to broadcast: dealt over 16 slices, in small and large chunks."""
    from corpusweave.llm import substrings, suffixes

    want = sorted(map(tuple, Q.queries()[name](spark, plain_dir).collect()))
    for key, value in (("MOST_BITS", 19), ("HOME_BITS", 16), ("HELD", held)):
        monkeypatch.setattr(substrings, key, value)
    monkeypatch.setattr(suffixes, "HELD", held)
    assert sorted(map(tuple, Q.queries()[name](spark, plain_dir).collect())) == want


def test_suspects_hold_every_repeated_value(spark, monkeypatch):
    """A value in two texts, in one chunk or in several, comes back to both; few others do; a common one brings no row a text."""
    from corpusweave.llm import substrings

    rng = np.random.default_rng(3)
    common, shared = "c " * 60, [" ".join(f"s{i}x{j}" for j in range(60)) for i in range(20)]
    texts = [common + " ".join(f"u{i}x{j}" for j in range(60)) + " " + shared[int(rng.integers(20))] for i in range(100)]
    rows = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)], "doc long, row int, text string").repartition(4)
    monkeypatch.setattr(substrings, "HOME_BITS", 16)
    monkeypatch.setattr(substrings, "HELD", 300)
    found = {r["doc"]: set(r["maybe"]) for r in substrings.suspects(rows, 20, substrings.text_marks()).collect()}
    marks, seen = substrings.text_values(), collections.Counter()
    own = {}
    for i, t in enumerate(texts):
        own[i] = set(marks(next(iter(substrings.blocks(substrings.pa.array([t]))))).view(np.int64).tolist())
        seen.update(own[i])
    for i, values in own.items():
        repeated = {v for v in values if seen[v] > 1}
        assert repeated <= found[i] <= values
    assert sum(len(found[i]) for i in own) <= 1.02 * sum(seen[v] for v in seen if seen[v] > 1)
