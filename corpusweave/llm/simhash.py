"""SimHash near-duplicates with pivot distance tables.

Fingerprints: A-Z lowered, words, three-word shingles with repeats, XXH64 (seed 42) of each; a bit
is 1 when over half of the hashes have it. Texts of fewer words use their whole sequence; without
words the fingerprint is zero.

Linking works on distinct fingerprints, so any number of copies is one row. Fingerprints within
``most`` bits agree exactly in all but ``most`` of any equal parts of the 64 bits; each choice of
parts is a table and its values are buckets, with parts enough for about one chance meeting a
bucket at the table's size. Every row carries its pivot table: the Hamming distances to ``PIVOTS``
seeded reference fingerprints. In a bucket, sorted by the first distance, only neighbours within
``most`` of it are compared, pairs that differ by more than ``most`` in any coordinate are
discarded (distances to a reference differ no more than the two differ), and survivors are
verified bit by bit. A bucket gives a spanning set of its links, never all pairs.

A bucket of over ``CROWD`` distinct fingerprints isn't compared pair by pair: its members list
themselves and their one-bit neighbours, and two within two bits share such a value; at most 65
members share one, so no group is large (for ``most`` above 2 a crowd is dealt to blocks and every
two blocks meet). Components come from the links by star rounds with checkpoints. No fingerprints
or links go to the driver, but for the hot keys of a join, fewer than a thousand.

``near_duplicates(similarity=...)`` links texts whose sets of shingle hashes have that Jaccard
similarity. Distinct sets are the nodes. Their fingerprints are ``WORDS`` times as wide: the SimHash
of the set's hashes, then of these hashes hashed anew. Each seeded choice of bits is a table and its
values are buckets, with as many tables as lose at most ``LOST`` of the pairs at the similarity by
SimHash's law (the angle of two sets; small sets differ in more bits and get more tables). Rows carry
their pivot table as above, a bucket's members are compared within a window of the first distance,
by the other distances and by all bits; links are within five standard deviations of the expected
distance, and each bucket ties what its links connect to the least hash there. What the first
``FIRST_TABLES`` connect is one node in the other tables, which only tie nodes: so a member of a large
group is named a few times, not once for each table. What all tables connect is a group of candidates;
sets too small to have a neighbour at the similarity are in none. A group's members are first
compared with its least one. Groups that then lie in one component are done; in the others the
members outside the least one's component are compared with all. A group of over ``CROWD_SHINGLES``
is dealt to blocks of half of that and these meet pairwise. Within a block, pairs go through the
pivot tables and the fingerprints (of the sets) at ``RADIUS`` bits, which pairs of similarity 0.8
exceed with probability below 0.0001; what is left is verified on both whole sets, and only that
decides.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and ties
share fingerprint and component; an empty table gives an empty result; rows without ``doc_id``
have a fingerprint but never are a component's smallest id (a component of such rows alone has
none); other columns are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.components import components
from corpusweave.llm.frames import apart, cut, join_salted
from corpusweave.llm.textblocks import blocks, lean, mix

MOST_BITS = 2
SHINGLE = 3
PIVOTS = 16
CROWD = 2000
CROWD_SHINGLES = 1_000_000
RADIUS = 26
SEED = 42
WORDS = 4
TABLE_PIVOTS = 4
TABLE_BITS = 10
FIRST_TABLES = 4
LOST = 0.0003
PARITY = 1.065
SMALL, SMALL_PARITY = 6, 1.24
BROADCAST_TEXTS = 500_000
_SLICE = 1 << 15


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of one text, in order; empty without words."""
    import xxhash

    words = text.lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)] * bool(words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def vote(hashes: np.ndarray) -> int:
    """The unsigned SimHash of shingle hashes; 0 of none."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _SLICE):
        votes += np.unpackbits(hashes[lo : lo + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    return vote(shingle_hashes(text, width))


def wide_print(hashes: np.ndarray) -> list[int]:
    """The SimHash of shingle hashes and of these hashed anew, ``WORDS`` signed longs."""
    anew = lambda k: mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) if k else hashes
    return [_signed(vote(anew(k))) for k in range(WORDS)]


def set_hash(shingles: np.ndarray) -> int:
    """The signed hash of a set of shingle hashes, given sorted."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text`` and with ``f``, the fingerprint as a signed long."""
    out = docs.select(*(c for c in docs.columns if c != text), F.lit(0).cast("long").alias("f"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(block.text(i), width) for block in blocks(batch.column(batch.num_columns - 1)) for i in range(block.last - block.first)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.array(prints, np.uint64).view(np.int64))], schema=pa.schema(list(batch.schema)[:-1]))

    return out.mapInArrow(lean(run), out.drop(text).schema)


def sketched(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with its shingle set's hash ``f``, ``size`` and fingerprint ``bits``."""
    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, F.lit(0).cast("long").alias("f"), F.lit(0).alias("size"), F.array().cast("array<long>").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for block in blocks(batch.column(batch.num_columns - 1)):
                for i in range(block.last - block.first):
                    shingles = np.unique(shingle_hashes(block.text(i), width))
                    made.append((set_hash(shingles), len(shingles), wide_print(shingles)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[k] for x in made], t) for k, t in enumerate(kinds))], [*rest, "f", "size", "bits"])

    return docs.select(*rest, text).mapInArrow(lean(run), out.schema)


def pivots(n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


def pivot_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint (rows) to every reference (columns)."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def bucket_links(prints: np.ndarray, references: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct fingerprints of one bucket, as pairs of positions."""
    n, table = len(prints), pivot_table(prints, references)
    order = np.argsort(table[:, 0], kind="stable")
    first, root, out = table[order, 0], list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    step = max(1, min(512, 2_000_000 // n))
    for lo in range(0, n, step):
        rows = order[lo : lo + step]
        upto = int(np.searchsorted(first, first[min(lo + step, n) - 1] + most, "right"))
        others = order[lo:upto]
        close = np.abs(table[rows, 0][:, None] - table[others, 0][None, :]) <= most
        i, j = np.nonzero(close & (np.arange(len(rows))[:, None] < np.arange(len(others))[None, :]))
        i, j = rows[i], others[j]
        for k in range(1, table.shape[1]):
            keep = np.abs(table[i, k] - table[j, k]) <= most
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(prints[i] ^ prints[j]) <= most
        for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                root[y] = x
                out.append((a, b))
    return out


def parts_for(n: int, most: int = MOST_BITS) -> int:
    """Parts of 64 bits such that a bucket of a table of ``n`` holds about one fingerprint by chance."""
    parts = most + 1
    while 64 * (parts - most) // parts < math.log2(max(2, n)) + 1 and parts < most + 6:
        parts += 1
    return parts


def band_masks(parts: int, most: int = MOST_BITS) -> list[int]:
    """The bits of every choice of ``parts - most`` parts."""
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(masks, parts - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, n: int, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect what is within ``most`` bits, from distinct fingerprints ``f``."""
    masks = band_masks(parts_for(n, most), most)
    rows = distinct.select("f", F.posexplode(F.array(*(F.col("f").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("band", "value"))
    met = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = cut(rows.join(met, ["band", "value"]))
    plain = bucketed_links(rows.filter(F.col("n") <= crowd), most)
    crowded = rows.filter(F.col("n") > crowd).select("f").distinct()
    if crowded.limit(1).count():
        if most > 2:
            return plain.unionAll(bucketed_links(in_blocks(rows.filter(F.col("n") > crowd), crowd), most))
        flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(64)))
        near = crowded.select("f", F.explode(F.transform(flips, lambda x: F.col("f").bitwiseXOR(x))).alias("near"))
        groups = near.groupBy("near").agg(F.collect_list("f").alias("fs"))
        plain = plain.unionAll(groups.filter(F.size("fs") > 1).select(F.array_min("fs").alias("a"), F.explode("fs").alias("b")).filter("a != b"))
    return plain


def bits_for(n: int) -> int:
    """Bits of a table of ``n`` sets: buckets of up to some thousand, as comparing costs less than more tables."""
    return max(TABLE_BITS, math.ceil(math.log2(max(2, n))) - 12)


def differing(similarity: float) -> float:
    """The share of SimHash bits in which sets of that Jaccard similarity and like sizes differ, by the angle between them."""
    return max(1e-6, math.acos(2 * similarity / (1 + similarity)) / math.pi)


def tables_for(bits: int, share: float) -> int:
    """Tables such that a pair that differs in a ``share`` of the bits has no bucket in common with probability ``LOST`` at most."""
    n = 64 * WORDS
    apart = np.arange(n + 1)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(d + 1) - math.lgamma(n - d + 1) for d in range(n + 1)])
    chance = np.exp(ways + apart * math.log(share) + (n - apart) * math.log1p(-share))
    meet = np.prod([np.maximum(0, n - apart - i) / (n - i) for i in range(bits)], axis=0)
    tables = 8
    while (chance * (1 - meet) ** tables).sum() > LOST:
        tables += 8
    return tables


def radius_for(similarity: float) -> int:
    """Bits in which wide fingerprints of that similarity differ at most, by five standard deviations."""
    n, share = 64 * WORDS, PARITY * differing(similarity)
    return int(n * share + 5 * math.sqrt(n * share * (1 - share)))


def table_groups(key: np.ndarray, prints: np.ndarray, references: np.ndarray, most: int) -> np.ndarray:
    """For each wide fingerprint (row) the position of one that stands for all that links connect with it in its bucket (equal ``key``).

    Sorted by bucket and first pivot distance, all rows meet the next one, the second next and so on, while these are in the window.
    """
    n = len(key)
    table = np.bitwise_count(prints[:, None, :] ^ references[None]).sum(2, dtype=np.int16)
    order = np.lexsort((table[:, 0], key))
    key, first = key[order], table[order, 0]
    others = [np.ascontiguousarray(table[order, k]) for k in range(1, table.shape[1])]
    words = [np.ascontiguousarray(prints[order, k]) for k in range(prints.shape[1])]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    bucket = np.repeat(np.arange(len(edges)), np.diff([*edges, n]))
    root, rows, step = np.arange(n), np.arange(n), 0

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    while len(rows):
        step += 1
        rows = rows[: np.searchsorted(rows, n - step)]
        rows = rows[(key[rows + step] == key[rows]) & (first[rows + step] - first[rows] <= most)]
        i = rows[root[rows] != root[rows + step]]
        for near in others:
            i = i[np.abs(near[i] - near[i + step]) <= most]
        bits = np.zeros(len(i), np.int16)
        for word in words:
            bits += np.bitwise_count(word[i] ^ word[i + step])
        for a in i[bits <= most].tolist():
            root[top(a + step)] = top(a)
        if (bits <= most).any():
            while (root != root[root]).any():
                root = root[root]
        if step & (step - 1) == 0:
            whole = np.minimum.reduceat(root, edges) == np.maximum.reduceat(root, edges)
            rows = rows[~whole[bucket[rows]]]
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def fingerprint_links(distinct: DataFrame, n: int, similarity: float, start: int = 0, stop: int | None = None) -> DataFrame:
    """Links (a, b) that connect the candidates among ``n`` distinct sets (``f``, ``size``, ``bits``), from the tables ``start`` to ``stop``; sets of one ``node`` are known to be connected and go by it."""
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, most = bits_for(n), radius_for(similarity)
    plain, small = (tables_for(bits, share * differing(similarity)) for share in (PARITY, SMALL_PARITY))
    rng = np.random.default_rng(SEED)
    chosen = [rng.choice(64 * WORDS, bits, replace=False) for _ in range(small)]
    references = rng.integers(0, 1 << 64, (TABLE_PIVOTS, WORDS), np.uint64)
    powers = 1 << np.arange(bits)
    names = [f"w{k}" for k in range(WORDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = np.stack([batch.column(2 + k).to_numpy() for k in range(WORDS)], 1)
            spread = np.unpackbits(prints.view(np.uint8).reshape(len(node), -1), axis=1, bitorder="little")
            for table, at in list(enumerate(chosen))[start:stop]:
                if table == plain:
                    mine = size < SMALL
                    node, prints, spread = node[mine], prints[mine], spread[mine]
                if not len(node):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table << bits | spread[:, at] @ powers, node, *prints.T)], ["key", "node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, node, *words = (np.concatenate(x) for x in zip(*held, strict=True))
            group = table_groups(key, np.stack(words, 1).view(np.uint64), references, most)
            least = node.copy()
            np.minimum.at(least, group, node)
            more = node != least[group]
            pairs = np.unique(np.stack([node[more], least[group][more]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            new = [x.to_numpy() for x in batch.columns]
            if not len(new[0]):
                continue
            split = int(np.searchsorted(new[0], new[0][-1]))
            if split or (held and held[-1][0][-1] != new[0][-1]):
                held.append([x[:split] for x in new])
                yield flush()
                held.clear()
            held.append([x[split:] for x in new])
        if held:
            yield flush()
        held.clear()

    able = distinct.filter(F.col("size") / (F.col("size") + 1) >= similarity).select("node", "size", *(F.col("bits")[k].alias(w) for k, w in enumerate(names)))
    rows = able.mapInArrow(lean(deal), ", ".join(f"{c} long" for c in ("key", "node", *names)))
    return rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(lean(run), "a long, b long")


def candidates(distinct: DataFrame, n: int, similarity: float) -> DataFrame:
    """``band``, ``value``, ``f``, ``p`` and ``size`` of the sets in a group of candidates, which ``band`` and ``value`` name.

    The first tables connect most of a large group, whose members are one node in the others: there each would give it a link to another least member.
    """
    first = components(fingerprint_links(distinct.withColumn("node", F.col("f")), n, similarity, 0, FIRST_TABLES))
    nodes = distinct.join(first, F.col("f") == F.col("node"), "left").select("f", "size", "bits", F.coalesce("component", "f").alias("node"))
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(fingerprint_links(nodes, n, similarity, FIRST_TABLES))
    joined = components(links.mapInArrow(lambda batches: batches, "a long, b long"))
    grouped = cut(joined.unionAll(joined.select(F.col("component").alias("node"), "component").distinct()).mapInArrow(lambda batches: batches, "node long, component long"))
    met = distinct.join(grouped, F.col("f") == F.col("node"))
    return cut(met.select(F.lit(0).alias("band"), F.col("component").alias("value"), "f", "p", "size"))


def shingle_sets(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``f`` (the set's hash) and ``shingles`` (sorted) of every row of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                sets = [np.unique(shingle_hashes(block.text(i), width)) for i in range(block.last - block.first)]
                bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(map(set_hash, sets), pa.int64()), listed], ["f", "shingles"])

    return texts.select("text").mapInArrow(lean(run), "f long, shingles array<long>")


def similar_links(rows: DataFrame, sets: DataFrame, similarity: float, crowd: int = CROWD_SHINGLES) -> DataFrame:
    """Links (a, b) that connect what has the Jaccard ``similarity`` and shares a bucket.

    ``rows``: ``band`` and ``value`` of the bucket, ``f``, its fingerprint ``p`` and its set's ``size``; ``sets``: the ``shingles`` of each ``f``.
    """
    rows = rows.withColumn("bucket", F.xxhash64("band", "value"))
    met = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("f", "p")).alias("first")).filter("n > 1")
    rows = cut(join_salted(rows, met, "bucket", "f"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("first.p"))) <= RADIUS
    one, two = sets.select(F.col("f").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("f").alias("b"), F.col("shingles").alias("y"))
    pairs = cut(rows.filter((F.col("f") != F.col("first.f")) & near).select(F.col("first.f").alias("a"), F.col("f").alias("b")).distinct())
    both = F.size(F.array_intersect("x", "y"))
    stars = cut(join_salted(pairs, one, "a", "b").join(two, "b").filter(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b"))
    joined = components(stars)
    named = rows.filter("n > 2").join(joined, F.col("f") == F.col("node"), "left").select("bucket", "band", "value", "f", "p", "size", F.coalesce("component", "f").alias("component"))
    state = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "f").alias("main"))
    state = cut(state.filter("low != high").select("bucket", "main"))
    undone = cut(join_salted(named, state, "bucket", "f").withColumn("late", F.col("component") != F.col("main")).drop("main", "bucket"))
    more = compared(late_blocks(undone, crowd).join(sets, "f"), similarity)
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more).mapInArrow(lambda batches: batches, "a long, b long")  # new columns, as Spark can't carry the checkpoint's constraints through the unions of components


def late_blocks(rows: DataFrame, crowd: int = CROWD_SHINGLES) -> DataFrame:
    """Buckets of over ``crowd`` shingles dealt by ``f`` to blocks: each of ``late`` rows meets each of the others and each of late rows, under a value of its own."""
    weight = lambda late: F.ceil(2 * F.sum(F.when(F.col("late") == late, F.col("size") + 16).otherwise(0)) / F.lit(crowd)).cast("int")
    blocked = rows.groupBy("band", "value").agg(weight(False).alias("mains"), weight(True).alias("lates"))
    met = rows.join(blocked, ["band", "value"])
    deal = lambda most: F.pmod(F.xxhash64(F.lit(SEED), "f"), F.greatest(F.lit(1), most)).cast("int")
    each = lambda most, value: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), most) - 1), value)
    key = lambda kind, x, y: F.xxhash64("value", F.lit(kind), x.cast("int"), y.cast("int"))
    mine = F.col("own")
    late = F.concat(each(F.col("mains"), lambda i: key("main", i, mine)), each(F.col("lates"), lambda i: key("late", F.least(i, mine), F.greatest(i, mine))))
    places = F.when(F.col("mains") + F.col("lates") <= 2, F.array("value")).when(F.col("late"), late).otherwise(each(F.col("lates"), lambda i: key("main", mine, i)))
    dealt = met.withColumn("own", F.when(F.col("late"), deal(F.col("lates"))).otherwise(deal(F.col("mains"))))
    return dealt.select("band", F.explode(places).alias("value"), "f", "p", "component")


def cross_links(sets: list[np.ndarray], group: np.ndarray, prints: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions of similar sets that connect the groups; members of one group count as connected."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    table = pivot_table(prints, pivots())
    free, mask, out = np.ones(len(sets), bool), np.zeros(len(ids), bool), []
    members = {int(g): np.flatnonzero(group == g).tolist() for g in np.unique(group)}
    for start in members:
        if not free[members[start][0]]:
            continue
        queue = list(members[start])
        free[queue] = False
        while queue and free.any():
            x = queue.pop()
            left = np.flatnonzero(free & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1))
            left = left[(np.abs(table[left] - table[x]) <= RADIUS).all(1)]
            left = left[np.bitwise_count(prints[left] ^ prints[x]) <= RADIUS]
            if not len(left):
                continue
            own = ids[bounds[x] : bounds[x + 1]]
            mask[own] = True
            both = np.array([np.count_nonzero(mask[ids[bounds[y] : bounds[y + 1]]]) for y in left])
            mask[own] = False
            for y in left[both / np.maximum(1, sizes[left] + sizes[x] - both) >= similarity].tolist():
                if free[y]:
                    out.append((x, y))
                    queue += members[int(group[y])]
                    free[members[int(group[y])]] = False
    return out


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components of every bucket (band, value) of ``f``, ``p``, ``component`` and ``shingles``."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links_of(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        f, group, prints = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (2, 3, 4))
        if (group == group[0]).all():
            return []
        sets = [np.asarray(y) for x in held for y in np.split(x.column(5).flatten().to_numpy(), np.cumsum(x.column(5).value_lengths().to_numpy())[:-1])]
        return [(int(f[i]), int(f[j])) for i, j in cross_links(sets, group, prints.view(np.uint64), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            band, value = (batch.column(k).to_numpy() for k in (0, 1))
            edge = np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1])) + 1
            out = []
            for a, b in itertools.pairwise([0, *edge.tolist(), len(band)]):
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (band[a], value[a]):
                    out += links_of(held)
                    held = []
                held.append(batch.slice(a, b - a))
            yield as_batch(out)
        if held:
            yield as_batch(links_of(held))
        held.clear()

    return rows.select(F.col("band").cast("long").alias("band"), "value", "f", "component", "p", "shingles").repartition(width, "band", "value").sortWithinPartitions("band", "value").mapInArrow(lean(run), "a long, b long")


def in_blocks(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Buckets (band, value) of over ``crowd`` rows (``n``) dealt by ``f`` to blocks of half of it, each two of which meet under a value of their own."""
    most = F.when(F.col("n") > crowd, F.ceil(2 * F.col("n") / crowd)).otherwise(1)
    own = F.pmod(F.xxhash64(F.lit(SEED), "f"), most)
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    paired = F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other"))
    return met.withColumn("value", F.when(F.col("n") > crowd, paired).otherwise(F.col("value"))).drop("own", "other")


def bucketed_links(rows: DataFrame, most: int) -> DataFrame:
    """Spanning links of every bucket (band, value) of fingerprints ``f``."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    references = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def flush(band: np.ndarray, value: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1])) + 1
            out = []
            for a, b in itertools.pairwise([0, *edge.tolist(), len(band)]):
                if b - a > 1:
                    out += [(int(prints[a + i]), int(prints[a + j])) for i, j in bucket_links(prints[a:b].view(np.uint64), references, most)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for batch in batches:
            new = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, h in enumerate(held)]
            if not len(new[0]):
                continue
            last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            split = int(last[-1]) + 1 if len(last) else 0
            held = [x[split:] for x in new]
            if split:
                yield flush(*(x[:split] for x in new))
        if len(held[0]):
            yield flush(*held)

    return rows.select(F.col("band").cast("long").alias("band"), "value", "f").repartition(width, "band", "value").sortWithinPartitions("band", "value", "f").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, width: int = SHINGLE, text: str = "text", similarity: float | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id`` of every row of ``docs``.

    Links are at ``most`` bits, all of them; or, with ``similarity``, at that Jaccard similarity of shingle sets among candidates by their fingerprints.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    if similarity:
        prints, named = _similar(docs, similarity, width)
        ids = named.select("f", F.col("p").alias("fingerprint"), F.col("component.id").alias("component_id"))
        return join_salted(prints.select("doc_id", "f"), cut(ids), "f", "doc_id").select("doc_id", "fingerprint", "component_id")
    prints = cut(with_fingerprints(docs, width=width))
    distinct = cut(prints.groupBy("f").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))).alias("least")))
    found = components(links(distinct.select("f"), distinct.count(), most))
    ids = _named(distinct, found).select("f", F.col("component.id").alias("component_id"))
    return join_salted(prints, cut(ids), "f", "doc_id").select("doc_id", F.col("f").alias("fingerprint"), "component_id")


def _named(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``distinct`` (f, least) with ``component``: the smallest ``least`` of its component in ``found`` (node, component), which breaks ties by ``f``."""
    named = cut(distinct.join(found, distinct["f"] == found["node"], "left").withColumn("root", F.coalesce("component", "f")).drop("node", "component"))
    smallest = named.groupBy("root").agg(F.min(F.struct("least.missing", "least.id", "f")).alias("component"))
    return join_salted(named, smallest, "root", "f").drop("root")


def _similar(docs: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) as (doc_id, text hash ``t``, node ``f``), and the nodes with their components by Jaccard similarity.

    Shingles are made anew for the sets in a group of candidates.
    """
    docs = docs.withColumn("t", F.xxhash64("text"))
    prints = cut(sketched(docs, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), "t")).alias("least")
    distinct = cut(prints.groupBy("f").agg(least, F.min("size").alias("size"), F.min("bits").alias("bits")).withColumn("p", F.col("bits")[0]))
    rows = candidates(distinct, distinct.count(), similarity)
    needed = cut(distinct.join(rows.select("f"), "f", "left_semi").select(F.col("least.id").alias("id"), F.col("least.t").alias("at")))
    needed = F.broadcast(needed) if needed.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else needed
    texts = docs.join(needed, (F.col("t") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = cut(shingle_sets(texts, width).groupBy("f").agg(F.first("shingles").alias("shingles")))
    return prints, _named(distinct.drop("bits"), components(similar_links(rows, sets, similarity)))


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id (rows without one come last), then of the least text hash.

    Rows of one id with different texts are rows of their own. Of rows equal in id and text one stays.
    """
    rows = apart(docs, "doc_id", "text")
    prints, named = _similar(rows.select("doc_id", "text"), similarity, width)
    mine = F.struct("least.missing", "least.id", "f")
    chosen = cut(named.filter(mine == F.col("component")).select(F.col("least.id").alias("kept id"), F.col("least.t").alias("kept text")))
    at = (F.xxhash64("text") == F.col("kept text")) & F.col("doc_id").eqNullSafe(F.col("kept id"))
    again = prints.groupBy(F.col("doc_id").alias("id"), "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = cut(chosen.join(again, (F.col("t") == F.col("kept text")) & F.col("id").eqNullSafe(F.col("kept id")), "left_semi"))
    kept = rows.join(chosen, at, "left_semi")
    if again.limit(1).count():
        repeated = rows.join(again, at, "left_semi")
        order = F.xxhash64(*(c for c, t in repeated.dtypes if "map<" not in t and "variant" not in t))
        one = repeated.groupBy("doc_id", F.xxhash64("text").alias("kept text")).agg(F.min_by(F.struct(*repeated.columns), order).alias("row"))
        kept = kept.join(again, at, "left_anti").unionAll(one.select("row.*"))
    return kept.toDF(*docs.columns)


def as_hex(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))
