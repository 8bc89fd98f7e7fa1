import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, hits string, draws int, copy int, size long, kept_id long, quality string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "sto", "vu") for b in ("", "da", "ne", "qui", "ro", "thes")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def texts(rng: random.Random) -> list:
    """Prose with exact and near copies, shared passages, repeated words and lines, and odd texts."""
    base = [prose(rng, rng.choice((3, 20, 80, 160, 400))) for _ in range(40)]
    passage = prose(rng, 70)
    shared = [f"{prose(rng, 30)} {passage} {prose(rng, rng.randrange(0, 40))}" for _ in range(12)]
    near = [b.replace("ka", "kaX", 1) for b in base[:8]]
    odd = [None, "", " \t\n", "word", "a b", "0123456789 " * 30, "la la " * 200, "x" * 30_000, "one line\none line\n\none line", "é ü 漢字 \x00\x01\x02 end", prose(rng, 20_000), "ÀÉ" * 60]
    return base + shared + near + base[:6] + [base[0]] * 20 + odd + [passage, passage.upper()]


def write(spark, folder, docs, labels=(), benchmark=()):
    wide = [(i, t, lang, source, None if t is None else len(t)) + (None,) * 9 for i, t, lang, source in docs]
    spark.createDataFrame(wide, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """All the hard cases at once: nulls in every column, copies, long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    docs = [(i, t, (None, "en", "de")[i % 3], (None, "", "s1", "s2")[i % 4]) for i, t in enumerate(texts(rng))]
    docs += [docs[3], docs[3], (None, "no id here", "en", "s1"), (None, None, None, None)]
    labels = [(i, 1, None if i % 7 == 0 else int(i % 5 == 0)) for i in range(0, 90)] + [(None, 1, 1), (3, 0, 1)]
    items = [(1, docs[0][1]), (2, " ".join(docs[41][1].split()[35:60])), (3, None), (4, ""), (5, "word"), (None, docs[2][1]), (1, docs[0][1])]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, items)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def plain_dir(spark, tmp_path_factory):
    """As ``odd_dir``, with distinct ids and no repeated rows."""
    rng = random.Random(9)
    docs = [(i, t, ("en", "de")[i % 2], ("s1", "s2", None)[i % 3]) for i, t in enumerate(texts(rng))]
    items = [(i, " ".join((docs[i][1] or "x").split()[:40])) for i in range(0, 50, 7)] + [(99, "word"), (98, "lo midane")]
    return write(spark, tmp_path_factory.mktemp("plain"), docs, [(i, 1, i % 2) for i in range(60)], items)
