"""Name scores, phonetic keys, token counters, packing and the stores against plain versions."""

import io
import random

import numpy as np
import pytest

from corpusweave.functions import similarity as S
from corpusweave.functions import tokens as T


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if c == d else max(row[j + 1], row[j])
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def test_ratio_and_partial_against_plain_versions():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(9))) for _ in range(2))
        assert S.ratio(a, b) == pytest.approx(plain_ratio(a, b))
        if a and b:
            short, long = sorted((a, b), key=len)
            ways = [(short, long)] + [(long, short)] * (len(a) == len(b))
            whole = lambda x, y: [y[i:j] for i in range(len(y)) for j in range(i + 1, len(y) + 1) if j - i == len(x) or (j - i < len(x) and (i == 0 or j == len(y)))]
            want = max(plain_ratio(x, w) for x, y in ways for w in whole(x, y))
            assert S.partial(a, b) == pytest.approx(want)


def test_weighted_scores():
    assert S.weighted("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95.0
    assert S.weighted("new york mets", "new york mets") == 100.0
    assert S.weighted("Marika", "Queen Marika the Eternal") == pytest.approx(90.0)
    assert S.partial_tokens("one two", "two three") == 100.0 and S.partial_tokens("", "a") == 0.0
    assert S.weighted("", "x") == 0.0


@pytest.mark.parametrize(("word", "key"), [("metaphone", "MTFN"), ("Thumb", "0M"), ("nation", "NXN"), ("", ""), ("cherry", "XR"), ("phone book", "FN BK")])
def test_metaphone(word, key):
    assert S.metaphone(word) == key


def test_homophones_share_a_key():
    assert S.metaphone("Melania") == S.metaphone("Malenia") == S.metaphone("Melina") == "MLN"


def test_misspelled_names_resolve(spark):
    from pyspark.sql import functions as F

    from corpusweave.operators import resolve

    names = ["Malenia", "Melina", "Queen Marika", "Radahn", "Ranni the Witch", "Godrick the Grafted", "Margit"]
    gazetteer = spark.createDataFrame([(n, 10 * (i + 1)) for i, n in enumerate(names)], "name string, freq long")
    asked = {"Radan": "Radahn", "Marika": "Queen Marika", "the witch Ranni": "Ranni the Witch", "Godrik the grafted": "Godrick the Grafted"}
    mentions = spark.createDataFrame([(m,) for m in [*asked, "Melania", "", "zzz qqq"]], "mention string")
    short = resolve.shortlist(resolve.scored(mentions, gazetteer)).collect()
    first = {r["mention"]: r["name"] for r in short if r["rank"] == 1}
    assert {m: first[m] for m in asked} == asked
    assert {"Malenia", "Melina"} <= {r["name"] for r in short if r["mention"] == "Melania"}
    assert "zzz qqq" not in first and "" not in first
    every = sorted((m, n, round(S.composite(m, n), 6)) for m in asked for n in names if S.composite(m, n) >= resolve.FLOOR)
    got = resolve.scored(mentions.filter(F.col("mention").isin(*asked)), gazetteer).collect()
    assert sorted((r["mention"], r["name"], round(r["score"], 6)) for r in got) == every


def test_mentions_in_blocks(spark, monkeypatch):
    from corpusweave.operators import resolve

    gazetteer = spark.createDataFrame([("alpha", 1), ("beta", 2)], "name string, freq long")
    mentions = spark.createDataFrame([("alpha",), ("alpa",), ("betta",), ("gamma",)], "mention string")
    whole = sorted(map(tuple, resolve.scored(mentions, gazetteer).collect()))
    monkeypatch.setattr(resolve, "BROADCAST_MENTIONS", 1)
    assert sorted(map(tuple, resolve.scored(mentions, gazetteer).collect())) == whole


def test_word_pieces_against_a_public_tokenizer(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import WordPiece
    from tokenizers.normalizers import BertNormalizer
    from tokenizers.pre_tokenizers import BertPreTokenizer

    pieces = ["[UNK]", *sorted(T.letter_vocabulary()), "the", "##ing", "play", "un", "##aff", "##able", "caf", "##e", "漢", "é"]
    (tmp_path / "vocab.txt").write_text("\n".join(pieces) + "\n", encoding="utf-8")
    public = tokenizers.Tokenizer(WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=100))
    public.normalizer, public.pre_tokenizer = BertNormalizer(), BertPreTokenizer()
    count = T.WordPieces(T.read_vocabulary(str(tmp_path / "vocab.txt")))
    rng = random.Random(2)
    texts = ["", " ", "The playing is unaffable, café!", "漢字 and $5.00 a\u200bb", "x" * 101, "Ünïcode—dash … q’s", "tab\tand\nline\u00a0nbsp", "don't [stop] 100%"]
    texts += ["".join(rng.choices("theplayingun .,é漢ß1-", k=40)) for _ in range(200)]
    for t in texts:
        assert count(t) == len(public.encode(t, add_special_tokens=False).ids), t
        assert count(t) == sum(map(count, t.split()))


def plain_collapse(text, longest):
    w, out, i = text.split(), [], 0
    while i < len(w):
        n = next((n for n in range(longest, 0, -1) if w[i : i + n] == w[i + n : i + 2 * n] and len(w[i + n : i + 2 * n]) == n), 0)
        out += w[i : i + (n or 1)]
        i += 2 * n or 1
    return " ".join(out)


def test_runs_and_packing_against_plain_versions():
    from corpusweave.operators.chunks import collapse_runs, hard_split, pack

    rng = random.Random(3)
    for _ in range(400):
        text = " ".join(rng.choices("abc", k=rng.randrange(40)))
        assert collapse_runs(text, 4) == plain_collapse(text, 4)
    for _ in range(200):
        sentences = [" ".join(rng.choices(["aa", "b", "ccc"], k=rng.randrange(1, 12))) + "." for _ in range(rng.randrange(12))]
        pieces = pack(" ".join(sentences), 10, 1)
        parts = [p for s in sentences for p in (hard_split(s, 10) if len(s.split()) > 10 else [s])]
        want, held = [], []
        for p in parts:
            if held and sum(len(h.split()) for h in held) + len(p.split()) > 10:
                want.append(" ".join(held))
                held = held[-1:]
            held.append(p)
        assert pieces == want + [" ".join(held)] * bool(held)


def test_chunks_of_a_page(spark):
    """Pieces by hand: stats first, sections in order, short pieces dropped, numbers without gaps, tags of a gazetteer by either way."""
    from corpusweave.operators import entities
    from corpusweave.operators.chunks import chunk_pages, dedup
    from corpusweave.operators.html import parse_pages
    from corpusweave.query_modules.landing import BASE, HOST, PAGE

    long = "A whole sentence about Malenia and the Lands Between that is long enough to be kept. " * 2
    html = [PAGE.format(name=f"Blade {n}", type="Katana", n=n).replace("</h1>", "</h1>").replace("<h2>Description</h2>", f"<h2>Lore</h2><p>{long}</p><h2>Description</h2>") for n in (3, 4)]
    raw = spark.createDataFrame([(f"{BASE}/{i}", h) for i, h in enumerate(html)], "url string, html string")
    names = spark.createDataFrame([("Malenia",), ("Lands Between",), ("Nowhere",)], "name string")
    rows = dedup(chunk_pages(parse_pages(raw, BASE, HOST), names)).collect()
    for i in range(2):
        mine = sorted((r["chunk_index"], r["section_heading"]) for r in rows if r["url"].endswith(f"/{i}"))
        assert [k for k, _ in mine] == list(range(len(mine))) and mine[0][1] == "Stats" and "Lore" in [h for _, h in mine]
        lore = next(r for r in rows if r["url"].endswith(f"/{i}") and r["section_heading"] == "Lore")
        assert {"Malenia", "Lands Between"} <= set(lore["entities"]) and "Nowhere" not in lore["entities"]
    texts = spark.createDataFrame([(1, "the lands between malenia"), (2, "none"), (3, ""), (4, None)], "id long, text string")
    joined = {r["id"]: r["entities"] for r in texts.select("id").join(entities.tag(texts, names, "id"), "id", "left").collect()}
    assert {r["id"]: r["entities"] or None for r in entities.with_tags(texts, names, "id").collect()} == joined


def test_native_packing_agrees(spark):
    from pyspark.sql import functions as F

    from corpusweave.functions import text as X
    from corpusweave.operators.chunks import pack, packed_natively

    rng = random.Random(5)
    texts = [" ".join(" ".join(rng.choices(["aa", "b"], k=rng.randrange(1, 9))) + "." for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = rows.select("id", packed_natively(F.filter(X.sentences(F.col("text")), lambda s: F.trim(s) != ""), 20).alias("p")).collect()
    assert {r["id"]: r["p"] for r in found} == {i: pack(t, 20) for i, t in enumerate(texts)}


def test_npy_files(spark, tmp_path):
    from corpusweave.sources.collections import read_npy, write_npy

    rows = spark.createDataFrame([(i, [float(i), i + 0.5]) for i in range(10)], "id long, vector array<float>").repartition(1)
    assert write_npy(rows, str(tmp_path / "v"), "id", rows=4) == 3
    back = read_npy(spark, str(tmp_path / "v")).orderBy("file", "at").collect()
    assert [list(r["vector"]) for r in back] == [[float(i), i + 0.5] for i in range(10)]
    out = io.BytesIO()
    np.save(out, np.zeros(3))
    (tmp_path / "bad.npy").write_bytes(out.getvalue())
    with pytest.raises(Exception, match="dimensions"):
        read_npy(spark, str(tmp_path / "bad.npy")).collect()


def test_relational_tables(spark):
    from corpusweave.sources.collections import jdbc, write_jdbc

    url, driver = "jdbc:derby:memory:store;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "ID long, TITLE string")
    try:
        write_jdbc(rows, url, "CONVERSATIONS", "overwrite", driver=driver)
    except Exception as error:  # noqa: BLE001
        if "ClassNotFound" in str(error) or "driver" in str(error).lower():
            pytest.skip("no embedded database")
        raise
    assert jdbc(spark, url, "SELECT ID, TITLE FROM CONVERSATIONS WHERE ID < 15", "ID", 0, 20, 3).count() == 15


def test_reports_and_loose_pages(spark, tmp_path):
    from corpusweave.operators.evaluate import write_report
    from corpusweave.sources.files import read_cached_pages

    rates = spark.createDataFrame([("a", 1, 2, 2), (None, 1, 2, 2)], "lang string, hit_hits long, hit_known long, n long")
    data, page = write_report(rates, "lang", ("hit",), str(tmp_path), "20260101")
    assert spark.read.json(data).count() == 2
    lines = [r[0] for r in spark.read.text(page).collect()]
    assert lines[0] == "| lang | n | hit |" and lines[2:] == ["| all | 2 | 1/2 |", "| a | 2 | 1/2 |"]
    (tmp_path / "x.html").write_text("<p>é</p>", encoding="utf-8")
    assert [tuple(r) for r in read_cached_pages(spark, str(tmp_path / "*.html"), loose=True).collect()] == [("x.html", "<p>é</p>")]


def test_word_pieces_are_cut_once_a_word(monkeypatch):
    """Each white-space word is cleaned and cut once, however often it comes, and long words only try pieces that there are."""
    from corpusweave.functions import tokens

    seen = []
    split = tokens.split_words
    monkeypatch.setattr(tokens, "split_words", lambda text: seen.append(text) or split(text))
    count = tokens.WordPieces(tokens.letter_vocabulary())
    assert count("Word, é! Word,\x00 " * 500) == 500 * (5 + 2 + 5) and sorted(seen) == ["Word,", "Word,\x00", "é!"]
    assert tokens.WordPieces(["ab", "##c", "##cd"]).longest == [4, 2]


def test_empty_answers_mention_nothing(spark):
    from corpusweave.operators.evaluate import question_scores

    rows = [(a, "Malenia", "", "", ["Malenia"], "", "", ["Malenia"], 0) for a in ("", None, "of malenia", "none")]
    scores = question_scores(spark.createDataFrame(rows, "answer string, expected_entity string, expected_intent string, expected_group string, entities array<string>, intent string, `group` string, titles array<string>, roster_size int"))
    assert [r["answer_mentions_entity"] for r in scores.collect()] == [False, None, True, False]


def test_pages_of_one_url_have_their_own_landings(spark, tmp_path):
    """The cache query against its SQL where a URL comes several times; without keys all its rows read the same landing."""
    import duckdb

    from corpusweave import registry
    from corpusweave.sources import files

    rows = [(0, "a", "000"), (2, "a", "2"), (3, "a", "33"), (4, "b", "4444"), (5, "c", "5")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()["s2_cache_names"](spark, str(tmp_path)).select("page_id", "file", "hit", "n").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.oracle_sql()["s2_cache_names"]).fetchall())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files.write_cached_pages(pages.filter("page_id % 2 = 0"), str(tmp_path / "cache"))
    hits, left = files.cache_hits(pages.select("page_id", "url"), files.read_cached_pages(spark, str(tmp_path / "cache")))
    assert sorted((r["page_id"], r["html"]) for r in hits.collect()) == [(0, "000"), (2, "000"), (3, "000"), (4, "4444")] and [r["page_id"] for r in left.collect()] == [5]
