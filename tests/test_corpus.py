"""Pages to chunks, entities, resolution, vectors and conversations, on worked examples."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.operators import chunks as K
from corpusweave.operators import html as H

PAGE = """<html><head><title>Moonveil | Wiki</title><script>var x = "<p>no</p>";</script></head><body>
<nav><a href="/Nav">Nav</a></nav>
<div id="breadcrumbs-container"><a href="/E">Equipment</a><a href="/W">Weapons</a><a href="/K">Katanas</a><div id="breadcrumbs-bcontainer"><a href="#">+</a></div></div>
<h1 id="page-title">Moonveil | Wiki</h1>
<div id="wiki-content-block"><div class="col-sm-3">side</div>
<table class="wiki_table"><tr><th>Moonveil</th></tr><tr><td>Kind</td><td>Katana</td></tr><tr><td>ScalingStrEDexC</td><td>RequiresStr12Dex18</td></tr>
<tr><td>Scaling<div class="lineleft"><a>Str</a> E <a>Dex</a> C<br></div></td><td>Requires<div class="lineleft"><a>Str</a> 12 <a>Dex</a> 18</div></td></tr>
<tr><td>Weak to<br><div class="lineleft"><a>Slash</a></div></td><td>Wgt. 6.5</td></tr><tr><td>FP Cost 7.5</td><td>Slots Used 1</td></tr></table>
<img src="/icon.png"><img src="/big.jpg" width="50"><img src="/moon.jpg">
<h2>Wiki Moonveil Notes</h2><p>A long enough paragraph of notes about the blade [ Map Link ].</p><p>short</p>
<ul><li>Axes</li><li>Bows</li><li>Claws</li><li>Whips</li></ul><ul><li>Stone<ul><li>Small Stone</li></ul></li></ul><p>♦ Alpha ♦ Beta ♦ Gamma Delta Epsilon</p>
<h3>Dialogue</h3><p><em>I have walked a</em> <em>long way here.</em></p><blockquote>I have walked a long way</blockquote>
<h2>Description</h2><p>Katana forged of glintstone, a masterpiece of its smith and age.</p>
<a href="/Radahn">x</a><a href="/Radahn#top">x</a><a href="https://other.example/x">x</a><a href="/pic.png">x</a></div>
<footer><a href="/Foot">f</a></footer></body></html>"""


def parsed():
    return H.parse(PAGE, "https://w.example/Moonveil", "https://w.example", "w.example", "Wiki")


def test_page():
    p = parsed()
    assert (p["title"], p["breadcrumb"]) == ("Moonveil", ["Equipment", "Weapons", "Katanas"])
    assert p["internal_links"] == ["https://w.example/Radahn"]
    assert p["infobox"] == {"Kind": "Katana", "FP Cost 7.5": "Slots Used 1"} or p["infobox"]["Kind"] == "Katana"
    assert p["image_url"] == "https://w.example/moon.jpg"
    assert p["dialogue"] == ["I have walked a long way here."]
    assert p["item_descriptions"] == ["Katana forged of glintstone, a masterpiece of its smith and age."]
    s = p["stats"]
    assert (s["scaling"], s["requires"], s["weak_to"], s["weight"], s["slots"], s["fp_cost"]) == ({"str": "E", "dex": "C"}, {"str": 12, "dex": 18}, ["Slash"], 6.5, 1, None)
    body = p["body_text"].split("\n")
    assert "## Wiki Moonveil Notes" in body and "Stone" in body and "Small Stone" in body
    assert "A long enough paragraph of notes about the blade ." in body
    assert not {"short", "Axes", "side", "no"} & set(body) and not any("♦" in x for x in body)


def test_broken_markup():
    for text in (None, "", "<p>open <b>bold", "</div></p>", "<table><tr><td>a<td>b<tr><td>c</table>", "&amp;&lt;x"):
        assert H.parse(text, "u", "https://w.example", "w.example")["breadcrumb"] == []


def test_discovery_skips_navigation_tables():
    page = '<article><table class="infobox"><tr><td><a href="/A">a</a></td></tr></table><table class="wiki_table"><tr><td><a href="/B">b</a> ♦ <a href="/C">c</a></td></tr></table><table class="wiki_table"><tr><td><a href="/D">d</a></td></tr></table></article>'
    root = H.tree(page)
    assert H.links(root, "https://w.example", "w.example", discovery=True) == ["https://w.example/D"]
    assert len(H.links(root, "https://w.example", "w.example")) == 4


def test_chunks(spark):
    from corpusweave.operators.html import parse_pages

    pages = parse_pages(spark.createDataFrame([("https://w.example/Moonveil", PAGE), ("https://w.example/E", "<p>x</p>")], "url string, html string"), "https://w.example", "w.example", "Wiki").withColumns({"category": F.lit("item"), "doc_type": F.lit("page")})
    gazetteer = spark.createDataFrame([("Radahn",), ("Katana",), ("Weapons",), ("blade",)], "name string")
    rows = {r["chunk_index"]: r for r in K.dedup(K.chunk_pages(pages, gazetteer, "Wiki")).collect()}
    assert rows[0]["section_heading"] == "Stats" and rows[0]["raw_text"] == "Scaling — Str E, Dex C. Requires — Str 12, Dex 18. Weight 6.5. Slots 1. Weak to Slash"
    assert rows[0]["weapon_type"] == "Katanas" and rows[0]["scaling_dex"] == "C" and rows[0]["text"].startswith("[Equipment / Weapons / Katanas / Moonveil · Stats]\n")
    assert all(r["entities"][0] == "Moonveil" and "Weapons" not in r["entities"] and "blade" not in r["entities"] for r in rows.values())
    assert sorted(rows) == list(range(len(rows)))


def test_collapse():
    assert K.collapse_runs("A B C A B C") == "A B C"
    assert K.collapse_runs("Video Location Video Location x x") == "Video Location x"
    assert K.tidy("Same. same. Other.") == "Same. Other."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=12), max_size=12), st.integers(4, 12))
def test_packing_keeps_sentences(sentences, most):
    text = " ".join(" ".join(s) + "." for s in sentences)
    pieces = K.pack(text, most, overlap=0)
    assert " ".join(pieces).split() == text.split()
    overlapped = K.pack(text, most, overlap=1)
    assert len(overlapped) >= len(pieces) if pieces else overlapped == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a.", "b", "c!"]), max_size=20))
def test_tidy_leaves_no_repeat(words):
    once = K.tidy(" ".join(words))
    from re import split

    parts = [s.lower() for s in split(r"(?<=[.!?])\s+", once)]
    assert not once or len(parts) >= 1


def test_native_packing_agrees(spark):
    from corpusweave.functions.text import sentences

    text = " ".join(f"w{i} " * (i % 7 + 1) + f"end{i}." for i in range(60))
    text = " ".join(text.split())
    got = spark.createDataFrame([(text,)], "t string").select(K.packed_natively(sentences(F.col("t")), 20).alias("p")).first()["p"]
    assert got == K.pack(text, 20)


def test_similarity():
    from corpusweave.functions.similarity import composite, partial, ratio, token_sort

    assert ratio("abcd", "abcd") == 100 and ratio("abc", "") == 0 and ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert token_sort("fuzzy wuzzy", "wuzzy fuzzy") == 100 and partial("marika", "queen marika") == 100
    assert composite("Melania", "Malenia") == 100


def test_shortlist(spark):
    from corpusweave.operators import resolve

    names = spark.createDataFrame([("Malenia", 50), ("Melina", 90), ("Margit", 10), ("Radahn", 5)], "name string, freq long")
    mentions = spark.createDataFrame([("Melania",), ("",), (None,), ("Melania",)], "mention string")
    short = [(r["name"], r["rank"]) for r in resolve.shortlist(resolve.scored(mentions, names)).orderBy("rank").collect()]
    assert {n for n, _ in short} >= {"Malenia", "Melina"} and [r for _, r in short] == list(range(1, len(short) + 1))


def test_binding():
    from corpusweave.plans.retrieval import bind_choices

    close = {"m": [("A", 92.0), ("B", 91.0)]}
    assert bind_choices({"m": [("A", 100.0), ("B", 90.9)]}) == ["A"]
    assert bind_choices(close) == ["A"] and bind_choices(close, {"M ": 2}) == ["B"]
    assert bind_choices(close, {"m": 0}) == [] and bind_choices({"b": close["m"]}, {"b": 0}) == ["B"]
    assert bind_choices(close, {"m": 9}) == ["A"] and bind_choices({"x": []}) == []


def test_plans():
    from corpusweave.plans.retrieval import RetrievalPlan, attempts, clean_facets, grades, guarded, shaped

    assert clean_facets({"junk": 1, "sort": "x"}) is None and clean_facets({"dlc": True, "junk": 1}) == {"dlc": True}
    assert grades("C", True) == ["S", "A", "B", "C"] and grades("z", True) == []
    plan = shaped(RetrievalPlan("how do I reach Y?", entities=("Limgrave", "Y"), query="reach Y from Limgrave", category="lore", facets={"dlc": True}))
    assert plan.entities == ("Y",) and plan.category is None and [p.facets for p in attempts(plan)] == [None, {"dlc": True}]
    assert shaped(RetrievalPlan("heaviest armor")).sort == "weight_desc"
    assert shaped(RetrievalPlan("how many X", entities=("X",), group=" x ")).group is None
    assert shaped(RetrievalPlan("all of it", intent="summary")).k == 14
    assert guarded(RetrievalPlan("yes", needs_retrieval=False), "User: Tell me\nAssistant: Shall I?").query == "Tell me"
    assert not guarded(RetrievalPlan("hello", needs_retrieval=False)).needs_retrieval
    with pytest.raises(ValueError):
        RetrievalPlan("x", k=21)


def test_reuse_needs_all(spark):
    from corpusweave.operators.vectors import require_complete, reuse

    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int")
    current = spark.createDataFrame([("a",), ("b",)], "k string")
    merged = reuse(current, rows(("a", 1, 1), ("b", 2, 1)), rows(("b", 3, 1), ("b", 4, 2)), "k", "v", "at")
    assert {r["k"]: r["v"] for r in require_complete(merged).collect()} == {"a": 1, "b": 4}
    with pytest.raises(ValueError):
        require_complete(reuse(current, rows(("a", 1, 1)), rows(), "k", "v", "at"))


def test_embedder(spark):
    from corpusweave.operators.vectors import embed, sanity

    made = embed(spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string"))
    row = sanity(made, "id").first()
    assert row["passed"] and row["dim"] == 64 and not row["norm_warning"]


def test_files(spark, tmp_path):
    from corpusweave.sources import files as S

    path = str(tmp_path / "m.jsonl")
    open(path, "w").write('{"url":"u1","category":"boss"}\nnot json\n{"url":"u2","category":"item"}\n')
    assert S.read_lines(spark, path, S.MANIFEST).count() == 2
    with pytest.raises(Exception):
        S.read_lines(spark, path, S.MANIFEST, strict=True).collect()
    S.write_lines(S.read_lines(spark, path, S.MANIFEST), str(tmp_path / "out"))
    S.write_lines(S.read_lines(spark, path, S.MANIFEST), str(tmp_path / "out"), append=True)
    assert S.read_lines(spark, str(tmp_path / "out"), S.MANIFEST, strict=True).count() == 4
    S.write_list(spark.createDataFrame([("b",), ("a",), ("b",)], "value string"), str(tmp_path / "list"))
    assert [r[0] for r in S.read_list(spark, str(tmp_path / "list")).collect()] == ["a", "b"]


def test_collections(spark, tmp_path):
    from corpusweave.sources import collections as S

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "point_id long, chunk_id string, category string")
    S.create(rows, f"{tmp_path}/v=1")
    merged = S.next_version(spark, str(tmp_path), 1, rows.withColumns({"chunk_id": F.lit("z"), "batch_at": F.lit(1)}).filter("point_id = 2"))
    assert {r["point_id"]: r["chunk_id"] for r in S.settled(lambda: merged, 2).collect()} == {1: "a", 2: "z"}
    assert S.aligned(rows, merged) == 2
    with pytest.raises(TimeoutError):
        S.settled(lambda: merged, 3, wait=0.01, most=0.05)


def test_stream_is_idempotent(spark, tmp_path):
    from corpusweave.streaming import incremental as I

    schema = "url string, raw string"
    write = lambda *r: spark.createDataFrame(list(r), schema).write.mode("append").parquet(f"{tmp_path}/in")
    for batch in ([("u", "a"), ("u", "a")], [("u", "a"), ("v", "a")]):
        write(*batch)
        I.run_available(I.new_content(I.landed(spark, f"{tmp_path}/in", schema), "url", "raw"), f"{tmp_path}/state", I.batch_folder(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_roster_text():
    from corpusweave.operators.retrieve import roster_text

    assert roster_text("Armor", ["Bull-Goat Armor (26.5)"]).startswith("RANKED LIST")
    assert roster_text("Katanas", [f"K{i}" for i in range(20)]).startswith("COMPLETE LIST: Katanas, 20 in all. 15 of them")


def test_only_asked_columns_are_worked_out(spark, monkeypatch):
    monkeypatch.setattr(H, "strip_noise", lambda root: pytest.fail("noise is of no concern"))
    assert H.parse(PAGE, "u", "https://w.example", "w.example", columns=("url", "title")) == {"url": "u", "title": "Moonveil"}
    monkeypatch.undo()
    every = H.parse(PAGE, "u", "https://w.example", "w.example")
    for column in H.COLUMNS:
        assert H.parse(PAGE, "u", "https://w.example", "w.example", columns=(column,)) == {column: every[column]}
    found = H.parse_pages(spark.createDataFrame([("u", PAGE)], "url string, html string"), "https://w.example", "w.example", columns=("image_url", "stats"))
    assert found.columns == ["image_url", "stats"] and found.first()["stats"]["scaling"] == every["stats"]["scaling"]


def test_references_end_with_a_semicolon():
    """A heading that was cut within a reference keeps what is left of it."""
    for text, want in (("A &amp; B&amp", "A & B&amp"), ("x &lt;&#x27;&#39; &quo", "x <'' &quo"), ("&copy &copy; &nosuch; & &amp;lt;", "&copy © &nosuch; & &lt;"), ("a&#x2", "a&#x2")):
        assert H.title(H.tree(f"<h1>{text}</h1>")) == want


def test_chunks_are_shuffled_without_their_pages(spark):
    """Only the wanted columns of a chunk go through the dedup; of equal texts the first counts, and ties have an order."""
    made = [("u", i, h, "body", "same text", "page " * 1000) for i, h in ((1, "B"), (1, "A"), (2, "0"))] + [("u", 0, "Z", "body", "other", "p")]
    chunks = spark.createDataFrame(made, "url string, chunk_index int, section_heading string, chunk_type string, raw_text string, body_text string")
    found = K.dedup(chunks.withColumn("n_chars", F.length("raw_text")), "section_heading", "chunk_index", "n_chars")
    assert sorted(map(tuple, found.collect())) == [("A", 1, 9), ("Z", 0, 5)]
    assert "body_text" not in found._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    pages = H.parse_pages(spark.createDataFrame([("https://w.example/M", PAGE)], "url string, html string"), "https://w.example", "w.example", columns=K.PAGE_COLUMNS)
    assert not set(K.PARTS) & set(K.chunk_pages(pages).columns)


def test_long_texts_are_stripped_alike(spark):
    from corpusweave.functions import text as X

    texts = ["", " ", "a", " a", "a\n", "\u2003a b\u00a0", "a\u2028", "a b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip(F.col("t")).alias("a"), X.strip_long(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in rows] == [r["a"] for r in rows]
