"""Each operator on small tables with the odd cases: against brute force, or results by hand."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, dealing, decontam, html_extract, jaccard, mixing, pii, sharding, substrings, textarrays, topk, toxicity, warc

DOCS = "doc_id long, text string"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1


def test_decontamination_by_hand(spark):
    bench = docs_of(spark, [(1, "a B c"), (2, None), (3, "..."), (4, "a b c d e f g h i j k"), (4, "x y"), (None, "zz")], "item_id long, text string")
    rows = [(1, "q a,b.c d e f g h i j k l", 1), (2, None, 2), (2, "", 3), (None, "zz zz", 4), (5, "d e f g h i j", 5)]
    docs = docs_of(spark, rows, "doc_id long, text string, n_words int")
    for blocks in (200_000, 1):
        got = {r["n_words"]: r for r in decontam.hits(docs, bench, max_windows=blocks).withColumn("hit", decontam.covered(F.col("spans"))).collect()}
        assert [(got[k]["_n_words"], got[k]["hit"], got[k]["items"]) for k in range(1, 6)] == [(13, 11, ["1", "4"]), (0, 0, []), (0, 0, []), (2, 2, [""]), (7, 0, [])]
    assert sorted(r["n_words"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 3, 5]
    names = ["kind", "pos", "hash", "hashes", "span", "its", "g_hash", "g_words", "g_items", "uid", "w", "m", "h", "bad_id", "bad_hash", "doc_key"]
    odd = docs.withColumns({c: F.lit(c) for c in names})
    for blocks in (200_000, 1):
        assert {tuple(r[c] for c in names) for r in decontam.hits(odd, bench, max_windows=blocks).collect()} == {tuple(names)}
    left = decontam.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == 3
    long = docs_of(spark, [(1, "q " * 300_000 + "a b c " + "q " * 300_000)], DOCS)
    assert [(r["n_words"], r["items"]) for r in decontam.hits(long, bench).collect()] == [(600_003, ["1"])]
    assert decontam.hits(docs.limit(0), bench).count() == 0 and decontam.hits(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


# 2


def test_longest_previous_factors_equal_brute_force():
    rng = np.random.default_rng(2)
    for n, letters in ((0, 2), (1, 2), (40, 1), (300, 2), (300, 3)):
        windows = rng.integers(65, 65 + letters, (n, 8), dtype=np.uint8)
        doc, at = rng.integers(0, 12, n), rng.permutation(n)
        row = doc * 7 % 5
        got = substrings.longest_previous(windows, doc, row, at)
        common = lambda a, b: int((np.append(a != b, True)).argmax())
        for i in range(n):
            other = max((common(windows[i], windows[j]) for j in range(n) if doc[j] < doc[i]), default=0)
            same = any(doc[j] == doc[i] and row[j] == row[i] and at[j] < at[i] and common(windows[i], windows[j]) == 8 for j in range(n))
            assert got[i] == 8 if same or other == 8 else other <= got[i] < 8


def brute_substrings(rows, length):
    seen, out = defaultdict(list), []
    key = lambda d: -(2**63) if d is None else d
    for i, (d, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((key(d), i, p))
    for i, (d, t) in enumerate(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if any(e < key(d) or j == i and q < p for e, j, q in seen[b[p : p + length]]):
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [100, 60])
def test_substrings_equal_brute_force(spark, length):
    rng = random.Random(length)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(300)) for _ in range(4)]
    rows = [(1, "x" * 400), (2, None), (3, ""), (4, "ab" * 200), (None, base[0][:150]), (7, "y" * 99)]
    for _ in range(50):
        rows.append((rng.randrange(5, 45), "".join(rng.choice([base[rng.randrange(4)][rng.randrange(150) :][: rng.randint(60, 200)], "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))]) for _ in range(4))))
    rows += [rows[9], (rows[10][0], rows[11][1])]
    got = substrings.deduplicate(docs_of(spark, rows).repartition(5), length=length, digest=True).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_substrings(rows, length)


def test_substrings_of_nothing(spark):
    assert substrings.deduplicate(docs_of(spark, [])).count() == 0
    r = substrings.deduplicate(docs_of(spark, [(1, "é" * 60), (2, "é" * 60)])).orderBy("doc_id").collect()
    assert [(x["n_removed"], bytes(x["kept"]).decode()) for x in r] == [(118, "é"), (120, "")]  # every run but the first two of the first text is a copy of one two bytes before


def test_packed_entries_come_back():
    rng = np.random.default_rng(0)
    doc, row, x = rng.integers(-9, 9, 500), rng.integers(-(2**62), 2**62, 500), rng.integers(0, 255, 500).astype(np.uint8)
    out = dealing.unpack([dealing.pack(doc, row, x=x), dealing.pack(doc[:3], row[:3], x=x[:3])])
    assert (out["doc"] == [*doc, *doc[:3]]).all() and (out["row"] == [*row, *row[:3]]).all() and (out["x"] == [*x, *x[:3]]).all()
    texts = [b"", b"abc", "é".encode() * 1000]
    assert list(dealing.unpack_texts(dealing.pack_texts(doc[:3], row[:3], texts))) == list(zip(doc[:3].tolist(), row[:3].tolist(), texts, strict=True))


# 3

PAGE = "<html><body><nav>Home</nav><div class='ad'>Buy</div><article><h1>T &amp; t</h1><p><b>One\n two<br><p>Three<script>'</p>'</script></p><div class=comments><p>no</p></div></article><footer>(c)</footer>"


def test_main_text(spark):
    plain = [(10 + i, f"http://h.example/{i}", f"<div id=top>Menu</div><div class=x><p>Para {i} {'word ' * (20 + i)}<p>second</div><ul><li>Imprint</ul>") for i in range(6)]
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "odd", ""), (4, "http://q/", "no tags, 1 < 2"), (5, "http://q/", "<main>in<!-- x</main>"), *plain]
    pages = docs_of(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got[1] == "T & t\n\nOne two\n\nThree"
    assert (got[2], got[3], got[4], got[5]) == ("", "", "no tags, 1 < 2", "in")
    assert all(got[10 + i] == f"Para {i} {'word ' * (20 + i)}".strip() + "\n\nsecond" for i in range(6))
    assert html_extract.main_text(pages.limit(0)).count() == 0


def host_texts(pages):
    """The texts of pages of one host."""
    wrapper = html_extract.Wrapper()
    parsed = [html_extract.parse(p) for p in pages]
    for x in parsed:
        wrapper = wrapper.merge(html_extract.Wrapper.of(*x))
    return [html_extract.extract(*x, wrapper, wrapper.content()) for x in parsed]


def test_host_wrapper_decides_pages_with_articles(spark):
    text = lambda i: f"Text {i} " + f"of page {i} " * 30
    pages = [f"<body class=id-{'xyz'[i % 3]}><article class=x><p>See also {i}</article><div class=text><p>{text(i)}<p>End {i}</div><div>Imprint" for i in range(6)]
    want = [f"{text(i).strip()}\n\nEnd {i}" for i in range(6)]
    assert host_texts(pages) == want
    rows = docs_of(spark, [(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.main_text(rows).collect()} == dict(enumerate(want))
    assert host_texts(["<div>Latest</div><main><p>copy</main>"] * 5) == ["copy"] * 5
    assert host_texts([f"<div>Latest {i}</div><article><h1>Rubric</h1><p>news {i * 'n'}</article>" for i in range(5)])[4] == "Rubric\n\nnews nnnn"


def test_articles_and_teasers():
    part = lambda i, k: f"Part {k} of {i} " + f"w{i}{k} " * (5 + k)
    blog = [f"<div class=feed>{''.join(f'<article class=post-{k}><p>{part(i, k)}</article>' for k in range(3))}</div><section><article class=late><p>{part(i, 3)}</article></section>" for i in range(5)]
    assert host_texts(blog) == ["\n\n".join(part(i, k).strip() for k in range(4)) for i in range(5)]
    assert html_extract.extract(*html_extract.parse(blog[0]), None, None) == "\n\n".join(part(0, k).strip() for k in range(4))
    body = lambda i: f"Body {i} " + f"b{i} " * 60
    cards = [f"<div class=x><p>{body(i)}</div><article class='card'><p>Teaser {i} {'t ' * i}</article>" for i in range(5)]
    assert host_texts(cards) == [body(i).strip() for i in range(5)]
    assert html_extract.extract(*html_extract.parse(cards[0]), None, None) == body(0).strip()
    # One page of another kind among pages with articles.
    odd = f"<article class=y><p>See also</article><div class=x><p>{body(9)}</div>"
    assert host_texts([f"<article><p>{body(i)}</article>" for i in range(5)] + [odd]) == [body(i).strip() for i in [*range(5), 9]]
    linked = [f"<div class=top><article class=main-{i}><p>{body(i)}</article></div><ul><li><article><a href=/>Other {i} {'o ' * i}</a></article></ul>" for i in range(5)]
    assert host_texts(linked) == [body(i).strip() for i in range(5)]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd#") for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        pairs = html_extract.aligned(a, b)
        assert len(pairs) == row[-1] and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_groups_of_any_length_are_folded():
    group = [f"t{i}" for i in range(40)]
    assert html_extract.fold(["x", *group * 3, "y"])[0] == ["x", ("+", tuple(group)), "y"]
    assert html_extract.fold(group[:13] * 2 + group[:12])[0] == [("+", tuple(group[:13])), *group[:12]]
    assert html_extract.fold(group + ["z"] + group)[0] == group + ["z"] + group


def test_mixed_pages_lose_no_text():
    rng = random.Random(6)
    parts = [lambda t: f"<p>{t}</p>", lambda t: f"<h2>{t}</h2>", lambda t: f"<ul><li>{t}</ul>", lambda t: f"<blockquote>{t}</blockquote>", lambda t: f"<section><p>{t}</section>", lambda t: f"<pre>{t}</pre>"]
    for _ in range(20):
        texts = [[f"text {rng.random()} " + "w " * 40 for _ in range(rng.randint(2, 12))] for _ in range(20)]
        pages = [f"<div>Site</div><div class=x>{''.join(rng.choice(parts)(t) for t in own)}</div><div>Imprint" for own in texts]
        assert host_texts(pages) == ["\n\n".join(map(str.strip, own)) for own in texts]


def test_words_of_content_outweigh_odd_ones():
    body = lambda i: f"Body {i} " + f"b{i} " * 60
    for mark in ("content with-sidebar", "main no-sidebar", "content sidebar-right", "layout has-sidebar", "page sidebar-left", "post-share"):
        alone = [f"<div class='{mark}'><article><p>{body(i)}</article></div><div class=sidebar><p>Links {i * 'l'}" for i in range(5)]
        assert host_texts(alone) == [body(i).strip() for i in range(5)], mark
        plain = [x.replace("<article>", "").replace("</article>", "") for x in alone]
        assert host_texts(plain) == [body(i).strip() if mark != "page sidebar-left" else "" for i in range(5)], mark
    both = [f"<article><h1>Head {i}</h1><div class='entry-content social'><p>{body(i)}</div><div class=post-tags>Tags {i}</div></article><div class=related><article>{'more ' * (9 + i)}</article></div>" for i in range(5)]
    assert host_texts(both) == [f"Head {i}\n\n{body(i).strip()}" for i in range(5)]
    assert host_texts([f"<article><p>{body(i)}<div id=comments><article>{'c ' * 999}{i}</article></div></article><div class='ad sidebar'>Buy {i}" for i in range(5)]) == [body(i).strip() for i in range(5)]


def test_head_and_option_end_without_end_tags():
    alone = lambda html: html_extract.extract(*html_extract.parse(html), None, None)
    assert alone("<html><head><title>x</title><body><article><p>one</article>") == "one"
    assert alone("<html><head><title>x</title><meta charset=utf-8><link rel=x><style>p{}</style>\n<p>one</p>") == "one"
    assert alone("<html><head>\n<title>x</title>\n<b>one</b> two") == "one two" == alone("<head><title>x</title>one two")
    assert alone("<head><title>x</title><script>1</script></head><article>one</article>") == "one"
    assert alone("<datalist><option>a<option>b</datalist><article><p>one</article>") == "one"
    assert alone("<article><p>one<datalist><optgroup><option>a<optgroup><option>b</datalist><p>two</article>") == "one\n\ntwo"
    assert alone("<article><p>one</p><option>a</article><p>more") == "one"


def test_wrapper_is_an_expression():
    of = lambda h: html_extract.Wrapper.of(*html_extract.parse(h))
    w = of("<div><p>a<p>b</div>").merge(of("<div><p>c</div><ul><li>x<li>y</ul>")).merge(of("<div><p>d<p>e<p>f</div>"))
    assert w.expression() == "div (p # /p)+ /div (ul (li # /li)+ /ul)?"
    assert html_extract.Wrapper.load(w.dump()).expression() == w.expression()


def test_wrappers_keep_every_item(spark):
    letters = lambda k: "".join(chr(97 + k // 26**x % 26) for x in range(4))
    text = lambda i: f"Text {i} " + f"w{i} " * 30
    # More texts that are the same on all pages than 20,000; all but the last are labels.
    labels = "".join(f"<p class=z{letters(k)}>Label {k}" for k in range(20_500))
    pages = [f"<div class=x><p>{text(i)}</p>{labels}<p class=end>End {i}</div>" for i in range(3)]
    want = [f"{text(i).strip()}\n\nEnd {i}" for i in range(3)]
    assert host_texts(pages) == want
    small = [(10 + i, f"http://small/{i}", f"<div class=x><p>{text(i)}</div>") for i in range(3)]
    rows = docs_of(spark, [*((i, "http://h/", p) for i, p in enumerate(pages)), *small, (20, None, None)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(rows).collect()}
    assert got == dict(enumerate(want)) | {10 + i: text(i).strip() for i in range(3)} | {20: ""}


def test_large_wrappers_give_the_same_texts(spark, monkeypatch):
    body = lambda i: f"Body {i} " + f"b{i} " * (20 + i)
    shape = lambda i: f"<div class=top>Site</div><div class=x><p>{body(i)}{'<h2>More</h2><p>end' * (i % 3)}</div><ul><li>Imprint</ul>"
    rows = docs_of(spark, [(i % 70, f"http://{'abc'[i % 3]}/{i}", shape(i)) for i in range(90)] + [(99, None, "")], "page_id long, url string, html string").repartition(4, "url")
    texts = lambda: sorted(map(tuple, html_extract.main_text(rows).select("page_id", "url", "text").collect()), key=str)
    want = texts()
    monkeypatch.setattr(html_extract, "BIG", 0)
    monkeypatch.setattr(html_extract, "GROUP", 700)
    assert texts() == want and len(want) == 91
    monkeypatch.setattr(html_extract, "MAX_BROADCAST", 0)
    assert texts() == want

    pages = [shape(i) for i in range(30)]
    want = host_texts(pages)
    growing = html_extract.Growing()
    monkeypatch.setattr(html_extract, "PART", 5)
    parsed = [html_extract.parse(p) for p in pages]
    for x in parsed:
        growing.add(html_extract.Wrapper.of(*x))
    whole = growing.whole()
    assert whole.pages == 30 and [html_extract.extract(*x, whole, whole.content()) for x in parsed] == want
    monkeypatch.setattr(html_extract, "HELD", 10)
    column = [pa.array(["a"] * 30), pa.array(pages)]
    parts = [x for b in html_extract._infer([pa.RecordBatch.from_arrays(column, names=["host", "html"])]) for x in b.to_pylist()]
    assert len(parts) > 1 and sum(x["size"] for x in parts) == sum(map(len, pages))
    again = [x for b in html_extract._merge([pa.RecordBatch.from_pylist(parts)]) for x in b.to_pylist()]
    assert [html_extract.Wrapper.load(x["wrapper"]).pages for x in again] == [30]


def test_alignment_in_little_memory_is_the_same(monkeypatch):
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh#") for _ in range(rng.randint(0, 150))] for _ in range(2))
        pairs = html_extract.aligned(a, b)
        with monkeypatch.context() as m:
            m.setattr(html_extract, "ROOM", 1)
            assert html_extract.aligned(a, b) == pairs


def test_pages_cut_off_in_a_tag_take_linear_time():
    import time

    odd = ["<a " + "\" " * 50, "<a " + "x='" * 40_000, "<a " * 300_000, "<a b=\"<a\" " * 90_000, "<!" * 400_000, "<script></script" * 60_000, "<a " + "b=\"c\" " * 120_000, "<p " * 200_000 + ">text"]
    for page in odd:
        began = time.time()
        html_extract.parse("<p>hi</p>" + page)
        assert time.time() - began < 5, page[:30]
    texts = [b.text for b in html_extract.parse("<p>hi</p><a " + "\" " * 50)[1]]
    assert texts == ["hi"]
    assert [b.text for b in html_extract.parse("<p title='a>b' data-x=1>one</p><p title=\"it's\">two</p><p it's>three</p>")[1]] == ["one", "two", "three"]


# 4


def test_trie_meets_automaton():
    trie = toxicity.Trie([("idiot", False, True), ("scum", False, False), ("vequ", True, False)])
    near = lambda a, b: _distance(a, b) <= 1
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choice("idotx") for _ in range(rng.randint(3, 7)))
        assert (trie.find(word) is not None) == near(word, "idiot")
    assert trie.find("idiot") == ("idiot", 0) and trie.find("idioot") == ("idiot", 1) and trie.find("vequxyz") == ("vequ", 0)
    assert trie.find("scun") is None and trie.find("") is None and trie.find("veq") is None


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(2)
    texts, y = [], []
    for i in range(600):
        words = [f"word{rng.randrange(300)}" for _ in range(40)]
        if i % 5 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(40), rng.choice(["wretch", "vermin", "zorblo" + rng.choice("abcdefgh"), "zorbli" + rng.choice("abcdefgh")]))
        texts.append(" ".join(words))
        y.append(int(i % 5 == 0))
    return toxicity.fit(texts, y)


def test_toxicity_learns_words_stems_and_context(toxic_model):
    assert {("wretch", False), ("vermin", False), ("zorbl", True)} == {e[:2] for e in toxic_model.entries}
    lexicon = toxicity.Lexicon(toxic_model.entries)
    p = lambda t: float(1 / (1 + np.exp(-np.dot(toxicity.features(*toxicity.evidence(t, lexicon)[:2]), toxic_model.weights))))
    assert p("you wretch") > 0.5 and p("such vermin here") > 0.5 and p("a word12 word13") < 0.1
    assert p("you wr3tch") > 0.5 and p("you wretsh, you vermim") > 0.5
    assert p('he said "wretch" and left') < 0.5 < p("he is a wretch and a wretch and left")
    assert lexicon.suspects(pa.array(["x “Wretch” y", None, "", "word1", "zorbloq", "vermins"])).tolist() == [True, False, False, False, True, True]


def test_every_text_with_evidence_is_a_suspect():
    long = "so" * 30
    lexicon = toxicity.Lexicon([("wretch", False, True), ("zorbl", True, False), ("beauté", False, True), ("ébahi", False, True), (long, False, True)])
    words = "wreeeeeetch wwwretchhhh w1retch wrµetch 😀wretch😀 、wretch。 «wretch» WRETCH 000 zzzorblaaaaaaa zorblq zo0rbl BEAUTÉ BXAUTÉ ÉBAHI ébahiii bééébahi plain wre tch ΑΣ'Β a 1 é".split()
    words += [long, long[:-1], long + "s", "zorbl" + "ab" * 200, "wretch" + "h" * 300, "x" * 300, "word😀" * 60 + "wretch"]
    rng = random.Random(4)
    texts = words + ["".join(rng.choice(["wretch", "zorbl", "ébahi", "e", "H", "r", "3", "😀", "é", "É", "_", " "]) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    found = np.array([toxicity.evidence(t, lexicon)[2] > 0 for t in texts])
    for batch in (texts, *([t] for t in words)):
        got = lexicon.suspects(pa.array(batch))
        assert [t for t, g in zip(batch, got, strict=True) if not g and toxicity.evidence(t, lexicon)[2]] == []
    assert (lexicon.suspects(pa.array(texts)) == found)[["Σ" not in t for t in texts]].all() and 1000 < found.sum() < len(texts)
    assert found[:4].all() and found[4:6].all()


def test_toxicity_scores_odd_rows(spark, toxic_model):
    rows = [(1, None, 5), (1, "", 6), (None, "you wretch", 7)]
    out = {r["score"]: r["score_"] for r in toxicity.score(docs_of(spark, rows, "doc_id long, text string, score int"), toxic_model, into="score_").collect()}
    assert out[5] == out[6] < 0.5 < out[7]
    labels = docs_of(spark, [(1, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.fit(*toxicity.training_rows(docs_of(spark, [(1, "a")]), labels)).entries == []
    assert toxicity.keep_clean(docs_of(spark, rows[:2] + [(3, "you wretch", 1)], "doc_id long, text string, score int"), toxic_model).columns == ["doc_id", "text", "score"]


def test_training_rows_of_odd_tables(spark):
    docs = docs_of(spark, [(1, "b", 1, 0), (1, "a", 2, 0), (1, None, 3, 0), (2, None, 4, 0), (None, "x", 5, 0)], "doc_id long, text string, label_id int, y int")
    labels = docs_of(spark, [(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    ids = [r["doc_id"] for r in labels.where("doc_id IS NOT NULL").where(~toxicity.held_out()).select("doc_id").distinct().orderBy("doc_id").collect()]
    assert toxicity.training_rows(docs, labels) == ([{1: "a", 2: ""}[i] for i in ids], [{1: 1, 2: 0}[i] for i in ids])
    assert toxicity.training_rows(docs.limit(0), labels) == toxicity.training_rows(docs, labels.limit(0)) == ([], [])
    model = toxicity.fit([], [])
    assert toxicity.score(docs.limit(0), model).count() == 0 and len({r["score"] for r in toxicity.score(docs, model).collect()}) == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    c = Counter(map(tuple, out))
    assert c[1, 1] >= 0.8 * (c[1, 1] + c[0, 1]) and c[1, 0] <= 0.03 * (c[1, 0] + c[0, 0])


# 5


@pytest.mark.parametrize("chunk", [65_536, 3])
def test_topk_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(500):
        v = [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]
        if i % 37 == 0:
            v[2] = float("nan")
        rows.append((i, v[:5] if i % 41 == 0 else v))
    rows += [(700, None), (None, [1.0] * 8), (50, [0.5] * 8), (50, [0.5] * 8), (701, rows[60][1]), (702, rows[60][1]), (703, [1e12] * 8), (704, [float("inf")] * 8), (705, [])]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), lambda i: i % 50 == 0, seed=10, chunk=chunk).collect())
    whole = sorted((i, (*(math.floor(256 * x) for x in v), *[0] * (8 - len(v)))) for i, v in rows if i is not None and v and all(map(math.isfinite, v)))
    want = []
    for p, (q, v) in enumerate(whole):
        if q % 50 == 0:
            hits = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for o, (j, w) in enumerate(whole) if o != p)
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(hits[:5])]
    assert got == sorted(want)
    few = spark.createDataFrame([(50, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in topk.search(few, lambda i: i % 50 == 0).orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 1)]


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, lambda i: i % 50 == 0).count() == 0


# 6


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/%0x\r\nEvil: 1", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (None, "n", "x" * 200), (5, "s", "x" * 99), (6, "s", "x" * 99), (7, "é", "WARC/1.1\r\n\r\n" * 30), (7, "é", "WARC/1.1\r\n\r\n" * 30)]
    pages = docs_of(spark, rows, "page_id long, url string, html string").withColumn("payload", F.lit(3))
    warc.write_pages(pages, f"{tmp_path}/w")
    got = sorted((str(r["page_id"]), str(r["target_uri"]), r["record_type"], r["refers_to_page"], r["payload_length"], len(r["payload"])) for r in warc.read(spark, f"{tmp_path}/w").collect())
    back = warc.read(spark, f"{tmp_path}/w").collect()
    assert {r["refers_to"] for r in back if r["record_type"] == "revisit"} == {r["record_id"] for r in back if r["page_id"] == 1}
    want = [("1", rows[0][1], "response", None, 200, 200), ("2", "None", "revisit", 1, 200, 0), ("None", "n", "revisit", 1, 200, 0)]
    want += [("3", "u", "response", None, 0, 0), ("4", "u", "response", None, 0, 0), *[(str(i), "s", "response", None, 99, 99) for i in (5, 6)], *[("7", "é", "response", None, 360, 360)] * 2]
    assert got == sorted(want)
    only = warc.read(spark, f"{tmp_path}/w", payload=False).where("record_type = 'revisit' AND page_id IN (2, 3)")
    assert [(r["page_id"], r["payload"]) for r in only.collect()] == [(2, None)]
    warc.write_pages(pages.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def test_warc_skips_unwanted_payloads():
    import gzip
    import io

    row = lambda i: {k: pa.scalar(v) for k, v in {"page_id": i, "url": "u", "refers_to": None, "payload": b"p" * 50, "payload_digest": "d", "payload_length": 50}.items()}
    data = b"".join(warc.WarcWriter.record(row(i)) for i in range(3))
    for stream in (io.BufferedReader(io.BytesIO(data)), gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data)))):
        out = list(warc.records(stream, lambda h: h["x-page-id"] != "1", True))
        assert [(h["x-page-id"], b) for h, _, b in out] == [("0", b"p" * 50), ("2", b"p" * 50)]
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(data[:-30])), lambda h: True, True))


# 7


def least_capacity(sizes, k):
    """By dynamic programming: the smallest possible largest sum of k runs."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends[1:].copy()  # of one run up to each item
    for _ in range(k - 1):
        best = np.array([min(best[i], *(max(best[j], ends[i + 1] - ends[j + 1]) for j in range(i))) if i else best[0] for i in range(len(sizes))])
    return best[-1]


def test_minimax_cuts_equal_brute_force():
    rng = random.Random(4)
    assert sharding.minimax_cuts([], 5) == [] and max(sum([5, 5, 5, 13, 21, 40, 40, 2][a:b]) for a, b in [(0, 5), (5, 6), (6, 8)]) == 49
    cases = [([5, 5, 5, 13, 21, 40, 40, 2], 4)] + [([rng.choice([2, 5, 13, 21, 40, rng.randint(1, 60), rng.randint(1, 600)]) for _ in range(rng.randint(1, 12))], rng.randint(1, 6)) for _ in range(10_000)]
    for sizes, k in cases:
        cuts = sharding.minimax_cuts(sizes, k)
        assert cuts[0] == 0 and len(cuts) <= k and cuts == sorted(set(cuts))
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)) == least_capacity(sizes, k), (sizes, k)


@pytest.mark.parametrize("shards", [3, 24])
def test_ranges_are_refined_down_to_the_optimum(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.randrange(-(2**63), 2**63), rng.choice([8, 20, 300, 5000])) for _ in range(400)]
    groups = spark.createDataFrame(rows, "group long, size long")
    rows.sort()
    for bits, sums in ((16, 1 << 17), (2, 16), (5, 64)):
        starts = sharding.shard_starts(groups, shards, sums, bits)
        at = [0, *(sum(g < c for g, _ in rows) for c in starts), len(rows)]
        assert len(starts) < shards and starts == sorted(starts)
        assert max(sum(s for _, s in rows[a:b]) for a, b in zip(at, at[1:], strict=False)) == least_capacity([s for _, s in rows], shards)


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(2000)] + [(5000 + i, "the same text") for i in range(1000)] + [(7, None), (7, ""), (None, "é"), (7, None)]
    out = sharding.assign(docs_of(spark, rows, DOCS).withColumn("shard", F.lit("x"))).collect()
    assert len(out) == len(rows)
    slots, sizes, crcs = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        crcs[r["text_crc32"]].add(r["shard"])
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in crcs.values())
    rest = sorted(sizes.values())[:-1]  # all but the shard of the large group
    assert rest[-1] <= 1.1 * sum(rest) / 23 and max(sizes.values()) == 1000 * (len("the same text") + 8)
    assert Counter((r["size"], r["text_crc32"]) for r in out) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.assign(docs_of(spark, [])).count() == 0


# 8


def test_mix(spark):
    rows = [(i, prose(random.Random(i), 20), f"s{i % 3}", 1) for i in range(900)] + [(1000, None, None, 2), (1001, "", "empty", 3), (None, "a b", None, 4)]
    docs = docs_of(spark, rows, "doc_id long, text string, source string, target int")
    out = mixing.with_copies(docs, copies="times")
    got = {r["source"]: r for r in out.groupBy("source", "source_size", "_target").agg(F.sum(F.col("times") * mixing.n_words(F.col("text"))).alias("taken")).collect()}
    assert (got["empty"]["source_size"], got["empty"]["_target"], got[None]["source_size"]) == (0, 0.0, 2)
    assert sum(r["_target"] for r in got.values()) == pytest.approx(1.5 * sum(r["source_size"] for r in got.values()))
    assert all(abs(r["taken"] - r["_target"]) <= 0.1 * r["source_size"] + 40 and r["_target"] <= 2 * r["source_size"] for r in got.values())
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.with_copies(docs.repartition(7), copies="times", max_broadcast=0).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == out.agg(F.sum("times")).first()[0] and mixing.mix(docs.limit(0)).count() == 0


def test_targets_are_shared_again_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, "e": 400}
    docs = docs_of(spark, [(1, "w " * n, s) for s, n in sizes.items()], "doc_id long, text string, source string")
    weight = dict(zip(sizes, (5, 2, 1, 5, 2), strict=True))
    target, left, free = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    got = {r["source"]: r["target"] for r in mixing.source_targets(docs).collect()}
    assert got == pytest.approx(target)


# 9


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize(("repeat", "small", "block"), [(False, 8, 4096), (True, 8, 4096), (False, 2, 7), (True, 2, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, repeat, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3 + repeat)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "one two three four five"), (6, "one two three four five"), (None, "one two"), (7, " \n ")]
    base = [prose(rng, rng.randint(4, 60)).split() for _ in range(12)]
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        rows.append((10 + i, " ".join(w[: len(w) - rng.choice([0, 0, 1, 3])] or w)))
    if repeat:
        rows.append((12, rows[50][1]))
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(d), find(e)))
                leader[b] = a
    want = sorted((str(d), len(s), str(None if d is None else find(d))) for d, s in sets)
    got = jaccard.join(docs_of(spark, rows).repartition(3)).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component"])) for r in got) == want


def test_jaccard_of_nothing(spark):
    assert jaccard.join(docs_of(spark, [])).count() == 0
    docs = docs_of(spark, [(3, prose(random.Random(1), 50)), (1, prose(random.Random(1), 50)), (2, None), (None, None)]).withColumn("later_id", F.lit(1))
    assert sorted(str(r["doc_id"]) for r in jaccard.first_of_each(docs).collect()) == ["1", "2", "None"]


def test_one_row_of_each_group_is_left(spark):
    rng = random.Random(7)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(5, a), (4, a + " end"), (4, a + " end"), (5, a), (7, b), (7, b), (7, c), (None, d), (None, d), (None, d + " end"), (None, c), (None, None), (None, " "), (8, None), (8, None)]
    docs = docs_of(spark, rows, "doc_id long, text string").withColumn("row_key", F.lit("x"))
    out = jaccard.first_of_each(docs)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns
    assert sum(t in (d, d + " end") for _, t in got) == 1
    assert sorted((x for x in got if x[1] not in (d, d + " end")), key=str) == sorted([(4, a + " end"), (7, b), (7, c), (None, None), (None, " "), (8, None)], key=str)


def test_similar_sets_share_an_indexed_signature():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 5, 9, 20, 64, 150, 700):
        bands = jaccard.Bands(80)
        for _ in range(60):
            s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            t = s.copy()
            for _ in range(rng.integers(0, n // 4 + 2)):
                u = np.delete(t, rng.integers(len(t))) if rng.random() < 0.5 and len(t) > 1 else np.append(t, rng.integers(0, 2**63, 1, dtype=np.uint64))
                if 100 * len(np.intersect1d(s, u)) >= 80 * len(np.union1d(s, u)):
                    t = np.unique(u)
            kept = [set(np.concatenate([np.sort(g)[: len(g) - k] for g, k in jaccard.signatures(x, bands)]).tolist()) for x in (s, t)]
            assert kept[0] & kept[1]
            assert (jaccard.distances(jaccard.sketch(s), len(s), [jaccard.sketch(t)], np.array([len(t)]), 80) < jaccard.FAR).all()


def test_shingle_sets_equal_words():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB é\n\t") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "x" * 700_000, "a b c d e f"]
    sets = list(textarrays.shingle_sets(pa.array(texts)))
    want = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert all((set(sets[i].tolist()) == set(sets[j].tolist())) == (want[i] == want[j]) for i in range(60) for j in range(60))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7), (200, 201), (200, 201)]
    for most in (0, 500_000):
        got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
        assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((50, 60, 100), 50) | dict.fromkeys((200, 201), 200)


# 10

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = ["", None, "a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 001.2.255.0256 300.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112", "+49 (170) 1234-567. +1+22 333 444 555", "a" * 50_000 + "@x.yy", "a." * 20_000, "1." * 20_000, "1 " * 20_000, "é€😀 a@b.co 😀 1.2.3.4"]
    texts += ["".join(rng.choice("ab@@..1234567890 -+()é") for _ in range(rng.randint(1, 120))) for _ in range(1000)]
    docs_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    assert [got[i] == hashlib.sha256(brute_pii(t or "").encode()).hexdigest() for i, t in enumerate(texts)] == [True] * len(texts)


def test_pii_scores_and_redacts(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00, mail a@b.co"), (2, "order DE89 3704 0044 0532 0130 01"), (3, None), (4, "version 1.2.3.4"), (5, "server 1.2.3.4")]
    docs = docs_of(spark, rows).withColumn("pii_text", F.lit(1))
    got = {r["doc_id"]: [(s["kind"], round(s["score"], 2)) for s in r["found"]] for r in pii.find(docs, into="found").collect()}
    assert got == {1: [("iban", 1.0), ("email", 1.0)], 2: [], 3: [], 4: [("ip", 0.3)], 5: [("ip", 0.8)]}
    keys = [(1, 'token = "04dbebab91ab85687d33"'), (2, "04dbebab91ab85687d33"), (3, "a test token 04dbebab91ab85687d33"), (4, "token abcdefghijklmnopqrstuv"), (5, "bearer: " + "a1-" * 30_000)]
    found = pii.find(docs_of(spark, keys).withColumn("pii", F.lit("own"))).withColumn("n", F.size(pii.certain(F.col("_pii")))).orderBy("doc_id").collect()
    assert [(r["n"], r["pii"]) for r in found] == [(1, "own"), (0, "own"), (0, "own"), (0, "own"), (1, "own")]
    assert pii.find(docs.limit(0)).count() == 0
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["IBAN <iban>, mail <email>", rows[1][1], None, rows[3][1], "server <ip>"]
