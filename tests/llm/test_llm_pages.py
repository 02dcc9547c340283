"""HTML extraction, infilling and collocations against plain versions."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from edges import edge_documents, no_documents, prose

from hearthgrid.llm import collocations, html_text, infill, word_index
from hearthgrid.llm.markup import Tree

WORDS = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore. "


def given_text(page):
    """The article of a page of the given tables, whose layout is known, by regular expressions."""
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group() == "<br>" else "", b)).split())
              for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages_yield_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == given_text(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].url == r.url


@pytest.mark.parametrize("page,want", [
    ("", ""), (" \n ", ""), ("<p>unfinished <b", "unfinished"), ("a &lt; b &amp; c&#8212;d &nope;", "a < b & c—d &nope;"),
    ("<p>one<!-- two -->  \n three<br>four</p>", "one three four"), ("<p>one<p>two<script>var a = '<p>';</script>", "one\n\ntwo"),
    ("<<< 1 < 2 >>>", "<<< 1 < 2 >>>"), ("<article><h1>T</h1><p>x</article><div>A notice without a name, of some length</div>", "T\n\nx"),
    ("<p>kept</p><div style='display: none'>gone</div><div hidden>gone</div>", "kept"),
    (f"<article><header><h1>T</h1><p>by A</p></header><p>{WORDS}</p><div class='ad-box'>Buy</div><footer>tags</footer></article>",
     f"T\n\n{WORDS.strip()}"),
    (f"<body class='has-sidebar'><form><nav><a href=x>m</a></nav><h1>T</h1><p>{WORDS}</p></form>", f"T\n\n{WORDS.strip()}"),
    (f"<div><h1>T</h1><p>{WORDS}</p></div><div><h3>2 Comments</h3><div><p>{WORDS * 4}</p></div></div>", f"T\n\n{WORDS.strip()}"),
    (f"<article><h1>T</h1><p>{WORDS}</p></article><section id='comments'><article class='comment'><h2>Re</h2><p>{WORDS * 9}</p></article>"
     "</section>", f"T\n\n{WORDS.strip()}"),
    (f"<pre><code>x = 1 <span class='comment'># one</span></code></pre><p>{WORDS}</p>", f"x = 1 # one\n\n{WORDS.strip()}")])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_unnamed_parts_go_by_density():
    menu = "<div id='m'>" + "".join(f"<a href='{i}'>Some page {i}</a> " for i in range(9)) + "</div>"
    body = "".join(f"<p>{WORDS * n}</p>" for n in (1, 3, 2))
    text = html_text.main_text(f"<div>{menu}<div><h1>Title</h1><div>{body}<p>short</p></div></div>{menu}<div>(c) 2020</div></div>")
    assert text.startswith("Title\n\nLorem") and text.endswith("\n\nshort") and "page" not in text and "2020" not in text
    page = html_text.Page(f"<div>{menu}<div>{body}</div></div>")
    outer, links, inner = 1, 2, next(i for i in range(3, page.size) if page.tree.name[i] == "div")
    assert page.density[links] < page.density[outer] < page.density[inner] and max(page.sums) == page.sums[inner]


def test_odd_pages_cost_no_more_than_their_length():
    for odd in ("<a <", "<b>", "<p><b>", "<!-", "<!--", "<li><ul>", "<x y='", "</div>", "&amp", "<div>", "<article><h1>a"):
        html_text.main_text(odd * 20_000)
    assert html_text.main_text("<div>" * 5000 + WORDS) == WORDS.strip()
    assert Tree("<ul><li>a<li>b<ul><li>c</ul></ul>").name == ["body", "ul", "li", "li", "ul", "li"]


def test_page_edges(spark):
    rows = [(1, "u", None, 1, "x"), (None, None, "<p>x", 2, None), (1, "u", "<p>" + "word " * 200_000, 3, "y"), (1, "u", "", 4, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int, _html string")
    got = sorted(html_text.extract(pages).collect(), key=lambda r: r.n_chars)
    assert [r.n_chars for r in got] == [0, 0, 1, 999_999] and got[2].page_id is None and got[0].text == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def plain_infill(key, text, seed=7, rate=100, spm_rate=50):
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 10)])
def test_infilling_equals_the_plain_version_and_goes_back(spark, rate, spm_rate):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab\né\U0001f600 <P\r") for _ in range(rng.randint(0, 50)))) for i in range(300)]
    rows += [(300, None), (300, ""), (None, "a\nb"), (301, "\n"), (302, "\n\n"), (303, "x<M>\ny"), (304, "no end"), (304, "no end"),
             (305, prose(1, 60_000).replace(" the ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = infill.restore(infill.infill(docs, rate=rate, spm_rate=spm_rate)).collect()
    want = Counter((k, *plain_infill(k, t, 7, rate, spm_rate), t or "") for k, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert len({r.form for r in got}) == 3


def test_infilling_of_slices_and_edges(spark):
    texts = pa.array(["skipped\n", "a\nb", "", None, "c\n"]).slice(1)
    draws = [pa.array([5, 1, 0, 1], pa.int64())] * 4
    n, form, *_, output = infill.transform_batch(texts, *draws, 100, 50)
    assert n.to_pylist() == [2, 0, 0, 1] and form.to_pylist() == ["spm", "plain", "plain", "spm"]
    assert infill.restore_batch(output.cast(pa.string()), form).to_pylist() == ["a\nb", "", "", "c\n"]
    assert infill.infill(edge_documents(spark)).count() == edge_documents(spark).count()
    assert infill.restore(infill.infill(no_documents(spark))).count() == 0


def plain_collocations(rows, least=30, share=80, top=2000):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        dropped = {g[i:i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
                   if 100 * a >= share * f[g[i:i + k]]}
        best = []
        for g, a in found.items():
            if g not in dropped:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,size,most", [(30, 2000, 400, 5), (4, 25, 300, 1_000_000), (5, 2000, 1_000_000, 9)])
def test_collocations_equal_the_plain_version(spark, monkeypatch, least, top, size, most):
    monkeypatch.setattr(collocations, "PENDING", 50)
    rng = random.Random(5)
    words = ["the", "The", "cat", "é", "É", "\x1c", "a\x00b", "sat", "on", "of", "x"]
    rows = [(rng.choice(["en", "fr", None, "und"]),
             " ".join(rng.choice(words[:rng.randint(2, 11)]) + rng.choice(["", "", "", "", ". ", ",", "\n", "\t", "\r\n", "?!"])
                      for _ in range(rng.randint(0, 60)))) for _ in range(250)]
    rows += [(None, None), ("en", ""), ("de", "..."), ("en", "tic tac " * 700 + "\x0b" + "tic tac toe " * 100)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top, size=size, most=most).collect())
    assert got == plain_collocations(rows, least, top=top) and len(got) > 20


def test_words_of_long_texts_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 7)
    parts = list(collocations.words_of("One two,three\tfour. FIVE\x0bsix" + "y" * 40 + " ÉA"))
    assert len(parts) > 1
    assert [w for p in parts for w in p] == [b"one", b"two", b".", b"three", b"four", b".", b"five", b".", b"six" + b"y" * 40, "Éa".encode()]


def test_collocation_edges(spark):
    docs = edge_documents(spark).withColumnRenamed("text", "body").selectExpr("*", "'en' AS lang")
    rows = [("en", r.body) for r in docs.select("body").collect()]
    got = sorted(tuple(r) for r in collocations.collocations(docs, text="body").collect())
    assert got == plain_collocations(rows) and got
    assert collocations.collocations(no_documents(spark)).count() == 0


def test_extensions_of_intervals_to_both_sides():
    import numpy as np
    rng = np.random.default_rng(2)
    ids = np.concatenate([[0], rng.integers(0, 6, 3000), [0]]).astype(np.int32)
    seen = Counter(tuple(ids[i:i + k].tolist()) for k in (2, 3, 4) for i in range(len(ids) - k + 1))
    index = word_index.WordIndex.of(ids)
    x, y, n, start, back = index.pairs()
    assert {(a, b): c for a, b, c in zip(x.tolist(), y.tolist(), n.tolist())} == {g: c for g, c in seen.items() if len(g) == 2 and 0 not in g}
    of, first, n3, start3, back3 = index.to_the_left(start, back, n)
    assert {(f, int(x[o]), int(y[o])): c for o, f, c in zip(of, first.tolist(), n3.tolist())} == \
        {g: c for g, c in seen.items() if len(g) == 3 and 0 not in g}
    of4, last, n4, _, _ = index.to_the_right(start3, back3, n3)
    assert {(int(first[o]), int(x[of[o]]), int(y[of[o]]), w): c for o, w, c in zip(of4, last.tolist(), n4.tolist())} == \
        {g: c for g, c in seen.items() if len(g) == 4 and 0 not in g}
