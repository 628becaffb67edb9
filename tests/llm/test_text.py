"""Page text, personal data and license scans against plain versions."""

from __future__ import annotations

import hashlib
import html
import re

from hypothesis import given, settings, strategies as st

from conftest import SF
from tallyframe.llm import licenses, page_text, personal_data


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in page_text.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def page(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_shared_lines_go(spark):
    """Pages without marked articles: the neighbours on the host show what is the site's."""
    site = ("Home | News", "Subscribe now"), ("All rights reserved",)
    rows = [(i, f"http://h.example/a/{i}", page(*site[0], f"Article number {i} is about {i * 7}", f"More of {i}", *site[1])) for i in range(5)]
    rows += [(9, "http://other.example/a/1", page("Home | News", "Alone here")), (10, None, None), (11, "", ""), (None, "x", "plain text"),
             (0, *rows[0][1:])]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, key string")
    got = sorted(((r.page_id, r.text) for r in page_text.extract(pages).collect()), key=str)
    want = [(i, f"Article number {i} is about {i * 7}\n\nMore of {i}") for i in (0, 0, 1, 2, 3, 4)]
    want += [(9, "Home | News\n\nAlone here"), (10, ""), (11, ""), (None, "plain text")]
    assert got == sorted(want, key=str)
    assert page_text.extract(pages.limit(0)).count() == 0


def marked(article, *outside):
    return f"<html><body><div>Home | News</div><article><p>{article}</p></article>" + "".join(f"<div>{x}</div>" for x in outside) + "</body></html>"


def texts_of(spark, rows):
    pages = spark.createDataFrame([(i, f"http://h.example/{path}", text) for i, (path, text) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in page_text.extract(pages).orderBy("page_id").collect()]


def test_differencing_decides_on_marked_pages(spark):
    """The page's own lines outside an article element stay, lines that a neighbour has go, the element's lines stay though
    neighbours have them, and copies of a page are no neighbours to it."""
    rows = [(f"a/{i}", marked(f"Teaser {i % 2}", f"The real text of page {i}, which no element marks as the article.", "All rights reserved")) for i in range(4)]
    assert texts_of(spark, rows) == [f"Teaser {i % 2}\n\nThe real text of page {i}, which no element marks as the article." for i in range(4)]
    same = [(f"a/{i}", marked("Related items", f"The real text of page {i}, which no element marks.")) for i in range(3)]
    assert texts_of(spark, same) == [f"Related items\n\nThe real text of page {i}, which no element marks." for i in range(3)]
    # a short article amid a large template, and several copies of it under near addresses
    template = "The site says much about itself in each of its pages. " * 9
    short = [("b/1", marked("Short one", template))] * 2 + [(f"b/1?page={i}", marked("Short one", template)) for i in range(3)]
    short += [("c/2", marked("Brief two", template))]
    assert texts_of(spark, short) == ["Short one"] * 5 + ["Brief two"]


def test_copies_lose_the_site_lines(spark):
    """Pages without marked articles, three and more copies side by side: each is compared with the next other page."""
    rows = [(f"a/1?utm={i}", page("Home | News", "Article one is about gardens", "All rights reserved")) for i in range(4)]
    rows += [("a/2", page("Home | News", "Article two tells of something else entirely", "All rights reserved"))]
    assert texts_of(spark, rows) == ["Article one is about gardens"] * 4 + ["Article two tells of something else entirely"]


def test_markup():
    text = """<!doctype html><head><title>T</title><style>p > a{}</style></head><body class="no-sidebar"><header>Site</header>
      <div id="cookie-notice"><p>We use cookies</p></div>
      <div class="page with-comments"><article><header><h1>Title &amp; more</h1></header><p>One<br>two&nbsp;three<p>Four <b>bo</b>ld
      <!-- <p>not</p> --><script>if (a < b) document.write("<p>no</p>")</script><ul><li>x<li>y</ul><pre>a
      b</pre><aside>side</aside><form>f<p>g</p></form><div class='ad-box'>buy</div><section class="comments"><article>reader</article></section></article></div>
      <footer>foot</footer></body>"""
    assert page_text.page_lines(text)[0] == ["Title & more", "One two three", "Four bold", "x", "y", "a b"]
    assert page_text.page_lines("<p>open <p>ended <a title='>'>link</a> <")[0] == ["open", "ended link <"]


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_common_is_a_longest_subsequence(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    kept = [x for x, k in zip(a, page_text.common(a, b)) if k]
    rest = iter(b)
    assert all(x in rest for x in kept)
    assert len(kept) == row[-1][-1]


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="a0179.@-+ (_%", max_size=40))
def test_base_spans(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_personal_data(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    field = personal_data.train(docs)
    rows = {r.doc_id: r for r in personal_data.find(docs, field).collect()}
    for r in docs.collect():
        base, g = plain_spans(r.text), rows[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        spans = [x for x in g.spans.split(",") if x]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans) and len(spans) == len(base) + g.n_added
    got = personal_data.find(odd, field).collect()
    assert len(got) == odd.count() and all(not r.spans for r in got if r.doc_id in (1, 2, 3))
    assert personal_data.find(nothing).count() == 0


def test_skip_links_spread_labels(spark):
    """A token whose own place says little is labelled as its equals elsewhere in the document."""
    field = personal_data.Field.fit([])
    field.same = 3.0
    text = "key=zz9 a b c zz9 d"
    t = personal_data.Tokens(text)
    t.words = ["zz9", "zz9"]
    strong = personal_data.LABELS.index("secret")
    field.unary[t.features[0], strong] = 1.0
    for f in set(t.features[1]) & set(t.features[0]):
        field.unary[f, strong] = 0.0
    linked = field.beliefs(t)[1, strong]
    t.words = ["zz9", "other"]
    assert linked > 0.5 > field.beliefs(t)[1, strong]


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(found)


def test_license_base(corpus, odd, nothing):
    for docs in (corpus, odd):
        got = sorted((str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.scan(docs).collect()))
        want = []
        for r in docs.select("doc_id", "text").collect():
            n, f = plain_license(r.text or "")
            want.append(str((r.doc_id, n, len(f), f[0][0] if f else None, f[-1][0] if f else None, ",".join(sorted({x for _, x in f})))))
        assert got == sorted(want)
    assert licenses.scan(nothing).count() == 0


def test_templates():
    def labels(text):
        words = licenses.words_of(text.encode())
        return {x for *_, x in licenses.template_places(words, [licenses.compile_template(*t) for t in licenses.TEMPLATES])}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("Licensed under the Apache License, 2.0") == {"apache-2.0"}
    assert labels("Licensed under an Apache License, Version 2.0.") == set()
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert labels("Licensed under CC BY-NC 4.0. Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License") == {"cc-by-nc-4.0"}
    assert labels("Released under the MIT License. Distributed under the terms of the MIT license") == {"mit-notice"}
    own = "Permission is hereby granted, free of charge, to any person obtaining a copy of this font software and associated documentation files (the \"Font\"), " \
          "to deal in the Font without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    assert labels(own) == {"mit-text"}
    assert labels(own.replace("free of charge", "free")) == set()
    a = licenses.compile_template("x", "b", "a [b [c]] (d|e f) {2} g")
    for text, end in (("a d z g", 4), ("a b c e f z z g", 8), ("a b d z z z g", None), ("a c d z g", None), ("a d g", None)):
        assert a.match([w.encode() for w in text.split()], 0) == end


def test_field_learns_from_distinct_texts(spark, monkeypatch):
    texts = ["call +1 555 123 4567"] * 30 + [f"a{i}@b.example is one" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(personal_data.Field, "fit", staticmethod(lambda samples, steps=0: samples))
    for most, want in ((5, 5), (100, 21)):
        assert len(personal_data.train(docs, most)) == want
    assert sum("555" in s[3] for s in personal_data.train(docs, 100)) == 1
