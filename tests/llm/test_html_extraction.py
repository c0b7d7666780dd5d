"""The field on pages it was not trained on, and its sums against all labellings."""

import itertools
import re
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heptagrid.llm import html_extraction as x
from heptagrid.llm.common import table
from heptagrid.llm.html_blocks import blocks
from heptagrid.llm.html_training import labelled_page


@pytest.fixture(scope="module")
def model():
    return x.default_model()


def article(html):
    inside = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def test_pages(spark):
    rows = table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r for r in x.op8_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_held_out_layouts(model):
    of, right, total = x.Extractor(model), 0, 0
    for seed in range(10_000, 10_200):
        html, labels = labelled_page(seed)
        scores = [sum(model.weights.get(f, 0) for f in x.features(b)) for b in blocks(html)]
        got = x.viterbi(scores, model.chain)
        right += sum(a == y for a, (_, y) in zip(got, labels))
        total += len(labels)
        assert of(html) == "\n".join(t for a, (t, _) in zip(got, labels) if a)
    assert right / total > 0.97


def test_gradient_and_viterbi_against_all_labellings():
    rng = np.random.default_rng(0)
    scores, chain, labels = rng.normal(size=5), rng.normal(size=4), np.array([0, 1, 1, 0, 1])

    def score(y, s, c):
        move = [[0, c[1]], [c[2], c[3]]]
        return s @ y + c[0] * y[0] + sum(move[a][b] for a, b in zip(y, y[1:]))

    every = [np.array(y) for y in itertools.product((0, 1), repeat=5)]
    like = lambda s, c: score(labels, s, c) - np.logaddexp.reduce([score(y, s, c) for y in every])
    by_score, by_chain = x._gradient(scores, labels, chain)
    e = 1e-6
    for k in range(5):
        d = np.eye(5)[k] * e
        assert abs((like(scores + d, chain) - like(scores - d, chain)) / (2 * e) - by_score[k]) < 1e-5
    for k in range(4):
        d = np.eye(4)[k] * e
        assert abs((like(scores, chain + d) - like(scores, chain - d)) / (2 * e) - by_chain[k]) < 1e-5
    assert x.viterbi(scores.tolist(), tuple(chain)) == max(every, key=lambda y: score(y, scores, chain)).tolist()


def test_blocks_of_bad_markup():
    text = lambda h: [b.text for b in blocks(h)]
    assert text("<p>a<p>b &amp;&#233;&nbsp;c<br>d") == ["a", "b &é c d"]
    assert text("<ul><li>1<li>2 <b>x</b></ul>y</div><!-- no --><script>if (a<b) '</p>'</script>z") == ["1", "2 x", "y", "z"]
    assert text("<div>a <div>b</div> c") == ["a", "b", "c"]
    assert text("<p>1 < 2 <a href='>'>l</a></p><style>p{}") == ["1 < 2 l"]
    assert text("") == text(None) == text("<p> </p>") == []
    assert text("<STYLE>x</STYLE><P CLASS=a>Q</P>") == ["Q"]
    assert blocks("<div class='ad box'><p hidden>x</p></div>")[0].path == (("div", frozenset({"ad", "box"})), ("p", frozenset({"hidden"})))


def test_odd_attributes():
    text = lambda h: [b.text for b in blocks(h)]
    assert text('<p title="5" tall">Hello</p>') == ["Hello"]
    assert text('<p class="a"b">One</p>') == ["One"]
    assert text("<img alt=\"5' 10\"\">tail") == ["tail"]
    assert text("<p a='1'b=2 c = \"x>y\" =d/e>One</p>") == ["One"]
    assert text('<p title="never closed>One</p><p>Two</p>') == ["One", "Two"]
    assert text("<a href=x/>l</a> </> </3 > 1 <2 <!-->a<!--->b<!-- c --!>d<!DOCTYPE x>e") == ["l 1 <2 abde"]
    assert blocks("<a href=x/>link</a>")[0].linked == 4
    assert blocks("<p title='class=x' data-id=y CLASS = z id=w>t</p>")[0].path == (("p", frozenset({"z", "w"})),)
    assert text("<math><mi>x</mi></math> and <object>see<p>this") == ["x and see", "this"]
    assert text("<p>a</p><scripty>b</scripty><script>c</scripts>d</script >e<style>f") == ["a", "be"]
    assert len(text("<p " + "a='" * 20000 + ">t")) <= 1 and text("<p " + "a=b " * 20000 + ">t") == ["t"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p", "<div", "</p", "</div>", "<a href", "<b/>", " ", ">", "/", "=", '"', "'", "class", "x y", "<!--", "-->", "<!x", "word", "<script", "</script>"]), max_size=40))
def test_no_markup_in_any_text(parts):
    for b in blocks("".join(parts)):
        assert not re.search(r"</?[a-zA-Z]|<[!?]", b.text), (parts, b.text)


def test_words_that_tell_are_found_anywhere(model):
    n = 400
    plain = " ".join(["word"] * n)
    says = lambda t: {f for f in x.text_features(blocks(f"<p>{t}</p>")[0]) if f.startswith(("says", "mentions"))}
    assert says(plain) == set() and says(plain + " privacy") == {"mentions privacy"} and says("Our privacy") == {"says privacy"}
    dense = " ".join("cookie" if k % 20 == 0 else "word" for k in range(100, n))
    assert says(plain[:200] + dense) == {"says cookie"}


def test_odd_rows(spark, model):
    page = "<article><h1>T</h1><p>One two three four.</p></article><section class='comments'><p>Nice article, thanks for it.</p></section>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", page), (3, "u", page), (None, "u", page), (4, "u", "<article>" + "<p>Words and more words.</p>" * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("id", "text", "n_chars")})
    got = sorted(x.extract(pages, model).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [r.text for r in got[:3]] == ["T\nOne two three four.", "", ""]
    assert [r.text for r in got[3:5]] == ["T\nOne two three four."] * 2
    assert got[5].text.count("\n") == 29999
    assert x.extract(pages.limit(0), model).count() == 0
