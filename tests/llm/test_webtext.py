"""Page templates: occurrence vectors against plain counts, planted templates, broken html, odd rows."""

import os
import random
import re
from collections import Counter
from html import unescape

import pytest
from pyspark.sql import functions as F

from seqdrift.llm import webtext as W
from seqdrift.llm.base import shipped

SCHEMA = "page_id long, url string, html string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def soup(rng, k):
    """A page without telling tags, and its article. Notice, label and advert are the template's own; menu and motto change."""
    paragraphs = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    title = prose(rng, 5)
    menu = "".join(f'<li><a href="/{k}">{prose(rng, 1)}</a></li>' for _ in range(6))
    box = '<div class="x9"><span>Keep this page</span><i>for later</i></div>'
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    remarks = '<div id="comments"><p>' + prose(rng, 30) + "</p></div>" if k % 2 else ""
    html = (f'<html><head><title>{title}</title></head><body><div class="a1"><ul>{menu}</ul></div><div class="a2">We store things. <b>Agree?</b></div>'
            f'<div class="a3"><h1>{title}</h1>{box}{body}</div>{remarks}<div class="a4">Written for you &copy; all rights</div></body></html>')  # fmt: skip
    return html, "\n".join([title, *paragraphs])


@pytest.fixture(scope="module")
def pages(spark):
    shipped(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return lambda rows, n=3: spark.createDataFrame(rows, SCHEMA).repartition(n)


def test_planted_template_without_telling_tags(pages):
    rng = random.Random(3)
    made = [soup(rng, k) for k in range(40)]
    rows = [(k, f"https://U@Soup.example:80/{k}", html) for k, (html, _) in enumerate(made)]
    got = {r.page_id: r for r in W.extract(pages(rows)).collect()}
    assert {k: got[k].text for k in got} == {k: text for k, (_, text) in enumerate(made)}
    assert all(r.n_template > 8 and r.n_chars == len(r.text) for r in got.values())


def test_many_copies_of_an_article_stay_whole(pages):
    rng = random.Random(4)
    made = [soup(rng, k) for k in range(10)] + [soup(random.Random(9), 0)] * 30
    rows = [(k, f"http://copies.example/{k}", html) for k, (html, _) in enumerate(made)]
    assert {r.page_id: r.text for r in W.extract(pages(rows)).collect()} == {k: text for k, (_, text) in enumerate(made)}


def test_vectors_equal_plain_counts(pages):
    rng = random.Random(5)
    rows = [(k, f"http://h{k % 3}.example/", soup(rng, k)[0]) for k in range(36)]
    counts = {}
    for k, url, html in rows:
        for token, n in Counter(W.Page(html).tokens).items():
            counts.setdefault((url[7:17], W._signed(token)), {})[k] = n
    want = {key: tuple(sorted(v.items())) for key, v in counts.items() if len(v) >= 3}
    got = W.occurrences(pages(rows)).collect()
    assert {(r.host, r.role) for r in got} == set(want)
    assert all(r.pages == len(want[r.host, r.role]) and r.all_pages == 12 for r in got)
    by_hash, by_vector = {}, {}
    for r in got:
        by_hash.setdefault((r.host, tuple(r.vector)), set()).add(r.role)
        by_vector.setdefault((r.host, want[r.host, r.role]), set()).add(r.role)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, by_vector.values()))


def test_classes_are_nested():
    vectors = ["a", "a", "a", "b", "b", "b", "c", "c", "c", "a", "d"]
    places = [1, 2, 9, 3.1, 3.2, 3.3, 3.15, 3.16, 8, 10, 5]
    pages = [9, 9, 9, 5, 5, 5, 4, 4, 4, 9, 9]
    piece = W.nested(vectors, pages, places)
    assert len({piece[0], piece[1], piece[2], piece[9]}) == 1 and piece[0] >= 0
    assert len({piece[3], piece[4], piece[5]}) == 1 and piece[3] >= 0
    assert piece[6] == piece[7] >= 0 and piece[8] == -1 and piece[10] == -1


CASES = {
    "<p>a &amp; b&nbsp;&lt;i&gt; &copy &#233;&#x41;</p>": "a & b <i> © éA",
    "<article><p>one<p>two<br>three<b>four</b></article><p>out": "one\ntwo threefour",
    '<script>var t="<p>no</p>";</script><p>yes': "yes",
    "<style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>": "yes",
    "<main><header><h1>T</h1></header><p>x</p><aside>no</aside><form>no</form><footer>no</footer></main>": "T\nx",
    "<header>no</header><p>x</p><nav>no</nav>": "x",
    '<article>a<div class="reader-comments"><article>no</article></div></article>': "a",
    '<div class="has-sidebar"><article><p>in a frame</p></article></div>': "in a frame",
    '<p title="a > b">x</p>': "x",
    "<p>1 < 2 & 3 > 2</p>": "1 < 2 & 3 > 2",
    "<ul><li>one<li>two <ul><li>inner</ul></ul>": "one\ntwo\ninner",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "plain  text\n only": "plain text only",
    "</p></div><p>stray</p></b>": "stray",
    '<p>cut <a href="x': "cut",
    "": "",
    "<p> \t </p>": "",
    "<TITLE>no</TITLE><P CLASS=x>Yes</P>": "Yes",
    '<article>a<div class="ad">buy</div>b</article>': "a\nb",
}


@pytest.mark.parametrize("html", CASES)
def test_single_pages(html):
    assert W.main_text(W.Page(html), {}) == CASES[html]


def test_odd_rows(pages):
    long = "<article>" + "".join(f"<p>p{i} " + "word " * 50 for i in range(20_000)) + "</article>"
    rows = [(1, None, "<p>a</p>"), (2, "", ""), (3, "no url", None), (None, "http://x.y/", "<p>b</p>"), (4, "http://x.y/", long)]
    rows += [(5, "http://x.y/", "<p>same</p>")] * 4 + [(6, "http://x.y/", "<" * 5000), (7, "http://x.y/", "<a b='" * 3000), (8, "http://x.y/", "<div>" * 3000 + "deep")]
    df = pages(rows)
    for extra in ("host", "template", "text", "n", "role", "key", "tokens", "place", "n_chars"):
        df = df.withColumn(extra, F.lit("clash"))
    got = W.extract(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == "a" and texts[2] == texts[3] == "" and texts[None] == "b" and texts[5] == "same" and texts[8] == "deep"
    assert texts[4].count("\n") == 19_999
    assert W.extract(pages([(1, "u", "h")]).limit(0)).collect() == []


def test_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    shipped(spark)
    pages = spark.read.parquet(path)
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<br>", " ")
        blocks = [" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
