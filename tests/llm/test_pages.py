"""Main texts of web pages: marked articles, sites without marks, copies, odd and broken markup."""

import random

import pytest

from tessera.llm import dom, extraction

SCHEMA = "page_id long, url string, html string, key string, host string, at int"


def said(rng, n):
    return " ".join("".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def soup(rng, i, paragraphs, latest):
    """A page of a site that marks nothing: the same frame on each, an article of its own within."""
    menu = "".join(f"<span>{t}</span> | " for t in ("Start", "World", "Sport", "Money"))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><body><div>{menu}</div><div><div>Welcome to our lovely pages, we hope you like it here.</div><div><h2>Title {i}</h2>{body}</div><div>Latest: {latest}</div></div><div>All rights are ours since 1999. Do not copy.</div></body></html>"


def texts_of(spark, rows):
    df = spark.createDataFrame([(*r, "k", "h", 1) for r in rows], SCHEMA).repartition(3)
    return {r.page_id: r for r in extraction.main_texts(df).collect()}


@pytest.mark.parametrize("many", [False, True])
def test_site_without_marks(spark, monkeypatch, many):
    if many:  # nodes that go are not broadcast
        monkeypatch.setattr(extraction, "bounded", lambda df: df)
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(30):
        paragraphs = [said(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
        if i % 5 == 0:
            paragraphs.insert(1, "A passage that one page in five of this site has, word for word.")
        rows.append((i, f"https://soup.example.org/{i}", soup(rng, i, paragraphs, "nothing new today")))
        want[i] = "\n\n".join([f"Title {i}", *paragraphs])
    rows += [(100 + k, f"https://soup.example.org/again/{k}", rows[7][2]) for k in range(60)]  # copies of one article
    want |= {100 + k: want[7] for k in range(60)}
    got = texts_of(spark, rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_copies_are_no_template(spark):
    rng = random.Random(4)
    paragraphs = [said(rng, 30) for _ in range(5)]
    rows = [(i, "http://c.example.org/", f"<body><article><h1>Head</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>Copy number {i}.</p></article></body>") for i in range(12)]
    for i, r in texts_of(spark, rows).items():
        assert r.text == "\n\n".join(["Head", *paragraphs, f"Copy number {i}."])


def test_marks(spark):
    page = """<!doctype html><HTML><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head>
    <body class="has-sidebar"><header><a href=/>Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div id="cookie-notice">We use cookies</div><!-- <p>hidden</p> --><main><h1>The &lt;title&gt;</h1>
    <article class="post with-comments"><header><h2>Sub&amp;head</h2></header><p>First <b>bold<i>er</b></i> text&nbsp;here,<br>next line
    <p>Second   one &copy; a < b &amp;amp; <span class="ad">BUY</span>end<script>x()</script>
    <div class="share-bar">Tweet this</div><aside>Side</aside><form><input value=1>Mail <button>Go</button></form>
    <ul><li>item one<li>item <a href="x">two</a></ul><table><tr><td>c1<td>c2</table>
    <blockquote>Quoted</blockquote><pre> a
      b </pre><section class="comments"><h3>3 Comments</h3><p>I liked it</p></section>
    <footer>Filed under</footer></article>
    <section><h2>Comments (2)</h2><div><p>nice</p></div></section><article class="comment">Me too</article></main>
    <div class="sidebar"><p>More</p></div><footer>&copy; us</footer>"""
    odd = {
        1: page, 2: None, 3: "", 4: "just text &amp; no tags", 5: "<p>open <b>and never", 6: "<div" * 3000, 7: "<div>" * 5000 + "deep" + "</div>" * 5000,
        8: "<p>a</p><!-- never closed <p>b</p>", 9: "<script>only();</script><nav>m</nav>", 10: "<p>1 < 2 <3 </></p>x</p><a href='q>z", 11: "<article></article><p>outside</p>",
        12: "<body><form action=/><div><h1>Wrapped</h1><p>All of it in a form.</p><p>More of the same.</p></div></form></body>",
    }
    rows = [(i, "http://x.example.org/" if i != 3 else None, h) for i, h in odd.items()] + [(1, "no url", page), (None, None, page)]
    df = spark.createDataFrame([(*r, "k", "h", 1) for r in rows], SCHEMA)
    found = extraction.main_texts(df).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r.text for r in found}
    blocks = ["The <title>", "Sub&head", "First bolder text here, next line", "Second one © a < b &amp; end", "item one", "item two", "c1", "c2", "Quoted", "a b"]
    assert got[1] == got[None] == "\n\n".join(blocks)
    assert [got[i] for i in (2, 3, 9)] == ["", "", ""]
    assert got[4] == "just text & no tags" and got[5] == "open and never" and got[7] == "deep" and got[8] == "a"
    assert got[10] == "1 < 2 <3\n\nx" and got[11] == "outside"
    assert got[12] == "Wrapped\n\nAll of it in a form.\n\nMore of the same."


def test_empty_table(spark):
    assert extraction.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_page(spark):
    page = "<article>" + "".join(f"<p>Paragraph {i} <a href='/{i}'>with</a> words</p>" for i in range(40_000)) + "</article>"
    (row,) = texts_of(spark, [(1, "http://l.example.org", page)]).values()
    assert row.text.count("\n\n") == 39_999 and row.text.endswith("Paragraph 39999 with words")


@pytest.mark.parametrize("broken", ["<a href=\"", "<b><p>" * 2000, "<!--" * 5000, "</p>" * 5000, "<table><td>" * 500 + "<p>x" * 500, "<![CDATA[x]]><?php ?>y"])
def test_reader_ends(broken):
    assert dom.parse(broken).tag == ""
