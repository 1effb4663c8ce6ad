import html as h
import re

from quandrel.llm.html_text import extract, main_text

DATA = "/root/testdata/sf0.001"


def by_hand(page):
    """The article of a page of the test table, whose layout is known."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return "\n\n".join(t for t in (" ".join(h.unescape(b).split()) for b in blocks) if t)


def test_equals_the_known_layout(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: by_hand(r.html) for r in pages.collect()}
    got = extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_parts_that_are_not_the_article():
    long = "It was the best of the times and it was the worst of the times, as they said in the book that we have read."
    page = f"""<body class="has-sidebar"><header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>{long}</p><p>Short.</p><form>mail <input></form><aside>Also read</aside>
    <div class="ad">Buy the best of the best now, it is for you and for all of us</div><script>var a = "<p>no</p>";</script>
    <section class="comments"><article class="comment"><p>{long} first!</p></article></section><p>End&nbsp;of
    it</p></article></main><footer>&copy; us</footer></body>"""
    assert main_text(page) == f"Title & more\n\n{long}\n\nShort.\n\nEnd of it"


def test_pages_without_an_article_go_by_density():
    long = "It was the best of the times and it was the worst of the times, as they said in the book that we have read."
    links = "".join(f"<li><a href=/{i}>Item number {i} of the list</a></li>" for i in range(9))
    page = f"<div><ul>{links}</ul></div><div><h2>Head</h2><p>{long}<p>Tiny.<p>{long}</div><div><a href=x>privacy</a></div>"
    assert main_text(page) == f"Head\n\n{long}\n\nTiny.\n\n{long}"


def test_odd_input(spark):
    assert [main_text(x) for x in (None, "", "<", "<p", "<!-- <p>x", "<article><p>a<b>b")] == ["", "", "", "", "", "ab"]
    rows = spark.createDataFrame([(1, None, "x", 7), (1, "<p>A &lt; B</p>" * 2, "y", 8)], "page_id long, html string, text string, extra int")
    assert sorted((r.page_id, r.text, r.n_chars, r.extra) for r in extract(rows).collect()) == [(1, "", 0, 7), (1, "A < B\n\nA < B", 12, 8)]
    assert extract(rows.limit(0)).count() == 0
