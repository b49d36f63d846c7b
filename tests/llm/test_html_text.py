import html
import re

from meshframe.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div id="cookieNotice">We use cookies.</div>{start}<h1>Head &amp; line</h1>
<p>A first paragraph,   with <b>bold</b> and<br>a break, which is long enough to be text of an article.</p><p>To.
<p>Unclosed &lt;p&gt; with caf&eacute; &#8212; and more words to make the line long enough for the ratio.<div class="ad">Buy now!</div>
<ul><li>One point of the list<li>Two points</ul>{end}<section class="comments"><p>I think this is a great article, thanks a lot for writing it, really.</p></section>
<aside><p>Also see this other story of ours, which is long enough to be text.</p></aside><form><label>Mail</label><p>Join the list of readers today.</p></form>
<script>var x = "</p><p>no</p>";</script><footer>&copy; site</footer></body></html>"""
WANT = ["Head & line", "A first paragraph, with bold and a break, which is long enough to be text of an article.", "To.", "Unclosed <p> with café — and more words to make the line long enough for the ratio.", "One point of the list", "Two points"]


def test_article_of_a_page():
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ('<div id="content"><div class="text">', "</div></div>")):
        assert h.main_text(PAGE.replace("{start}", start).replace("{end}", end)).split("\n\n") == WANT


def test_odd_markup():
    assert h.main_text("") == h.main_text("<p> </p>") == h.main_text("<script>x</script>") == ""
    assert h.main_text("just text &amp") == "just text &"
    assert h.main_text("<article><p>a<p>b</i></b><p>b</article") == "a\n\nb\n\nb"
    assert h.main_text("<div><p>" + "word " * 50_000 + "</p></div>") == ("word " * 50_000).strip()
    h.main_text("<" * 500 + "<p>" * 3000 + "</div>" * 50 + "<!-- x")


LONG = "These words are the running text of the page and go on for a while, so that the line is a long one."
TEASER = "<div class='t'><a href=x>Read</a><p>Another story of ours.</p><a href=y>More</a></div>"
PARTS = f"<body><div id=a>{TEASER}</div><div id=b><div class=x><h1>Title</h1></div><div class=x><div class=s><p>{LONG} 1</p><p>{LONG} 2</p></div><h2>A</h2><h3>B</h3><div class=s><p>{LONG} 3</p><p>{LONG} 4</p></div></div></div><div id=c>{TEASER * 6}<p>{LONG} of others</p></div></body>"
PARTS_WANT = ["Title", f"{LONG} 1", f"{LONG} 2", "A", "B", f"{LONG} 3", f"{LONG} 4"]


def test_clusters_find_the_article_without_names():
    assert h.main_text(PARTS).split("\n\n") == PARTS_WANT


def test_without_clusters_or_smoothing_the_article_is_missed(monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(h, "clusters", lambda ratios: [(0, len(ratios))])
        assert h.main_text(PARTS).split("\n\n") != PARTS_WANT
    with monkeypatch.context() as m:
        m.setattr(h, "smoothed", lambda ratios: ratios)
        assert h.main_text(PARTS).split("\n\n") != PARTS_WANT


def test_nothing_of_the_article_is_lost():
    page = f"<body><article><h1>T</h1><p>{LONG}</p><svg viewBox=x /><p>after svg</p><svg><g/><text>no</text></svg><p><label>no</p><p>after label</p><p class='related'>a paragraph</p><p class='search-results-intro'>another</p><p><a href=x>one link only</a></p></article></body>"
    want = ["T", LONG, "after svg", "after label", "a paragraph", "another", "one link only"]
    assert h.main_text(page).split("\n\n") == want
    assert h.main_text(page.replace("article>", "div>")).split("\n\n") == want
    wrapped = f"<body><div class='page with-sidebar comments-on'><div class='sidebar'><p>{LONG} side</p></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></div></body>"
    assert h.main_text(wrapped).split("\n\n") == ["T", LONG, LONG]
    assert h.main_text(f"<head><title>x<p>{LONG}") == LONG


def test_deep_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    spent = []
    for n in (4_000, 16_000):
        page = "<div>word and more words " * n
        tracemalloc.start()
        began = time.process_time()
        assert len(h.main_text(page).split("\n\n")) == n
        spent.append((time.process_time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert spent[1][0] < 8 * spent[0][0] + 1 and spent[1][1] < 6 * spent[0][1]


def plain(page):
    """What the synthetic pages are built from: the blocks of their article, by pattern."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_against_patterns(spark):
    from tests.conftest import SF

    got = {r.page_id: r for r in h.op5_html(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "<p>a</p>", None), (2, "<p>a</p>", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in h.extract(df).collect()) == ["", "", "a", "a"]
    assert h.extract(df.limit(0)).count() == 0
