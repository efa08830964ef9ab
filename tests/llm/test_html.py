import html
import re

from helpers import as_rows
from pyspark.sql import functions as F

from salescast.llm import html as H
from salescast.llm.queries import op4_html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li>one<li>two</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><aside>side</aside>
<article><header><h1>The&nbsp;title &amp; more</h1></header><p>First <b>bold<p>Second &lt;tag&gt; a&#233;b
 line<br>broken</p><div class="ad">buy</div><ul><li>x<li>y</ul><form><p>mail</p></form>
<script>var a = "</p>";</script><!-- <p>no</p> --><section class="comments"><p>reply</p></section></article>
<article class="comment"><p>me too</p></article></div><footer>&copy; x</footer></body></html>"""
TEXT = "The title & more\nFirst bold\nSecond <tag> aéb line broken\nx\ny"


def test_article_of_a_page(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("First", "Other")), (3, None, PAGE)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"])
    assert as_rows(got) == [(1, TEXT), (2, TEXT.replace("First", "Other")), (3, TEXT)]


def test_page_without_article_tags():
    page = "<body><div class='menu'><p>Home</p></div><div id=main><div><p>" + "word " * 50 + "</p><p>end</p></div></div><div class=footer>f</div></body>"
    assert H.main_text(page, None) == " ".join(["word"] * 50) + "\nend"


def test_wrappers_are_union_free_expressions():
    pages = [
        "<body><h1>a</h1><p>x</p><p>y</p></body>",
        "<body><h1>b</h1><table><tr><td>1</td></tr></table><p>x</p></body>",
        "<body><h1>c</h1><dl><dt>k<dd>v<dt>k<dd>v<dt>k<dd>v</dl></body>",
    ]
    w = H.Wrapper()
    for p in pages:
        w.add(p)
    assert H.shown(w.units) == "body(h1(#) table(tr(td(#)))? p(#)+? dl((dt(#) dd(#))+)?)" or H.shown(w.units) == (
        "body(h1(#) dl((dt(#) dd(#))+)? table(tr(td(#)))? p(#)+?)"
    )
    one, two = H.Wrapper(), H.Wrapper()
    one.add(pages[0]), two.add(pages[1]), two.add(pages[2])
    one.merge(two)
    assert one.pages == 3 and one.mass == w.mass


def test_broken_pages():
    for page in ("", None, "<", "<p", "text only", "<p>a<", "</p></div>b", "<!-- open", "<script>x", "<p title='a>b'>c</p>"):
        assert isinstance(H.main_text(page, "/html/body/article"), str)
    assert H.main_text("text only", None) == "text only"
    assert H.main_text("<p title='a>b'>c &amp d</p>", None) == "c & d"


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op4_html(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "no url", "<p>x</p>"), (2, "http://b", ""), (3, "http://c/?", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "main": F.lit(2), "pages": F.lit(3)})
    got = H.extract(pages, ["page_id", "host", "main"]).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 999_999)]
    assert H.extract(pages.limit(0), ["page_id"]).count() == 0


def test_names_around_the_article_do_not_drop_it():
    text = "word " * 40
    for names in ("class='content with-sidebar'", "class=no-sidebar", "id=post-with-comments", "class='layout header-fixed'", "class='page sidebar'"):
        side = "<div class='sidebar'><p>side</p></div><div class=cookie-notice>cookies</div>"
        for body in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
            page = f"<body><div {names}>{side}{body}</div><p>outside</p></body>"
            assert H.main_text(page, None).split("\n")[0] == text.strip()
            assert "side\n" not in H.main_text(page, None) and "cookies" not in H.main_text(page, None)
    talk = f"<body><div class=post><p>short</p></div><div id=comments><p>{text}</p></div></body>"
    assert H.main_text(talk, None) == "short"
    main = f"<body><main><div class='row widget'><article><p>{text}</p></article></div></main><div class=related><article>x</article></div></body>"
    assert H.main_text(main, None) == text.strip()


def test_hosts_with_two_templates(spark):
    """Both have a ``content``; in the second it is a notice, and the article is the ``story``. A fixed text is no article."""
    def say(i, n):
        return " ".join(f"w{i}x{k}" for k in range(n))

    fixed = "<div class=legalese><p>" + "terms " * 300 + "</p></div>"
    pages, want = [], {}
    for i in range(40):
        text = say(i, 60)
        body = f"<div class=content><p>{text}</p></div>" if i % 4 else f"<div class=content><p>by {i}</p></div><div class=story><p>{text}</p></div>"
        pages.append((i, f"http://two.example/{i}", f"<body>{fixed}{body}</body>"))
        want[i] = text
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id"])
    assert {r.page_id: r.text for r in got.collect()} == want


def test_copies_of_one_article_keep_it():
    w = H.Wrapper()
    for i in range(5):
        w.add(f"<body><div class=date><p>{i} May</p></div><div class=text><p>{'same ' * 100}</p></div></body>")
    assert w.main() == "/body/div.text"


def test_parts_within_the_article_that_are_not_its_own():
    names = ("comment-list", "comments-area", "user-comments", "ad-slot", "cookie-bar", "sidebar-right", "newsletter-box")
    for name in names:
        page = f"<body><article><p>Main text.</p><div class='{name}'><p>other</p></div><p>More.</p></article></body>"
        assert H.main_text(page, None) == "Main text.\nMore.", name
        assert H.main_text(page.replace(f"class='{name}'", f"id={name}"), None) == "Main text.\nMore.", name
    for name in ("no-sidebar", "has-comments", "commentary", "download", "post-body", "entry-header", "content-adapter"):
        page = f"<body><article><p>Main text.</p><div class='{name}'><p>other</p></div></article></body>"
        assert H.main_text(page, None) == "Main text.\nother", name


def test_names_of_parts_around_the_article_drop_nothing():
    for name in ("sidebar-right", "comments-area", "ad-wrapper"):
        page = f"<body><div class='{name}'><article><p>Main text.</p></article></div></body>"
        assert H.main_text(page, None) == "Main text."


def test_columns_of_a_grid_are_told_apart(spark):
    words = "one two three four five six seven eight nine ten".split()
    pages = [
        (i, f"http://g.example/{i}", f"<body><div class='col-8'><p>{w} article {'text ' * 40}{w}</p><p>{w} end {w * 30}</p></div>"
         f"<div class='col-4'><p>see {w}</p><p>and {w}</p></div></body>")
        for i, w in enumerate(words)
    ]
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id"])
    assert all("see" not in text and "article" in text and "end" in text for _, text in as_rows(got))
    assert H.describe("div", " class='col-8 post-12345'")[0] == "div.col-8.post"


def test_deeply_nested_pages(spark):
    def nested(n):
        return "<body><article>" + "<div>a" * n + "<p>middle" + "</div>b" * n + "</article></body>"

    want = lambda n: "\n".join(["a"] * n + ["middle"] + ["b"] * n)
    for n in (3, H.DEPTH - 3, H.DEPTH, H.DEPTH + 1, 1200, 5000):
        assert H.main_text(nested(n), None) == want(n), n
    page = "<body><article>" + "<div>" * 900 + "<p>kept</p><nav><div><p>menu</p></div></nav><ul><li>x<li>y</ul>end" + "</div>" * 900
    assert H.main_text(page, None) == "kept\nx\ny\nend"
    rows = [(i, "http://deep.example/p", nested(5000 + i)) for i in range(3)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"])
    assert as_rows(got) == [(i, want(5000 + i)) for i in range(3)]
