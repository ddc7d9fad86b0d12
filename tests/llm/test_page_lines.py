"""Lines of pages with odd markup, and what is left of pages that share lines."""

from patchlake.llm import html_extraction
from patchlake.llm.html_extraction import ARTICLE, BOILER, OPEN, lines


def test_elements_that_are_not_closed():
    for tag in ("svg", "math", "object", "canvas", "iframe", "select", "template", "noscript"):
        for start in (f"<{tag}/>", f'<{tag} class="i"/>', f"<{tag}>"):
            assert [t for t, _ in lines(f"<p>one</p>{start}<p>two</p><p>three")] == ["one", "two", "three"], start
        assert [t for t, _ in lines(f"<p>one</p><{tag} a='b'><p>in</p></{tag} ><p>two</p>")] == ["one", "two"]
        assert [t for t, _ in lines(f"<p>one</p><{tag}-x>in</{tag}-x><p>two</p>")] == ["one", "in", "two"]
    assert [t for t, _ in lines('<p>one</p><svg class="i"/><p>two</p><svg><text>x</text></svg><p>three')] == ["one", "two", "three"]
    assert [t for t, _ in lines("<p>one<script>two<p>three")] == ["one"] and [t for t, _ in lines("<title-bar>a</title-bar><title>b</title>c")] == ["a", "c"]
    assert len(lines("<svg><p>x</p>" * 20_000)) == 20_000


def texts(spark, pages):
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    return {r.url: r.text for r in html_extraction.extracted(df, "url", "html").collect()}


def test_differencing_decides_outside_of_articles(spark):
    page = "<div>Site</div><div>body of {0}</div><div>more of {0}</div><article>teaser</article><div>Foot</div>"
    got = texts(spark, {f"http://h/{i}": page.format(i) for i in range(4)})
    assert got == {f"http://h/{i}": f"body of {i}\nmore of {i}\nteaser" for i in range(4)}


def test_names_do_not_take_the_main_part():
    text = "the text of the page " * 9
    for start, end in (("<body class='single-post no-sidebar'>", ""), ("<div class='content-with-sidebar'>", "</div>"), ("<div class='layout has-banner'>", "</div>"), ("<div class='legal-article'>", "</div>"), ("<main id=search>", "</main>"), ("<div class=comments>", "</div>")):
        assert (text.strip(), OPEN if "main" not in start else ARTICLE) in lines(f"{start}<p>{text}</p>{end}"), start
        assert lines(f"{start}<nav>menu</nav><article><p>{text}</p><div class=sidebar>s</div></article>{end}") == [("menu", BOILER), (text.strip(), ARTICLE), ("s", BOILER)], start
    page = f"<div class='cookie-notice'>ok</div><article>{text}</article><div class='comments'>{text * 9}</div><div class='related-posts'><article>r</article></div>"
    assert [z for _, z in lines(page)] == [BOILER, ARTICLE, BOILER, BOILER]
    assert [z for _, z in lines(f"<div class=legal-article>{text * 9}</div><article>teaser</article>")] == [OPEN, ARTICLE]


def test_copies_keep_their_text(spark):
    page, body = "<div>Site</div><div>{}</div><div>Foot</div>", ["text a " * 20, "text b " * 20, "text c " * 20]
    pages = {f"http://h/a?{q}": page.format(body[0]) for q in range(4)} | {"http://h/b": page.format(body[1]), "http://h/b2": page.format(body[1])}
    got = texts(spark, pages | {"http://one/a": page.format(body[2]), "http://one/b": page.format(body[2]), "http://near/a": page.format(body[2]), "http://near/b": page.format(body[2]) + "<p>at noon"})
    assert got == (
        {u: body[0 if "/a" in u else 1].strip() for u in pages} | {f"http://{x}": f"Site\n{body[2].strip()}\nFoot" for x in ("one/a", "one/b", "near/a")}
        | {"http://near/b": f"Site\n{body[2].strip()}\nFoot\nat noon"}
    )
