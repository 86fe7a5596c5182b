import pytest

from strandweave.llm import html_extract


def text_of(html):
    return html_extract.extract(html, [], set())


@pytest.mark.parametrize("html", [
    "<body class='has-sidebar'><p>t</p></body>", "<body class='sidebar' hidden><p>t</p></body>",
    "<div class='content no-comments'><p>t</p></div>", "<article class='post comments-open'><p>t</p></article>",
    "<article class='comments'><p>t</p></article>", "<div class='search-page'><p>t</p></div>",
    "<div class='search'><p>u</p><article><p>t</p></article></div>", "<form action=x><nav>n</nav><article><p>t</p></article></form>",
    "<form id=aspnet><div>t</div></form>", "<form><p>t t t t</p></form><div>f</div>",
    "<p><a href=x>t</a></p>", "<div role=main class=widget><p>t</p></div>",
])
def test_the_text_is_not_dropped(html):
    assert text_of(html).startswith("t")


@pytest.mark.parametrize("html", [
    "<p>t</p><div class='nav'>x</div>", "<p>t</p><div id='Comments'>x</div>", "<p>t</p><form>x</form>", "<p>t</p><div role='search'>x</div>",
    "<article>t<div class=comments><article>x</article></div></article>", "<article>t</article><div class=related><article>x</article></div>",
    "<p>t<span class='ad'>x</span></p>", "<p>t</p><div class=ad><form>x</form></div>",
])
def test_boilerplate_is_dropped(html):
    assert text_of(html) == "t"


def test_formulas_stay():
    assert text_of("<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p>") == "so a=1 holds"


def test_the_template_decides_about_links(spark):
    def page(i):
        return (f"<body><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><h1>Title number {i}</h1>"
                f"<p>Some words of text {i}, and {i * 7} more of them for a paragraph.</p><ol><li><a href=c>Source {i}</a></li></ol></body>")

    table = spark.createDataFrame([(i, f"http://h.com/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    for r in html_extract.main_text(table).collect():
        i = r.page_id
        assert r.text == f"Title number {i}\n\nSome words of text {i}, and {i * 7} more of them for a paragraph.\n\nSource {i}"
