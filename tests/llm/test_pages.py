import random
import time
from collections import Counter

from strandweave.llm import html_extract, html_tree, url_filter

URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/x?q=/de/", "http://example.net/en",
    "http://example.net/en/", "https://m.example.com/de/1#/en/", "https://example.com/de", "https://example.org/fr/", "http://notorg/fr/",
    "http://org/fr/a/b//c", "http://x.net:80/", "http://.net/", "http://net/", "a://b://c.net/d", "http://ex.net\n/en/", "http://a.b.c.d.net/" + "x/" * 300,
]


def plain(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def test_verdicts_against_a_plain_scan(spark):
    rules = [*url_filter.RULES, ("b.c.d.net", "/x/x", "allow"), ("net", "", "allow"), ("Example.com", "/d", "block"), (None, "/", "block"), ("org", "/fr/", "block")]
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(URLS)] + [(None, URLS[5], "c", "c", "c")] * 2,
                                  "page_id long, url string, host string, path string, short string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    expect = Counter()
    for i, url in [*enumerate(URLS), (None, URLS[5]), (None, URLS[5])]:
        host, path = plain(url)
        fits = []
        for h, p, v in rules:
            if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p) and host:
                fits.append((len(h + p), len(h), h.lower() + p, v))
        best = max(fits, default=(0, 0, None, "allow"))
        expect[i, host, path, best[2], best[3]] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expect


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(empty, url_filter.default_rules(spark)).collect() == []
    assert html_extract.main_text(empty).collect() == []


def text_of(html):
    return html_extract.extract(html, [], set())


def test_blocks():
    assert text_of(None) == text_of("") == text_of("<p></p>") == ""
    assert text_of("<article><h1>A &amp; b</h1>x <b>y\n z</b><p>One<p>Two<br>2</article>") == "A & b\n\nx y z\n\nOne\n\nTwo 2"
    assert text_of("<nav>n</nav><header>h</header><div class='side-bar ad'>a</div><p>t</p><footer>f</footer>") == "t"
    assert text_of("<article><header><h1>T</h1></header><p>x</p><section id=comments><p>c</p></section></article><p>out</p>") == "T\n\nx"
    assert text_of("<p>a<script>if (a<b) '</p>'</script>b<style>p{}</style><!-- <p>c --><form>f</form></p>") == "a b"
    assert text_of("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table><div hidden>h</div><p style='display: none'>i") == "1\n\n2\n\n3\n\n4"
    assert text_of("<ul><li><a href=x>menu</a></li></ul><p>see <a href=y>this</a> page</p>") == "see this page"
    assert text_of("a < b <p title='>'>c <") == "a < b\n\nc <"


def test_long_urls_cost_what_their_rules_do(spark):
    """A path of 100,000 slashes and a host of 50,000 labels are expanded no deeper than the rules."""
    rows = [(1, "http://a.org/fr/" + "x/" * 100_000), (2, "http://" + "a." * 50_000 + "example.com/de/" + "/" * 1000), (3, "http://a.org/f" + "/" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.default_rules(spark)).collect()}
    assert got == {1: ("org/fr/", "allow"), 2: ("example.com/de/", "block"), 3: (None, "allow")}
    assert time.time() - start < 30


def test_long_and_broken_pages_end():
    for piece in ("<div>", "<b>", '<a href="', "<!", "<svg>", "<li>", "<p>x ", "<a '", "<!--"):
        text_of(piece * 20_000)


def brute_match(a, b, page, seed):
    if page.tags[a] != seed.tags[b]:
        return 0
    m = [[0] * (len(seed.kids[b]) + 1) for _ in range(len(page.kids[a]) + 1)]
    for i, x in enumerate(page.kids[a]):
        for j, y in enumerate(seed.kids[b]):
            m[i + 1][j + 1] = max(m[i + 1][j], m[i][j + 1], m[i][j] + brute_match(x, y, page, seed))
    return m[-1][-1] + 1


def test_alignment_is_the_largest():
    rng = random.Random(6)

    def tree():
        parts = ["#page:0"]
        for i in range(1, rng.randint(2, 12)):
            parts.append(f"{rng.choice(['p', 'div', 'li'])}:{rng.randrange(i)}")
        return html_tree.Tree(" ".join(parts))

    for _ in range(300):
        a, b = tree(), tree()
        found = html_tree.align(a, b)
        assert len(found) == brute_match(0, 0, a, b)
        assert all(a.tags[x] == b.tags[y] for x, y in found.items())
        assert len(set(found.values())) == len(found)


def test_templates_of_hosts(spark):
    rng = random.Random(7)

    def page(i, notice="We use small files. Read more."):
        body = "".join(f"<p>{rng.random()} text {i}</p>" for _ in range(rng.randint(1, 6)))
        return f"<body><div><p>{notice}</p></div><div><h1>Title {i}</h1>{body}</div><div>About us</div></body>"

    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(12)]
    rows += [(20, "http://h.com/20", rows[0][2]), (21, "http://h.com/21", rows[0][2])]  # copies of a page
    rows += [(30, "http://few.com/1", page(30)), (31, None, None), (None, "", "<p>x</p>"), (33, "http://one.com/", "<p>Same</p>")]
    rows += [(40 + i, f"http://copies.com/{i}", "<p>All the same</p>") for i in range(5)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, h string")
    got = {r.page_id: r for r in html_extract.main_text(table).collect()}
    assert len(got) == len(rows)
    for i in (*range(12), 20, 21):
        assert "small files" not in got[i].text and "About us" not in got[i].text and "Title" in got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert "small files" in got[30].text  # one page shows no template
    assert got[31].text == "" and got[None].text == "x" and got[33].text == "Same"
    assert all(got[40 + i].text == "All the same" for i in range(5))
