import random
import resource
import time

import numpy as np

from pyspark.sql import functions as F

from strandweave.llm import html_extract, html_tree


def test_deep_trees_are_aligned_to_the_bottom():
    page = html_tree.Page("<div>" * 3000 + "<p>x</p>")
    tree = html_tree.Tree(page.skeleton())
    assert html_tree.align(page, tree) == {i: i for i in range(3002)}


def test_a_text_on_few_pages_is_template_if_its_slot_is_as_rare(spark):
    rng = random.Random(11)
    pages = []
    for i in range(40):
        body = "".join(f"<p>{rng.random()} text {i}</p>" for _ in range(4))
        pages.append(f"<body><div><h1>Title {i}</h1>{body}</div>" + ("<section>Ask the team</section>" if i % 4 == 0 else "") + "</body>")
    table = spark.createDataFrame([(i, "http://h.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    low, high = table.agg(F.min_by("html", F.xxhash64("html")), F.max_by("html", F.xxhash64("html"))).first()
    assert "Ask the team" in low + high  # a reference has the slot
    for r in html_extract.main_text(table).collect():
        assert "Ask the team" not in r.text and f"Title {r.page_id}" in r.text and r.text.count("\n\n") == 4


def test_deep_boilerplate_is_template(spark):
    rows = [(i, "http://h.com/", "<div>" * 60 + f"<p>About us</p><p>{i} and {i * i} are the numbers of this page</p>") for i in range(6)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"{r.page_id} and {r.page_id ** 2} are the numbers of this page" for r in got)


def test_long_lists_are_aligned_within_seconds():
    """Two pages of 20,000 entries each: equal ones, two shapes at random, and many different shapes."""
    rng = random.Random(3)
    row = ["<div><p>a</p></div>", "<div><b>a</b><i>b</i></div>"]
    for a, b in ((row[:1], row[:1]), (row, row)):
        pages = [html_tree.Page("".join(rng.choice(p) for _ in range(20_000))) for p in (a, b)]
        trees = [html_tree.Tree(p.skeleton()) for p in pages]
        start, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        found = html_tree.align(pages[0], trees[1])
        assert time.time() - start < 60
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
        assert len(found) >= 20_000


def test_halving_finds_as_much(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        n, m, k = rng.randint(1, 30), rng.randint(1, 30), rng.randint(1, 5)
        weight = np.array([[rng.randrange(4) for _ in range(k)] for _ in range(k)])
        xs, ys = np.array([rng.randrange(k) for _ in range(n)]), np.array([rng.randrange(k) for _ in range(m)])
        whole = html_tree._matches(weight, xs, ys)
        monkeypatch.setattr(html_tree, "_CELLS", 4)
        halved = html_tree._matches(weight, xs, ys)
        monkeypatch.undo()
        total = lambda pairs: sum(weight[xs[i], ys[j]] for i, j in pairs)
        few, _ = html_tree._few(xs.tolist(), ys.tolist(), lambda x, y: int(weight[x, y]))
        assert total(whole) == total(halved) == html_tree._last_row(weight, xs, ys)[-1] == few
        assert all(i < k and j < m for (i, j), (k, m) in zip(sorted(halved), sorted(halved)[1:]))
