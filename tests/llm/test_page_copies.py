import random

import pytest

from strandweave.llm import html_extract


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def page(title, parts):
    body = "".join(f"<p>{p}</p>" for p in parts)
    return f"<body><div><p>This site uses small files.</p></div><div><h1>{title}</h1>{body}</div><div>About us</div></body>"


@pytest.mark.parametrize("copies, near, others", [(60, 1, 39), (0, 3, 3), (3, 2, 2), (0, 6, 0)])
def test_a_copied_article_is_no_template(spark, copies, near, others):
    rng = random.Random(8)
    parts = [words(rng, 12) for _ in range(6)]
    pages = [page("The article", parts)] * copies
    for i in range(near):
        changed = list(parts)
        changed[i % 6] = words(rng, 12)
        pages.append(page("The article", changed))
    pages += [page(words(rng, 3), [words(rng, 12) for _ in range(rng.randint(3, 6))]) for _ in range(others)]
    table = spark.createDataFrame([(i, f"http://h.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    for i, html in enumerate(pages):
        assert all(p in got[i] for p in html.replace("</p>", "<p>").split("<p>")[3:-1:2])
        if others >= 3:
            assert "small files" not in got[i] and "About us" not in got[i]
