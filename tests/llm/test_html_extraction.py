"""Page extraction on whole pages, hand-made layouts, and the cut against all labellings."""

import html
import itertools
import random
import re

from tests.conftest import MEDIUM


def test_cut_is_minimal():
    from tracewell.llm.html_extraction import minimum_cut

    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 8)
        lean = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def cost(x):
            return sum(abs(v) for v, k in zip(lean, x) if (v > 0) != k) + sum(w for a, b, w in edges if x[a] != x[b])

        assert abs(cost(minimum_cut(lean, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_whole_pages(spark):
    from tracewell.llm.html_extraction import extract

    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body.replace("<br>", " "))]
        want[r.page_id] = "\n".join(p for p in parts if p)
    found = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    assert found == {k: (v, len(v)) for k, v in want.items()}


def test_layouts():
    from tracewell.llm.html_extraction import main_text

    long = "A sentence of the article, with some words in it. " * 4
    page = f"""<html><head><title>No</title><body><header><h2>Site name</h2></header><div id="cookie-notice"><p>We use cookies, and this is a long notice. {long}</p></div>
    <div class="menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>
    <main><h1>Head &amp; title</h1><p>{long}<p>Short.<p>{long}<ul><li>An item<li>Another</ul><div class="ad-box">Buy now. {long}</div>
    <form><p>Sign up</p></form><section id="comments"><p>Reader: {long}</p></section></main>
    <aside><p>{long}</p></aside><script>if (a < b) {{ "</p>" }}</script><footer>&copy; all rights</footer>"""
    one = " ".join(long.split())
    assert main_text(page) == "\n".join(["Head & title", one, "Short.", one, "An item", "Another"])
    bare = f"<div class='nav'><a href=a>Home</a> <a href=b>News</a></div><div><h1>Title of it all</h1><p>{long}</p><p>Yes.</p><p>{long}</p></div><div><a href=c>Imprint</a></div>"
    assert main_text(bare) == "\n".join(["Title of it all", one, "Yes.", one])
    outside = f"<p>We use cookies. {long}</p><article><header class='entry-header'><h1>T</h1></header><p>{long}</p><p>No.</p></article><div class='side-bar'><p>{long}</p></div><p>{long}</p>"
    assert main_text(outside) == "\n".join(["T", one, "No."])
    divs = f"<div class='topNav'><a href=a>Home</a></div><div class='post'><div class='post-header'><h1>A title</h1></div><div class='post-body'><p>{long}</p><p>Ok.</p><p>{long}</p></div></div><ol class='commentlist'><li><p>{long}</p></li></ol><div class='cookieBanner'>{long}</div>"
    assert main_text(divs) == "\n".join(["A title", one, "Ok.", one])
    assert [main_text(x) for x in (None, "", "<p>", "<p", "a < b", "&amp")][:4] == ["", "", "", ""]


def test_edges(spark):
    from tracewell.llm.html_extraction import extract

    pages = spark.createDataFrame([(1, None, None, "t"), (1, None, "", "t"), (2, "u", "<article>" + "<p>Ein Satz, der zählt.\n und\tmehr.</p>" * 3000, "t")], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, len(r.text), r.n_chars) for r in extract(pages).collect())
    assert rows == [(1, 0, 0), (1, 0, 0), (2, 3000 * 31 - 1, 3000 * 31 - 1)] and extract(pages.limit(0)).collect() == []


def test_the_cut_decides_where_blocks_alone_mislead():
    from tracewell.llm.html_extraction import labelled, main_text

    long = "A sentence of the article, with some words in it. " * 4
    one = " ".join(long.split())
    # Neither an article element nor telling classes: by themselves the short ones lean to boilerplate.
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>All of it</h1><p>{long}</p><p>Yes</p><p>{long}</p><p>Read <a href=c>this line</a> too</p><p>{long}</p></div><div>Imprint</div>"
    blocks, leans, kept = labelled(page)
    assert [b.text for b, x, k in zip(blocks, leans, kept) if k and x <= 0][-2:] == ["Yes", "Read this line too"]
    assert main_text(page) == "\n".join(["All of it", one, "Yes", one, "Read this line too", one])
    # A lone sentence between menu entries is outvoted.
    menu = "<li><a href=x>Some menu entry</a></li>" * 5
    notice = f"<div><p>{long}</p><p>{long}</p></div><ul>{menu}<li>We are glad that you have come to see us here, friend.</li>{menu}</ul>"
    assert main_text(notice) == one + "\n" + one


def weights_of(pages):
    """The classifier's weights from whole pages, without Spark."""
    import numpy as np

    from tracewell.llm.html_extraction import FEATURES, discriminant, examples

    sums = np.zeros((2, len(FEATURES) + 1, len(FEATURES) + 1))
    for page in pages:
        x, y = examples(page)
        x = np.c_[x, np.ones(len(x), np.int64)]
        for k in (0, 1):
            sums[k] += x[y == k].T @ x[y == k]
    return discriminant(sums)


def medium_pages():
    import pyarrow.parquet as pq

    return pq.read_table(f"{MEDIUM}/pages.parquet", columns=["html"]).column(0).to_pylist()


def test_fitted_weights(spark):
    from tracewell.llm.html_extraction import UNFITTED, fitted

    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    assert fitted(pages) == fitted(pages.repartition(5)) == weights_of(medium_pages())
    assert fitted(pages, 60) not in (UNFITTED, fitted(pages))
    assert fitted(pages.limit(0)) == fitted(pages.limit(3).selectExpr("page_id", "url", "'<p>No article</p>' AS html")) == UNFITTED


def test_pages_without_telling_elements():
    """Article, menu and footer as plain divisions, with weights from the other half of the pages: labels against those of the elements."""
    from tracewell.llm.html_extraction import labelled

    pages = medium_pages()
    weights = weights_of(pages[::2])
    flips = plain_flips = right = total = 0
    for page in pages[1::2]:
        found, leans, kept = labelled(page, weights)
        flips += sum(k != (x > 0) for x, k in zip(leans, kept))
        inside = [b.text for b in found if b.owner.content]
        plain = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")
        blocks, leans, kept = labelled(plain, weights)
        truth = [b.text in inside for b in blocks]
        plain_flips += sum(k != (x > 0) for x, k in zip(leans, kept))
        right, total = right + sum(k == t for k, t in zip(kept, truth)), total + len(blocks)
    print(f"{total} blocks; flipped by the cut: {flips}, {plain_flips} in plain divisions; right there: {right / total:.4f}")
    assert flips > 0 and plain_flips > 0 and right / total > 0.95


def test_names_weigh_and_do_not_veto():
    """Layouts whose class words tell little, with learnt and unlearnt costs."""
    from tracewell.llm.html_extraction import UNFITTED, main_text

    long = "A sentence of the article, with some words in it. " * 4
    one = " ".join(long.split())
    items = [f"{k} carrots" for k in range(12)]
    for weights in (UNFITTED, weights_of(medium_pages())):
        assert main_text(f'<div class="layout has-sidebar"><article><h1>T</h1><p>{long}</p><p>Yes</p></article></div>', weights) == f"T\n{one}\nYes"
        assert main_text(f'<main><p>{long}</p><div class="side-by-side"><p>{long}</p><p>ab</p></div></main>', weights) == f"{one}\n{one}\nab"
        related = f'<article><p>{long}</p><section id="related-work"><h2>Related</h2><p>{long}</p></section><p class="share-price">$12</p></article>'
        assert main_text(related, weights) == f"{one}\nRelated\n{one}\n$12"
        recipe = f"<div class=nav><a href=a>Home</a></div><div><h1>Soup</h1><p>{long}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p>{long}</p></div><div><a href=b>Imprint</a></div>"
        assert main_text(recipe, weights) == "\n".join(["Soup", one, *items, one])
        assert main_text(f"<article><ul>{'<li>a</li>' * 30}</ul><p>{long}</p></article>", weights) == "a\n" * 30 + one


def test_broken_tags_and_deep_nesting():
    import time

    from tracewell.llm.html_extraction import main_text

    long = "A sentence of the article, with some words in it. " * 4
    one = " ".join(long.split())
    assert main_text(f'<article><p>{long}<a href="x>link</a> end.</p><p>{long}</p></article>') == f"{one} link end.\n{one}"
    assert main_text(f'<article><p>{long}<a href="x>link</a> and <a href="y">two</a>.</p></article>') == f"{one} link and two."
    assert main_text(f'<article><p title="a > b" class=\'c > d\'>{long}</p><p x="1"y="2">{long}</p></article>') == f"{one}\n{one}"
    began = time.time()
    deep = "<div>" * 20_000 + f"<p>{long}</p>" * 300 + "</span>" * 20_000 + "</div>" * 20_000
    assert main_text("<article>" + deep) == "\n".join([one] * 300)
    assert time.time() - began < 20
