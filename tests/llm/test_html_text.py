from __future__ import annotations

import numpy as np
import pytest

from gaugeline.llm import html_text as h

SMALL = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in h.blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d&amp;&#233;&nbsp;e<p>f<div>g</div><!-- x <p>y</p> -->h<script>var t='</p>';</script>i") == [
        "a bc d&é e", "f", "g", "h", "i"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("1 < 2 <p title='a > b'>x</p> <") == ["1 < 2", "x", "<"]
    assert texts("<script>never closed") == [] and texts("") == [] and texts("<!-- open") == [] and texts("plain") == ["plain"]
    assert [len(b.path) for b in h.blocks("<article><p><b>x</b></p></div></span><p>y</article>z")] == [3, 2, 0]


def test_gradients_equal_differences():
    model = h.Labeller()
    pages = h.code([h.blocks("<nav><a>a b</a></nav><article><p>c d e<p>f</article>"), h.blocks("<div class=ad>x</div><p>y")])
    labels = [np.array([0, 1, 1]), np.array([0, 1])]
    for v in model.p:
        model.p[v] = model.p[v].astype(np.float64)
    own = model.gradients(pages, labels)

    def loss():
        x, real = model.inputs(pages)
        z = model.logits(x.astype(np.float64), real)
        y = np.array([[0, 1, 1], [0, 1, 0]])
        return (np.logaddexp(0, z) - y * z)[real].mean()

    r = np.random.default_rng(1)
    for name, g in own.items():
        flat = model.p[name].reshape(-1)
        for k in r.choice(len(flat), min(6, len(flat)), replace=False):
            if name in ("path", "word"):
                k = int(np.argmax(np.abs(g)))  # an embedding that is used
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - g.reshape(-1)[k]) < 2e-3, name


@pytest.fixture(scope="module")
def model(spark):
    return h.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))


def wanted(page):
    body = page[page.index("<article>"):page.index("</article>")]
    return "\n".join(texts(body))


def test_given_pages(spark, model):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    got = h.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), model).collect()
    assert len(got) == len(rows)
    right = sum(r["text"] == wanted(rows[r["page_id"]]) for r in got)
    assert right >= 0.99 * len(got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_other_parts_go(spark, model):
    story = "".join(f"<p>Sentence number {k} of the story goes on, and on.</p>" for k in range(6))
    page = (f"<html><body><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>"
            f"<div class='cookie-notice'>We use cookies.</div><article><h1>Title</h1>{story}"
            f"<form><label>Your mail</label><button>Send</button></form></article><aside class='sidebar'><p>Popular</p></aside>"
            f"<div id='comments'><div class='comment'><p>Great read, thanks!</p></div></div><footer>Copyright</footer></body></html>")
    kind = "page_id long, url string, html string, text string"
    got = h.extract(spark.createDataFrame([(1, "u", page, "own")], kind), model).first()
    assert got["text"] == "\n".join(["Title", *[f"Sentence number {k} of the story goes on, and on." for k in range(6)]])


def test_edge_rows(spark, model):
    kind = "page_id long, url string, html string, n_chars string"
    rows = [(1, None, None, "a"), (2, "u", "", "a"), (None, "v", "<article><p>" + "x " * 300_000 + "</p></article>", "a"), (3, "w", "<", "b"),
            (3, "w", "<", "b"), (4, "y", "<p>" * 5_000, "c"), (5, "z", "<nav>a</nav>" * 3_000, "d")]
    got = h.extract(spark.createDataFrame(rows, kind), model).collect()
    assert [r["page_id"] for r in got] == [1, 2, None, 3, 3, 4, 5]
    assert got[0]["text"] == got[1]["text"] == "" and got[2]["n_chars"] == 599_999 and got[5]["text"] == ""
    assert h.extract(spark.createDataFrame([], kind), model).count() == 0
