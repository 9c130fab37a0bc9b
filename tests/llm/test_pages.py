"""Block cutting on hand-made pages; LSTM gradients against differences; given pages against their markup."""

import html
import re

import numpy as np

from conftest import SF_SMALL
from lotline.llm import pages, queries


def texts_of(page):
    return [b[0] for b in pages.blocks(page)]


def test_blocks():
    assert texts_of("") == [] == texts_of("<p> &nbsp; </p><script>x<p>y</script><!-- <p>z</p> -->")
    assert texts_of("<p><b>One &amp;\n two<br><p>three<i>four</i> five</p>six<div>7&lt;8</div>") == ["One & two", "threefour five", "six", "7<8"]
    assert texts_of('<style>p{}</style><a href="x>y">in</a> text <img alt="<p>">end') == ["in text end"]
    path = pages.blocks('<div class="side Bar" id=x><ul><li>a<li>b</ul></div>')[1][1]
    assert path == (("div", ".side", ".bar", ".x"), ("ul",), ("li",))
    assert texts_of("<p>unclosed <b>bold") == ["unclosed bold"]
    assert texts_of("a < b <3 c") == ["a < b <3 c"]


def test_weak_labels():
    label = lambda h: [pages.weak_label(p) for _, p, _ in pages.blocks(h)]
    assert label("<title>t</title><nav>n</nav><article><h1>a</h1><div class='comment'>c</div><p>b</article><footer>f</footer><p>?") == [0, 0, 1, 0, 1, 0, -1]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    model = pages.BiLstm()
    x, mask = pages.padded([rng.normal(size=(n, pages.INPUTS)) for n in (5, 3)])
    y, known = (rng.random(mask.shape) > 0.5).astype(float), mask * (rng.random(mask.shape) > 0.2)

    def loss():
        z = model.logits(x, mask)
        return ((np.logaddexp(0, z) - y * z) * known).sum() / known.sum()

    g = model.gradients(x, mask, y, known)
    for k, v in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in v.shape)
            old, d = v[at], 1e-5
            v[at] = old + d
            up = loss()
            v[at] = old - d
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * d) - g[k][at]) < 1e-6


def expected(page):
    if not page or "<article>" not in page:
        return ""
    inner = page[page.index("<article>") + 9: page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("<h1>|</h1>|<p>|</p>", inner))
    return "\n\n".join(p for p in parts if p)


def test_query_over_the_given_pages(spark):
    given = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_pages"](spark, SF_SMALL).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, expected(given[r.page_id].html), len(expected(given[r.page_id].html)))


def test_nulls_repeats_long_pages_and_no_rows(spark):
    given = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    model = pages.train(given)
    long = "<html><body><nav><a>x</a></nav><article>" + "".join(f"<p>Paragraph {i} of the long one.</p>" for i in range(5000)) + "</article><footer>f</footer>"
    df = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (3, "u", long, 3), (3, "u", long, 3), (None, "v", "<p>a", 4)], "page_id long, url string, html string, n_blocks int")
    rows = pages.extract(df, model).collect()
    assert len(rows) == 5
    by = {r.page_id: r for r in rows}
    assert by[1].text == by[2].text == "" and by[3].n_blocks == 5002 and by[3].text.count("\n\n") == 4999
    assert pages.extract(df.limit(0)).count() == 0


def test_no_text_goes_with_drawings_formulas_and_fallbacks():
    words = lambda page: " ".join(b[0] for b in pages.blocks(page)).split()
    assert words('<p>one <svg class="i"/> two</p><p>three</p>') == ["one", "two", "three"]
    assert words("<p>one <svg class='i'>two</p><p>three</p><svg><path d='z'/></svg>") == ["one", "two", "three"]
    assert words("<p>one <svg><text>gone</text><style>a</style></svg> two</p>") == ["one", "two"]
    assert words("<svg-icon name=a>one</svg-icon><object-x>two</object-x><canvas-view>three</canvas-view><script-y>four</script-y>") == ["one", "two", "three", "four"]
    assert words("<p>one</p><object data=x><p>two</p></object><canvas>three<p>four") == ["one", "two", "three", "four"]
    assert [b[0] for b in pages.blocks("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be, <math/> so</p></article>")] == ["let x=2 be, so"]
    assert words("<script>a<b</script>one<style>p{}</style><iframe>x</iframe> two") == ["one", "two"]


def test_unclosed_fallbacks_and_templates_keep_the_text():
    words = lambda page: " ".join(b[0] for b in pages.blocks(page)).split()
    for name in ("noscript", "template"):
        assert words(f"<p>one</p><{name}><p>two</p><p>three</p>") == ["one", "two", "three"]
        assert words(f"<p>one</p><{name}><p>two</p></{name}><p>three</p><{name}>four") == ["one", "three", "four"]
    assert words("<p>one</p><script>two<p>three") == ["one"]
    assert words('<p>one</p><p title="open>two</p><p>three</p>') == ["one", "two", "three"]


def test_large_odd_pages_take_one_scan():
    import time

    odd = ["<svg>", "<svg ", "<a ", "<a>", "<b>x", '<p "', "<noscript>", "<!-", "</x>", "<div>y", "<svg><p>", "<template><svg>", "<i><div></div>", "</", "<!", "<li>z</b>"]
    for piece in odd:
        for end in ("", ">", "</p>"):
            page = piece * (1_000_000 // len(piece)) + end
            t = time.process_time()
            found = pages.blocks(page)
            pages.page_vectors(found[:1000])
            assert time.process_time() - t < 8, (piece, end)
    deep = pages.blocks("<div class=nav>" * 30_000 + "text")
    assert pages.weak_label(deep[0][1]) == 0 and deep[0][1].sums().any()
