"""Main text of pages."""
import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from narralytics.llm import html_extract as he
from narralytics.llm.common import table
from narralytics.llm.queries import QUERIES
from tests.llm.helpers import by_id, count

PAGES = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return he.fit(table(spark, sf_dir, "pages"))


def test_pages_query_equals_the_article(spark, sf_dir):
    got = by_id(QUERIES["op10_html"](spark, sf_dir), "page_id")
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


TEXT = "<p>The first part of a longer text, with marks.</p><p>And a second part &amp; more of it, so there is enough to read.</p>"
WANT = "The first part of a longer text, with marks.\nAnd a second part & more of it, so there is enough to read."


@pytest.mark.parametrize("page", [
    f'<html><body><nav><a href="/">Home</a></nav><article>{TEXT}</article><div class="comments"><p>Nice, I liked this text a lot, thank you.</p></div></body></html>',
    f'<body><header><p>My site</p></header><main>{TEXT}<aside class="sidebar"><p>Other reads, and some more words.</p></aside></main><footer>Imprint</footer>',
    f'<div class="cookie-notice"><p>We use cookies, as all do.</p><button>Fine</button></div><article>{TEXT}<form><label>Your mail</label><input></form></article>',
    f'<article>{TEXT}<script>var a = "<p>no</p>";</script><style>p {{ }}</style><div class="ad">Buy now, today only.</div></article>',
])
def test_boilerplate_goes(model, page):
    assert he.extract([page], model) == [WANT]


def test_awkward_pages(spark):
    rows = [(1, None, None, "a", "b"), (2, "u", "", "a", "b"), (3, "u", "plain words only", "a", "b"), (None, "u", "<p>x", "a", "b"), (4, "u", "<<<>>&amp&#x41;</div></p><p", "a", "b"),
            (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "a", "b"), (6, "u", "<p>a" * 5000, "a", "b"), (3, "u", "plain words only", "a", "b")]
    got = he.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""] and [r.text for r in got if r.page_id == 3] == ["plain words only"] * 2
    assert count(he.main_text(spark.createDataFrame([], PAGES))) == 0


@pytest.fixture(scope="module")
def bare(spark):
    """Trees for a table whose pages mark no article."""
    return he.fit(spark.createDataFrame([(1, "u", "<div>no mark</div>", "a", "b")], PAGES))


PARTS = (f"{TEXT}<h2>A list</h2><ul><li>The first entry of a list.</li><li>The second entry of it.</li></ul><table><tr><th>Name</th><th>Size</th></tr><tr><td>Small one</td>"
         "<td>12 of them</td></tr></table><pre>code line one\n  code line two</pre><blockquote><p>What somebody once said of it.</p></blockquote>")
PARTS_WANT = (f"{WANT}\nA list\nThe first entry of a list.\nThe second entry of it.\nName\nSize\nSmall one\n12 of them\ncode line one code line two\n"
              "What somebody once said of it.")


@pytest.mark.parametrize("open_, close_", [('<div class="content">', "</div>"), ('<div id="post-12" class="entry">', "</div>"), ("<article>", "</article>"),
                                           ('<section class="story">', "</section>")])
@pytest.mark.parametrize("comments", ['<div class="comments"><h3>Two answers</h3><div class="comment"><b>Ann</b><p>I liked this a lot, and read it twice.</p></div>'
                                      '<div class="comment"><b>Bob</b><p>So did I, thank you for it.</p></div></div>',
                                      '<ol class="comment-list"><li><p>I liked this a lot, and read it twice.</p></li><li><p>So did I.</p></li></ol>'])
def test_comments_in_the_article_go_and_its_parts_stay(bare, open_, close_, comments):
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav>{open_}<h1>The title</h1>{PARTS}{comments}{close_}<footer>Imprint</footer></body></html>'
    assert he.extract([page], bare) == [f"The title\n{PARTS_WANT}"]


def block_figures(model, seeds):
    """(precision, recall) of blocks on made pages whose marks are taken off."""
    right = found = wanted = 0
    for seed in seeds:
        for page in he.variants(he.template_page(seed), seed)[1:]:
            marked = he.Page(page)
            state = np.zeros(len(marked.tag), dtype=bool)
            for i in range(1, len(state)):
                mark = re.search(r"train([01])", marked.attrs[i])
                state[i] = mark[1] == "1" if mark else state[marked.parent[i]]
            want = he.page_text(marked, state).split("\n")
            bare_page = re.sub(r"<(/?)(article|main)\b", r"<\1div", re.sub(r'\s*data-train="[01]"', "", page))
            got = he.extract([bare_page], model)[0].split("\n")
            common = sum(min(got.count(b), want.count(b)) for b in set(want))
            right, found, wanted = right + common, found + len(got), wanted + len(want)
    return right / found, right / wanted


def test_blocks_of_held_out_pages_without_marks(bare):
    precision, recall = block_figures(bare, range(10_000, 10_080))
    print(f"block precision {precision:.4f}, recall {recall:.4f}")
    assert precision > 0.97 and recall > 0.97


@pytest.mark.parametrize("page, size", [("<b>x" * 200_000 + "</div>" * 200_000, 200_000), ("<div>" + "</p></b>" * 200_000, 0), ("<p>a<div>" * 100_000, 100_000),
                                        ("<li>a</ul>" * 100_000, 100_000), ("<html><body>" * 100_000 + "x", 1)])
def test_unclosed_and_stray_tags_are_read_in_linear_time(page, size):
    start = time.perf_counter()
    read = he.Page(page)
    assert time.perf_counter() - start < 20 and sum(len(d) for n, d in read.flow if n is not None) == size


def test_close_follows_the_stack():
    """The counters against walking the stack of open elements."""
    rng = np.random.default_rng(5)
    names = ["div", "p", "b", "li", "ul", "td", "table", "span", "article"]
    for _ in range(300):
        page, stack = he.Page(""), []
        for _ in range(40):
            tag = str(rng.choice(names))
            if rng.random() < 0.6:
                page.parent.append(page.open[-1]), page.tag.append(tag), page.attrs.append("")
                page.depths.setdefault(tag, []).append(len(page.open))
                page.open.append(len(page.tag) - 1)
                stack.append(tag)
            else:
                stop = tuple(str(x) for x in rng.choice(names, 3))
                page._close(tag, stop)
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth] == tag:
                        del stack[depth:]
                        break
                    if stack[depth] in stop:
                        break
            assert [page.tag[i] for i in page.open[1:]] == stack


def test_model_does_not_depend_on_file_layout(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(he, "TRAIN_NODES", 700)
    monkeypatch.setattr(he, "TEMPLATE_PAGES", 3)
    pages = table(spark, sf_dir, "pages")
    one, other = he.fit(pages.coalesce(1)), he.fit(pages.orderBy(F.desc("url")).repartition(7))
    assert one == other


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        odds = rng.normal(scale=2, size=n)
        p = 1 / (1 + np.exp(-odds))
        value = lambda kept: sum(np.log(p[i]) if kept[i] else np.log(1 - p[i]) for i in range(n))
        options = [k for c in range(1 << n) for k in [[bool(c >> i & 1) for i in range(n)]]
                   if k[0] and all(not k[i] or k[parent[i]] for i in range(1, n))]
        assert abs(value(list(he.decode(parent, odds))) - max(map(value, options))) < 1e-9
