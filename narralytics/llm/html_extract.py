"""Main text of web pages by boosted trees over DOM nodes.

Every element gets features of its tag, its class, id and role tokens, its depth and siblings, the text, link and
mark density of its subtree, and what its ancestors carry. Boosted trees give the chance that it belongs to the
article, and a dynamic programme over the tree picks the likeliest labelling in which everything below a dropped
node is dropped too, so ancestor and descendant never contradict each other. The text directly inside kept
nodes is the main text.

The trees are fitted on a bounded sample (``TRAIN_PAGES`` pages chosen by a hash of page_id, of their nodes at most the ``TRAIN_NODES``
first by a hash of page, variant and node, so the model does not depend on file layout) whose <article> or <main> gives the labels, each page also in
variants with other containers and with boilerplate of every sort put into and around the article, and on made pages with lists,
tables, code, quotes and reader comments inside the article, so that a table that marks no article has a model as well.

Defined results: null or empty html gives an empty text; a page without markup is its own text; broken markup is
read as browsers do as far as open paragraphs and stray ends go; white space of a block, line breaks included,
becomes one blank; repeated rows give a row each; further columns are ignored.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralytics.llm import trees
from narralytics.llm.common import slices, strings

TRAIN_PAGES = 150
TRAIN_NODES = 40_000
TEMPLATE_PAGES = 160
ROUNDS, DEPTH = 40, 4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre "
                  "section select summary table tbody td textarea tfoot th thead title tr ul".split())
ENDS_P = BLOCK - {"body", "html", "head", "option", "optgroup", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NEVER = frozenset("script style template noscript head title iframe object svg".split())
TAG_GROUPS = ("article main", "nav menu", "aside", "header", "footer", "form input button select textarea label fieldset option",
              " ".join(sorted(NEVER)), "h1 h2 h3 h4 h5 h6", "p blockquote pre figcaption", "ul ol dl", "li dt dd", "table thead tbody tr td th",
              "div", "section", "html body", "a")
TOKENS = ("ads?|advert\\w*|sponsor\\w*|promo\\w*|banner", "nav\\w*|menu\\w*|breadcrumbs?|tabs?|pagination|pager",
          "comments?|comment\\w*|repl(?:y|ies)|respond|discuss\\w*|disqus\\w*", "side|sidebar\\w*|widgets?|related|recommend\\w*|aside|rail",
          "footer|foot|copyright|legal|contentinfo", "header|head|masthead|topbar|logo|hero", "cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|dialog",
          "subscribe|newsletter|signup|share|social|follow", "form|search\\w*|login|contact|input", "hidden|hide|sr|invisible",
          "article\\w*|content|main|post|entry|story|body|text")
_TOKENS = [re.compile(f"(?:^|[^a-z0-9])(?:{t})(?:$|[^a-z0-9])") for t in TOKENS]
_TAG = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group.split()}
_MARKS = re.compile(r"[.,;:!?]")


class Page(HTMLParser):
    """Elements as parallel lists, and the text runs and block edges in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs, self.flow, self.open = [-1], ["#page"], [""], [], [0]
        self.depths: dict[str, list[int]] = {}      # per tag name, where its open elements stand in ``open``
        self.roots: set[str] = set()
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close("p", stop=("table", "td", "th", "div", "article", "section", "li", "body"))
        for other in SELF_CLOSING.get(tag, ()):
            self._close(other, stop=("ul", "ol", "dl", "table", "select", "tbody", "thead") if other not in ("td", "th") else ("table",))
        if tag in ("html", "body"):
            if tag in self.roots:
                return
            self.roots.add(tag)
        if tag in BLOCK or tag in VOID:
            self.flow.append((None, " " if tag in VOID and tag not in BLOCK else "\n"))
        if tag not in VOID:
            self.parent.append(self.open[-1])
            self.tag.append(tag)
            self.attrs.append(" ".join(f"{v}" for k, v in attrs if k in ("class", "id", "role", "itemprop") and v).lower()
                              + (" hidden" if any(k == "hidden" or (k == "style" and v and "none" in v) for k, v in attrs) else "")
                              + "".join(f" train{v}" for k, v in attrs if k == "data-train"))
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flow.append((None, "\n"))
        if tag not in ("html", "body"):   # what follows a stray end still belongs to the page
            self._close(tag, stop=() if tag in BLOCK else ("article", "div", "td", "li", "section", "body"))

    def handle_data(self, data):
        self.flow.append((self.open[-1], data))

    def unknown_decl(self, data):
        pass

    def _close(self, tag, stop):
        """Closes the innermost open element of the name and all in it, unless one of the stop names stands between."""
        at = self.depths.get(tag)
        if not at or any(other[-1] > at[-1] for other in map(self.depths.get, stop) if other):
            return
        depth = at[-1]
        while len(self.open) > depth:       # every element is taken off once
            self.depths[self.tag[self.open.pop()]].pop()


def node_features(page: Page) -> np.ndarray:
    """One row per element; the page itself is element 0."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 4))   # characters, characters in links, marks, words
    for node, data in page.flow:
        if node is not None and page.tag[node] not in ("script", "style"):
            own[node] += len(data), 0, len(_MARKS.findall(data)), data.count(" ") + 1
    link = np.array([t == "a" for t in page.tag])
    kind = np.array([_TAG.get(t, -1) for t in page.tag])
    flags = np.array([[bool(p.search(a)) if a else False for p in _TOKENS] for a in page.attrs], dtype=float)
    depth, within = np.zeros(n), np.zeros((n, 3))   # bad tokens or tags above, good ones above, link above
    bad_tag = np.isin(kind, [1, 2, 3, 4, 5, 6])
    bad = (flags[:, :10].any(axis=1) | bad_tag).astype(float)
    good = ((flags[:, 10] > 0) | (kind == 0)).astype(float)
    children, index = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        within[i] = within[p][0] + bad[p], within[p][1] + good[p], max(within[p][2], link[p])
        index[i] = children[p]
        children[p] += 1
    own[:, 1] = np.where(link | (within[:, 2] > 0), own[:, 0], 0)
    tree, below = own.copy(), np.ones(n)
    for i in range(n - 1, 0, -1):
        tree[parent[i]] += tree[i]
        below[parent[i]] += below[i]
    whole, up = max(1.0, tree[0, 0]), np.maximum(parent, 0)
    chars = np.maximum(tree[:, 0], 1)
    groups = kind[:, None] == np.arange(len(TAG_GROUPS))
    shape = np.stack([depth, index, children[up], np.log1p(tree[:, 0]), np.log1p(own[:, 0]), tree[:, 1] / chars, tree[:, 2] / chars,
                      tree[:, 3] / chars, tree[:, 0] / whole, tree[:, 0] / np.maximum(tree[up, 0], 1), np.log1p(tree[:, 0] / below),
                      np.log1p(below), within[:, 0], within[:, 1], bad, good], axis=1)
    return np.concatenate([groups, flags, shape], axis=1)


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Likeliest keep/drop labelling in which nothing below a dropped node is kept; the page itself is kept."""
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    all_dropped = drop.copy()
    best_kept = keep.copy()
    for i in range(len(parent) - 1, 0, -1):
        all_dropped[parent[i]] += all_dropped[i]
        best_kept[parent[i]] += max(best_kept[i], all_dropped[i])
    kept = np.zeros(len(parent), dtype=bool)
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and best_kept[i] >= all_dropped[i]
    return kept


def page_text(page: Page, kept: np.ndarray) -> str:
    blocks, current = [], []
    for node, data in [*page.flow, (None, "\n")]:
        if node is not None:
            if kept[node] and page.tag[node] not in NEVER:
                current.append(data)
        elif data == "\n":
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
        else:
            current.append(data)
    return "\n".join(blocks)


def extract(htmls: list[str], model) -> list[str]:
    """Main texts of some pages; the trees judge the nodes of all of them at once."""
    pages = [Page(h) for h in htmls]
    odds = trees.predict(model, np.concatenate([node_features(p) for p in pages])) if pages else np.zeros(0)
    out, start = [], 0
    for page in pages:
        own = odds[start:start + len(page.tag)]
        start += len(own)
        own[[t in NEVER for t in page.tag]] = -30.0   # these never hold prose
        out.append(page_text(page, decode(page.parent, own)))
    return out


def _sentence(rng, words: list[str], n: int, marks: float) -> str:
    """Two to ``n`` words, with commas and an end mark as often as ``marks`` says, so that marks alone tell nothing."""
    chosen = [str(w) for w in rng.choice(words, int(rng.integers(2, max(3, n))))]
    for i in np.flatnonzero(rng.random(len(chosen)) < marks / 8):
        chosen[i] += ","
    return " ".join(chosen) + ("." if rng.random() < marks else "")


def _boilerplate(rng, words: list[str]) -> str:
    """One piece of boilerplate of a random sort, marked as such for training."""
    wide, marks = rng.choice([0.3, 1.0]), rng.random()

    def some(n: int) -> str:
        return _sentence(rng, words, max(3, int(n * wide)), marks)

    item = f'<li><a href="/x">{some(4)}</a></li>'
    sort = int(rng.integers(0, 14))
    mark = 'data-train="0"'
    n = int(rng.integers(1, 6))
    note = [f'<section id="comments" class="comments" {mark}><h3>{some(4)}</h3>' + "".join(
                f'<div class="comment"><b>{some(3)}</b><p>{some(60)}</p><a href="#">{some(3)}</a></div>' for _ in range(n)) + "</section>",
            f'<div class="comments-area" {mark}><h2>{some(5)}</h2>' + "".join(
                f'<div class="comment-body"><span class="author">{some(3)}</span><p>{some(70)}</p><p>{some(30)}</p></div>' for _ in range(n)) + "</div>",
            f'<div id="respond" {mark}><h3>{some(4)}</h3><ul class="replies">' + "".join(f'<li class="reply"><div><p>{some(60)}</p></div></li>' for _ in range(n)) + "</ul></div>",
            f'<ol class="comment-list" {mark}>' + "".join(f"<li><p>{some(50)}</p></li>" for _ in range(3)) + "</ol>",
            f'<aside class="sidebar" {mark}><h4>{some(4)}</h4><ul>{item * 4}</ul><p>{some(30)}</p></aside>',
            f'<div class="cookie-notice" {mark}><p>{some(40)}</p><button>{some(3)}</button></div>',
            f'<form action="/s" {mark}><label>{some(5)}</label><input name="q"><textarea>{some(9)}</textarea><button>{some(3)}</button></form>',
            f'<div class="related-posts widget" {mark}><h4>{some(4)}</h4><ul>{item * 5}</ul></div>',
            f'<div class="share social" {mark}><a href="#">{some(3)}</a> <a href="#">{some(3)}</a></div>',
            f'<div class="ad-banner sponsored" {mark}><p>{some(40)}</p></div>', f'<div class="ad" {mark}>{some(40)}</div>',
            f'<nav class="breadcrumb" {mark}><a href="/">{some(3)}</a> &gt; <a href="/a">{some(3)}</a></nav>',
            f'<header class="site-header" {mark}><div class="logo">{some(3)}</div><p>{some(12)}</p></header>',
            f'<footer id="footer" {mark}><p>{some(40)}</p><ul>{item * 3}</ul></footer>']
    return note[sort]


_CONTAINERS = ('<article data-train="1">', '<main data-train="1">', '<div class="content" data-train="1">', '<div id="main-content" data-train="1">',
               '<div class="post entry" data-train="1">', '<section class="story-body" data-train="1">')


def variants(html: str, seed: int) -> list[str]:
    """The page with its article marked, and copies with other containers and boilerplate in and around it."""
    found = re.search(r"<(article|main)\b[^>]*>(.*)</\1\s*>", html, re.S | re.I)
    if not found:
        return []
    rng = np.random.default_rng(seed)
    words = (re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", found[2]))[:2000] or ["a"])
    inside = found[2]
    out = [html[:found.start()] + '<article data-train="1">' + inside + "</article>" + html[found.end():]]
    for _ in range(2):
        opening = str(rng.choice(_CONTAINERS))
        blocks = re.split(r"(?<=</p>)(?!\s*</(?:li|td|th|dd|blockquote|figure)>)|(?<=</ul>)|(?<=</ol>)|(?<=</pre>)|(?<=</table>)", inside)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(blocks) + 1))
            blocks.insert(at, _boilerplate(rng, words))
        closing = f"</{re.match(r'<([a-z]+)', opening)[1]}>"
        around = ["".join(_boilerplate(rng, words) for _ in range(int(rng.integers(0, 3)))) for _ in range(2)]
        wrap = ("<div>", "</div>") if rng.random() < 0.3 else ("", "")
        out.append(html[:found.start()] + around[0] + wrap[0] + opening + "".join(blocks) + closing + wrap[1] + around[1] + html[found.end():])
    return out


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a marked page: 1 for the article, what is in it and what it stands in."""
    page = Page(html)
    n = len(page.tag)
    state = np.zeros(n)
    holds = np.zeros(n)
    for i in range(1, n):
        mark = re.search(r"train([01])", page.attrs[i])
        state[i] = float(mark[1]) if mark else state[page.parent[i]]
        if page.tag[i] in NEVER:
            state[i] = 0
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] = max(holds[page.parent[i]], holds[i], state[i])
    page.attrs = [re.sub(r"\s*train[01]", "", a) for a in page.attrs]
    return node_features(page), np.maximum(state, holds)


def template_page(seed: int) -> str:
    """A made page of the usual parts, so that a table without a marked article still has a model."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9)))) for _ in range(200)]
    wide, marks = rng.choice([0.15, 0.4, 1.0]), rng.choice([0.3, 0.9])
    few = lambda a, b: range(int(rng.integers(a, b)))

    def text(n: int) -> str:
        return _sentence(rng, words, max(4, int(n * wide)), marks)


    def block() -> str:
        sort = int(rng.integers(0, 14))
        if sort == 0:
            return f"<h{2 + seed % 3}>{text(9)}</h{2 + seed % 3}>"
        if sort == 1:
            return "<ul>" + "".join(f"<li>{text(20)}</li>" for _ in few(2, 7)) + "</ul>"
        if sort == 2:
            return "<ol>" + "".join(f"<li><p>{text(30)}</p></li>" for _ in few(2, 6)) + "</ol>"
        if sort == 3:
            head = "<thead><tr>" + "".join(f"<th>{text(4)}</th>" for _ in range(3)) + "</tr></thead>" if rng.random() < 0.5 else ""
            return f"<table>{head}<tbody>" + "".join("<tr>" + "".join(f"<td>{text(6)}</td>" for _ in range(3)) + "</tr>" for _ in few(2, 7)) + "</tbody></table>"
        if sort == 4:
            return "<pre><code>" + "\n".join(text(8) for _ in few(1, 8)) + "</code></pre>" if rng.random() < 0.5 else f"<pre>{text(30)}</pre>"
        if sort == 5:
            return f"<blockquote><p>{text(50)}</p></blockquote>"
        if sort == 6:
            return f'<figure><img src="/a.png"><figcaption>{text(12)}</figcaption></figure>'
        if sort == 7:
            return f'<p>{text(30)} <a href="/{words[0]}">{text(6)}</a> <b>{text(5)}</b> {text(30)}</p>'
        if sort == 8:
            return f"<div><p>{text(70)}</p><p>{text(30)}</p></div>"
        return f"<p>{text(80)}</p>"

    body = f"<h1>{text(9)}</h1>" + "".join(block() for _ in few(1, 12))
    menu = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choice(words, 6)) + "</ul></nav>"
    return f"<html><head><title>{text(6)}</title></head><body>{menu}<article>{body}</article><footer>{text(12)}</footer></body></html>"


def training_nodes(pages: DataFrame) -> DataFrame:
    """(place, x, y) of the nodes of the sampled pages and their variants; ``place`` orders them by value alone."""
    chosen = (pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id IS NOT NULL").distinct()
              .orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES))  # the fit is on a bounded sample

    def run(batches):
        for batch in batches:
            for part in slices(batch, 16):
                made = [(i, k, *labelled(v)) for i, h in zip(part.column("page_id").to_pylist(), strings(part.column("html"))) for k, v in enumerate(variants(h, i))]
                if made:
                    x, y = np.concatenate([m[2] for m in made]), np.concatenate([m[3] for m in made])
                    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                    place = [f"{i}:{k}:{node}" for i, k, _, labels in made for node in range(len(labels))]
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.ListArray.from_arrays(at, pa.array(x.ravel().astype(np.float32))), pa.array(y)], ["place", "x", "y"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).join(F.broadcast(chosen), "page_id")
    return picked.mapInArrow(run, "place string, x array<float>, y double")


def fit(pages: DataFrame):
    """Boosted trees from at most ``TRAIN_NODES`` nodes of sampled pages and the template pages."""
    made = [labelled(v) for s in range(TEMPLATE_PAGES) for v in variants(template_page(s), s)]
    x, y = [m[0] for m in made], [m[1] for m in made]
    got = training_nodes(pages).orderBy(F.xxhash64("place"), "place", "x").limit(TRAIN_NODES).select("x", "y").toArrow()
    if got.num_rows:
        column = got.column("x").combine_chunks()
        x.append(column.flatten().to_numpy().reshape(got.num_rows, -1).astype(float))
        y.append(got.column("y").to_numpy())
    x, y = np.concatenate(x), np.concatenate(y)
    order = np.lexsort(x.T)
    return trees.fit(x[order], y[order], np.ones(len(y)), ROUNDS, DEPTH)


def main_text(pages: DataFrame, model=None) -> DataFrame:
    """page_id, url, text, n_chars for every row; one narrow pass after the fit."""
    fitted = model or fit(pages)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                texts = extract(strings(part.column("html")), fitted)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
