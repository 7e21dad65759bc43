"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text is a binary variable: content or not. A node has a unary
potential from its features (tag, parent's tag, words of class, id and role, length and link share of
runs) and a potential with its parent by kind of node. Sum-product messages pass upward from the leaves
and downward from the root, which is exact on a tree, and a run belongs to the text where its marginal
reaches one half. The potentials are trained by conditional likelihood on labelled pages: pages built by
rule around fixed cue words, and a bounded sample (`SAMPLE`, pages of at most `LONGEST` signs) of the corpus
whose pages mark their article. Every page is read whole, in time linear in its length, however deep its
elements lie. What browsers don't show is no text: scripts, styles, templates, frames, drawings and what
`object`, `audio`, `video`, `canvas` and `noscript` hold for those that can't show them. Formulas are text.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, whole_text

SAMPLE, LONGEST, ROUNDS = 128, 100_000, 20

# Element names of HTML by role, and words by which pages name what isn't their article.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = set("script style noscript template iframe svg object textarea audio video canvas noframes noembed xmp".split())
CLOSES_P = BLOCKS - set("button caption label legend optgroup option td th tr tbody thead tfoot title html head body".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "optgroup": ("select",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
CUES = (
    "ad ads advert adverts advertisement advertising adbox banner billboard breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus discussion dropdown feedback footer footnav gdpr header legal links login masthead menu message modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination popup prevnext privacy promo promoted promotion rail recommended register related replies reply respond search share sharing "
    "sidebar signin signup sitemap skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar trending widget widgets alert"
).split()
ARTICLE_WORDS = "article articlebody body content entry main page post story text".split()

_TOKEN = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|<[!?][^>]*>?|</[^>]*>?""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KINDS = {"run": 0, "h": 1, "p": 2, "list": 3, "box": 4, "other": 5}


def _kind(tag: str) -> int:
    if tag == "#":
        return KINDS["run"]
    if tag[0] == "h" and tag[1:].isdigit():
        return KINDS["h"]
    if tag in ("p", "pre", "blockquote", "figcaption", "figure", "td", "th", "dd", "dt"):
        return KINDS["p"]
    if tag in ("ul", "ol", "li", "dl", "table", "tr", "tbody", "thead"):
        return KINDS["list"]
    return KINDS["box" if tag in ("div", "section", "article", "main", "body", "center") else "other"]


class Page:
    """Nodes in page order: tag, parent, features and, of runs of text, the text."""

    def __init__(self, html: str):
        self.tags, self.parents, self.features, self.texts = ["#root"], [-1], [["root"]], [None]
        self._stack, self._parts, self._linked, self._in_link = [0], [], 0, 0
        # where on the stack the open elements of each tag are
        self._open_at: dict[str, list[int]] = {"#root": [0]}
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                # only drawings can close themselves; `<script/>` opens a script
                if not (tag == "svg" and m[3].endswith("/")):
                    close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                    at = close.start() if close else end
            else:
                self._open(tag, m[3])
        self._flush()

    def _text(self, raw: str) -> None:
        self._parts.append(raw)
        if self._in_link:
            self._linked += len(raw)

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            linked = self._linked / max(sum(map(len, self._parts)), 1)
            size = min(int(math.log2(len(text) + 1)), 9)
            self._add("#", [f"size:{size}", f"link:{int(linked * 3.99)}", f"in:{self.tags[self._stack[-1]]}"], text)
        self._parts, self._linked = [], 0

    def _add(self, tag: str, features: list[str], text: str | None) -> None:
        self.tags.append(tag), self.parents.append(self._stack[-1]), self.features.append(features), self.texts.append(text)

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br" or tag in ("img", "input", "wbr"):
            self._parts.append(" " if tag != "wbr" else "")
        elif tag == "hr":
            self._flush()
        elif tag == "a":
            self._in_link = 1
        elif tag in BLOCKS:
            self._flush()
            self._in_link = 0
            if tag in CLOSES_P:
                self._pop(("p",), ("button", "td", "th", "body", "#root"))
            if tag in SELF_CLOSING:
                self._pop(SAME.get(tag, (tag,)), SELF_CLOSING[tag])
            words = [f"tag:{tag}", f"{self.tags[self._stack[-1]]}>{tag}"]
            for m in _NAMED.finditer(rest) if rest else ():
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("hidden", "aria-hidden"):
                    words += ["hidden"] * (name == "hidden" or value == "true")
                else:
                    words += [f"word:{w.lower()}" for w in _WORD.findall(value)]
            self._add(tag, words, None)
            self._open_at.setdefault(tag, []).append(len(self._stack))
            self._stack.append(len(self.tags) - 1)

    def _last(self, tags: tuple) -> int:
        return max((self._open_at[t][-1] for t in tags if self._open_at.get(t)), default=0)

    def _cut(self, k: int) -> None:
        while len(self._stack) > k:
            self._open_at[self.tags[self._stack.pop()]].pop()

    def _pop(self, tags: tuple, until: tuple) -> None:
        """Close the last open element of the tags, unless one of `until` was opened after it."""
        k = self._last(tags)
        if k and k > self._last(until):
            self._cut(k)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = 0
        elif tag in BLOCKS:
            self._flush()
            self._in_link = 0
            if k := self._last((tag,)):
                self._cut(k)


class TreeModel:
    """Unary and parent-child potentials, and sum-product on a page's tree."""

    def __init__(self):
        self.unary: dict[str, float] = {}
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in KINDS]

    def beliefs(self, page: Page) -> tuple[list[float], list[list[list[float]]]]:
        """Content marginals of all nodes, and the joint of each node with its parent."""
        n, parents, get = len(page.tags), page.parents, self.unary.get
        one = [sum(get(f, 0.0) for f in fs) for fs in page.features]
        zero, kinds = [0.0] * n, [_kind(t) for t in page.tags]
        up0, up1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            t, a, b, p = self.pair[kinds[i]], zero[i], one[i], parents[i]
            up0[i], up1[i] = _add_logs(t[0][0] + a, t[0][1] + b), _add_logs(t[1][0] + a, t[1][1] + b)
            zero[p] += up0[i]
            one[p] += up1[i]
        joint: list = [None] * n
        for i in range(1, n):
            t, p = self.pair[kinds[i]], parents[i]
            out0, out1 = zero[p] - up0[i], one[p] - up1[i]
            cells = [[out0 + t[0][0] + zero[i], out0 + t[0][1] + one[i]], [out1 + t[1][0] + zero[i], out1 + t[1][1] + one[i]]]
            top = max(map(max, cells))
            cells = [[math.exp(c - top) for c in r] for r in cells]
            total = sum(map(sum, cells))
            joint[i] = [[c / total for c in r] for r in cells]
            zero[i] += _add_logs(t[0][0] + out0, t[1][0] + out1)
            one[i] += _add_logs(t[0][1] + out0, t[1][1] + out1)
        return [1 / (1 + math.exp(min(max(a - b, -700), 700))) for a, b in zip(zero, one, strict=True)], joint

    def fit(self, pages: list[tuple[Page, list[int]]], rounds: int = ROUNDS) -> TreeModel:
        """AdaGrad on the conditional likelihood of the labels, page by page."""
        seen: dict = {}

        def step(key, g):
            seen[key] = seen.get(key, 0.1) + g * g
            return 0.5 * g / math.sqrt(seen[key])

        for _ in range(rounds):
            for page, labels in pages:
                p, joint = self.beliefs(page)
                for fs, y, q in zip(page.features, labels, p, strict=True):
                    for f in fs if abs(y - q) > 1e-4 else ():
                        self.unary[f] = self.unary.get(f, 0.0) + step(f, y - q)
                for i in range(1, len(labels)):
                    k = _kind(page.tags[i])
                    for a in (0, 1):
                        for b in (0, 1):
                            g = (labels[page.parents[i]] == a and labels[i] == b) - joint[i][a][b]
                            self.pair[k][a][b] += step((k, a, b), g)
        return self

    def text(self, html: str) -> str:
        page = Page(html)
        p, _ = self.beliefs(page)
        return "\n".join(t for t, q in zip(page.texts, p, strict=True) if t is not None and q >= 0.5)


def _add_logs(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def labels_of(page: Page, content: list[bool]) -> list[int]:
    """Labels of all nodes from those of the runs: an element is content if half of the text below it is."""
    good, every = [0] * len(page.tags), [0] * len(page.tags)
    for i in range(len(page.tags) - 1, 0, -1):
        if page.texts[i] is not None:
            every[i], good[i] = len(page.texts[i]), len(page.texts[i]) * content[i]
        every[page.parents[i]] += every[i]
        good[page.parents[i]] += good[i]
    return [int(e > 0 and 2 * g >= e) for g, e in zip(good, every, strict=True)]


def _inside(page: Page, i: int, tags: tuple) -> list[int]:
    """A node's ancestors up to the first with one of the tags; empty if there is none."""
    found = []
    while (i := page.parents[i]) > 0:
        found.append(i)
        if page.tags[i] in tags:
            return found
    return []


def article_labels(page: Page) -> list[int] | None:
    """Labels of a page that marks its article: its runs, but for those under a cue or a boilerplate element."""
    if page.tags.count("article") != 1:
        return None
    cues, plain = {f"word:{c}" for c in CUES}, {"nav", "aside", "form", "footer", "button", "select", "label"}
    content = []
    for i, text in enumerate(page.texts):
        above = _inside(page, i, ("article",)) if text is not None else []
        content.append(bool(above) and not any(page.tags[k] in plain or cues & set(page.features[k]) for k in above))
    return labels_of(page, content)


def built_pages() -> list[tuple[Page, list[int]]]:
    """Labelled pages made by rule: an article in one of several frames, and blocks under every cue word
    around and inside it. A run's label is whether its text begins with the mark of the article."""
    long = lambda k: f"Main {k} " + "ore than and some words of a sentence that goes on for a while, " * (k % 3 + 1)
    pages = []
    frames = [
        ("<article>", "</article>"), ('<article class="post">', "</article>"), ('<main><article id="content">', "</article></main>"), ('<div class="content">', "</div>"),
        ('<div id="main"><div class="post entry">', "</div></div>"), ("<main>", "</main>"), ('<div class="article-body">', "</div>"), ('<section class="story text">', "</section>"), ('<div role="main">', "</div>"), ("<div>", "</div>"),
    ]
    plain = ["<nav><ul><li><a href=x>Home</a></li><li><a href=y>World news</a></li></ul></nav>", "<header><p>Site name</p></header>", "<aside><p>Other things that go on around here and there</p></aside>", "<form><label>Mail</label><button>Send it</button></form>", "<footer><p>&copy; 2020 the owner of all of this &middot; Imprint</p></footer>", "<footer>&copy; example.net &middot; words that a footer has.</footer>"]
    for k, cue in enumerate(CUES * 3):
        other = CUES[(k * 7 + 3) % len(CUES)]
        box = ("div", "section", "p", "aside", "ul")[k % 5]
        name = ("class", "id")[k % 2]
        inner = ("{}", "<p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", "<a href=z>{}</a>", "<h2>Title of it</h2><p>{}</p><p>{}</p>", "<div><h3>Name</h3><div><p>{}</p></div></div>")[k // 5 % 6] if box in ("div", "section", "aside") else ("<li>{}</li>" if box == "ul" else "{}")
        said = ("Short words", "A longer note of a dozen words, which is not what the page is about at all.", "I think that this is a fine piece and would like to read more of it soon. " * 2)[k % 3]
        block = lambda c, s: f'<{box} {name}="{c}">{inner.replace("{}", s)}</{box}>'  # noqa: B023, E731
        a, b = frames[k % len(frames)]
        head = ("<h1>Main title</h1>", "<header><h1>Main title</h1></header>", "")[k % 3] if "article" in a else "<h1>Main title</h1>" * (k % 2)
        body = "".join((f"<p>{long(j)}</p>", f"<p>Main {j}.</p>", f"<ul><li>Main point</li><li>{long(j)}</li></ul>", f"<h2>Main part {j}</h2>", f"<blockquote><p>{long(j)}</p></blockquote>", f"<div><p>{long(j)}</p></div>", f"<table><tr><td>Main cell</td><td>Main {j}</td></tr></table>", f'<p>Main <a href="q">link in it</a> {long(j)}</p>')[(k + j * j) % 8] for j in range(1 + k % 6))
        html = f"<html><head><title>Main title of site</title></head><body>{plain[k % 2]}{plain[0]}{block(cue, said) * (k % 3 > 0)}{a}{head}{body}{block(cue, said)}<p>{long(k)}</p>{block(other, said) * (k % 2)}{b}{plain[2 + k % 2]}{plain[4 + k % 2]}</body></html>"
        page = Page(html)
        inside = lambda i: not any(page.tags[j] in ("head", "title") for j in (page.parents[i],))  # noqa: B023, E731
        pages.append((page, labels_of(page, [t is not None and t.startswith("Main") and inside(i) for i, t in enumerate(page.texts)])))
    return pages


def train(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> TreeModel:
    """A model from the built pages and at most `sample` pages of the corpus that mark their article; longer
    pages than `longest` are not learnt from, so that what the driver gathers is bounded."""
    rows = pages.select(F.col(key).alias("__id"), F.col(html).alias("__html")).where(F.expr("__html ilike '%<article%'") & (F.length("__html") <= longest))
    chosen = bounded_sample(rows.select("__id").where("__id IS NOT NULL").distinct(), "__id", sample)
    found = rows.join(F.broadcast(chosen), "__id").orderBy("__id", F.xxhash64("__html")).limit(sample).select("__html").collect()
    own = [(p, y) for p in (Page(r[0]) for r in found) if (y := article_labels(p))]
    return TreeModel().fit([*built_pages(), *own])


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """One row per page: key, the columns to keep, text, n_chars (code points).

    White space inside a block is one space; blocks are joined by one line break. Null and empty pages,
    and pages without content, have an empty text. Pages of any length and depth are read whole. Rows that
    repeat a key, or have none, each get their own row. Other columns are ignored.
    sample, longest: how many pages the model learns from at most, and their greatest length.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(pages, key, html, sample, longest))
    rows = pages.select(key, *keep, whole_text(html).alias("__html"))
    schema = rows.drop("__html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def extract(frames):
        for frame in frames:
            texts = [model.value.text(h) for h in frame.pop("__html")]
            yield frame.assign(text=pd.Series(texts, index=frame.index, dtype=object), n_chars=pd.Series([len(t) for t in texts], index=frame.index, dtype="int64"))

    return rows.mapInPandas(extract, schema)
