"""Main text of HTML pages by a tree-structured graphical model.

A tolerant reader turns a page into a tree of block elements with the text they hold.  Every node is content or not; a
node's potential is log-linear in its features (element, name hints in class, id and role, words, links, place under an
article), and each parent and child share a 2 x 2 potential by the child's kind.  Sum-product messages upward and then
downward give exact marginals; text of nodes whose content marginal is above one half is kept, in page order.  The weights
are trained by gradient ascent on the likelihood of labelled pages (:func:`labelled_pages`), with the same messages.

All trees of a batch form one forest, so messages are array operations per level of depth.  Null and empty pages, and
pages without content, give an empty text; nothing is shortened.  Repeated rows are treated alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Elements of HTML by their role in this reader.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style textarea title xmp noscript iframe noembed noframes template svg math object canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"p": BLOCKS - {"button", "label", "option", "select"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: Parts of class, id and role names that hint at what an element holds.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense adslot dfp teaser affiliate",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination paging tabs toc skip sitemap",
    "head": "header head masthead topbar top branding logo site title tagline hero",
    "foot": "footer foot bottom copyright legal colophon credits disclaimer contentinfo",
    "side": "sidebar side aside widget widgets rail complementary secondary column related recommended recommendations popular trending more",
    "notice": "notice notices cookie cookies consent gdpr alert alertdialog warning message popup modal overlay dialog paywall subscribe newsletter signup",
    "share": "share sharing social follow like twitter facebook tags tagcloud meta byline author",
    "comment": "comment comments reply replies respond discussion disqus thread reader responses feedback commentlist guestbook",
    "form": "form search login register field input contact poll survey",
    "main": "article content post entry story main body text hentry prose copy",
}
_HINT = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
_KINDS = ["p", "h", "li", "list", "table", "quote", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "figure", "root", "other"]
_KIND = {"p": 0, **{f"h{i}": 1 for i in range(1, 7)}, "hgroup": 1, **dict.fromkeys(["li", "dt", "dd", "option"], 2), **dict.fromkeys(["ul", "ol", "dl", "dir"], 3),
         **dict.fromkeys(["table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"], 4), **dict.fromkeys(["blockquote", "pre", "address"], 5), "div": 6, "center": 6, "details": 6,
         "section": 7, "article": 8, "main": 9, "nav": 10, "menu": 10, "aside": 11, "header": 12, "footer": 13,
         **dict.fromkeys(["form", "fieldset", "legend", "label", "button", "select", "search", "dialog"], 14), **dict.fromkeys(["figure", "figcaption"], 15), **dict.fromkeys(["html", "body", "head"], 16)}
_WORDS, _LINKS, _PLACES = (0, 1, 4, 10, 30), (0.0, 0.3, 0.7), 8
FEATURES = len(_KINDS) + len(HINTS) + len(_WORDS) + len(_LINKS) + 1 + _PLACES
EDGES = 2 * len(_KINDS)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Page:
    """Block elements of a page: ``parent``, ``kind``, features, and ``blocks`` of (node, text) in page order."""

    __slots__ = ("parent", "depth", "tag", "hints", "label", "words", "linked", "blocks")

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.hints, self.label = [-1], [0], ["html"], [0], [False]
        self.words, self.linked, self.blocks = [0], [0], []
        stack, held, links, at, link_words = [0], [], 0, 0, 0

        def flush():
            nonlocal held, link_words
            text = " ".join("".join(held).split())
            if text:
                n = text.count(" ") + 1
                self.words[stack[-1]] += n
                self.linked[stack[-1]] += min(link_words, n)
                self.blocks.append((stack[-1], text))
            held, link_words = [], 0

        def say(raw: str):
            nonlocal link_words
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                held.append(text)
                if links:
                    link_words += len(text.split())

        while True:
            m = _TAG.search(source, at)
            say(source[at : m.start() if m else len(source)])
            if m is None:
                break
            at = m.end()
            ends, name = (m[1] or m[4]), (m[2] or m[5])
            if name is None:
                continue
            name = name.lower()
            if name in RAW:
                if not ends and not (m[3] or m[6] or "").endswith("/"):
                    close = _END_RAW[name].search(source, at)
                    at = close.end() if close else len(source)
                continue
            if name == "br":
                held.append(" ")
            elif name == "hr":
                flush()
            elif name == "a":
                links = max(links + (-1 if ends else 1), 0)
            elif name in VOID or name not in BLOCKS and "-" not in name:
                continue
            elif ends:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        flush()
                        del stack[k:]
                        break
            else:
                flush()
                while len(stack) > 1 and name in CLOSES.get(self.tag[stack[-1]], ()):
                    stack.pop()
                attributes = m[3] or m[6] or ""
                hints = 0
                for found in _NAMES.findall(attributes):
                    for part in _PARTS.findall(found):
                        i = _HINT.get(part.lower())
                        if i is not None:
                            hints |= 1 << i
                self.parent.append(stack[-1])
                self.depth.append(self.depth[stack[-1]] + 1)
                self.tag.append(name)
                self.hints.append(hints)
                self.label.append("data-y" in attributes)
                self.words.append(0)
                self.linked.append(0)
                stack.append(len(self.tag) - 1)
        flush()


class Forest:
    """The trees of many pages as arrays, levels of depth for the messages."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        base = np.cumsum(sizes) - sizes
        self.base = base
        cat = lambda f: np.fromiter((x for p in pages for x in getattr(p, f)), np.int64)
        n = int(sizes.sum())
        self.parent = cat("parent") + np.repeat(base, sizes)
        self.depth = cat("depth")
        self.kind = np.fromiter((_KIND.get(t, len(_KINDS) - 1) for p in pages for t in p.tag), np.int64, n)
        hints, words, linked = cat("hints"), cat("words"), cat("linked")
        self.levels = [np.flatnonzero(self.depth == d) for d in range(1, int(self.depth.max(initial=0)) + 1)]
        x = np.zeros((n, FEATURES), np.float32)
        x[np.arange(n), self.kind] = 1
        at = len(_KINDS)
        for i in range(len(HINTS)):
            x[:, at + i] = hints >> i & 1
        at += len(HINTS)
        x[np.arange(n), at + np.searchsorted(_WORDS, words, "right") - 1] = 1
        at += len(_WORDS)
        some = words > 0
        x[some, at + np.searchsorted(_LINKS, linked[some] / words[some], "right") - 1] = 1
        x[:, at + len(_LINKS)] = 1
        at += len(_LINKS) + 1
        # places: under an article or main, under other marked parts, and whether the page has an article at all
        bad = np.isin(self.kind, [10, 11, 13, 14]) | (hints & 0b0111111111 > 0)
        told = hints >> list(HINTS).index("comment") & 1 > 0
        body = np.isin(self.kind, [8, 9]) | (hints >> list(HINTS).index("main") & 1 > 0) & ~bad
        under = {k: np.zeros(n, bool) for k in "abc"}
        for level in self.levels:
            up = self.parent[level]
            for k, own in (("a", body), ("b", bad), ("c", told)):
                under[k][level] = under[k][up] | own[up]
        page = np.repeat(np.arange(len(pages)), sizes)
        has = np.bincount(page[body], minlength=len(pages)) > 0
        x[:, at] = under["a"] & ~under["b"]
        x[:, at + 1] = under["a"] & under["b"]
        x[:, at + 2] = ~under["a"] & under["b"]
        x[:, at + 3] = ~under["a"] & ~under["b"] & has[page] & ~body
        x[:, at + 4] = ~under["a"] & ~under["b"] & ~has[page]
        x[:, at + 5] = under["c"] | told
        x[:, at + 6] = body & ~under["b"] & ~told
        x[:, at + 7] = body & (under["b"] | told)
        self.x = x
        self.edge = self.kind + len(_KINDS) * (hints & 0b0111111111 > 0)

    def messages(self, unary: np.ndarray, table: np.ndarray):
        """Log beliefs of both states, and for every node the joint of (parent, own) state; exact on trees."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = unary
        sent = np.zeros((n, 2))
        for level in reversed(self.levels):
            e = table[self.edge[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(e[:, :, 0], e[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        full, joint = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels:
            rest = full[self.parent[level]] - sent[level]
            e = table[self.edge[level]] + rest[:, :, None]
            full[level] = up[level] + np.logaddexp(e[:, 0, :], e[:, 1, :])
            j = e + up[level][:, None, :]
            j = np.exp(j - j.max((1, 2), keepdims=True))
            joint[level] = j / j.sum((1, 2), keepdims=True)
        return full, joint


def content(forest: Forest, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability that each node is content."""
    full, _ = forest.messages(forest.x @ weights, table)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50)))


def train(pages: list[str], steps: int = 150, rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials from pages whose content elements carry ``data-y``."""
    read = [Page(p) for p in pages]
    forest = Forest(read)
    y = np.array([v for p in read for v in p.label], int)
    child = np.concatenate(forest.levels)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[forest.parent[child]], y[child]] = 1
    params = np.zeros(FEATURES + EDGES * 4)
    m, v = np.zeros(len(params)), np.zeros(len(params))
    for t in range(1, steps + 1):
        weights, table = params[:FEATURES], params[FEATURES:].reshape(EDGES, 2, 2)
        full, joint = forest.messages(forest.x @ weights, table)
        p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50)))
        slope_table = np.zeros((EDGES, 2, 2))
        np.add.at(slope_table, forest.edge[child], (seen - joint)[child])
        slope = np.concatenate([forest.x.T @ (y - p), slope_table.ravel()]) / len(pages) - decay * params
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return params[:FEATURES], params[FEATURES:].reshape(EDGES, 2, 2)


def labelled_pages(count: int = 160, seed: int = 3) -> list[str]:
    """Pages of many layouts, made by rule; content elements carry ``data-y``."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "an", "so", "re", "vu", "ni", "pe"]) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    pick = rng.choice
    paragraph = lambda y="": f"<p{y}>{say(2, 60)}{pick(['', ' ' + link() + ' ' + say(3, 9), '<br>' + say(4, 12)])}{pick(['</p>', '</p>', ''])}"

    def hinted(hint: str, inside: str, tags=("div", "section")) -> str:
        tag, name = pick(tags), pick(HINTS[hint].split())
        return f'<{tag} {pick(["class", "id"])}="{pick(["", "site-", "c-", "page_"])}{name}">{inside}</{tag}>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
        inside = pick([f"<ul>{items}</ul>", "".join(link() + " " for _ in range(5))])
        return pick([f"<nav>{inside}</nav>", hinted("nav", inside), f"<nav><h2>{say(1, 2)}</h2>{inside}</nav>"])

    def top() -> str:
        inside = pick([f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 8)}</p>", say(2, 5)]) + pick(["", menu()])
        return pick([f"<header>{inside}</header>", hinted("head", inside)])

    def bottom() -> str:
        inside = pick(["", menu()]) + pick([f"<p>&copy; {say(3, 20)}</p>", f"&copy; {say(3, 9)} &middot; {say(2, 9)}", f"<p>{say(4, 25)}</p>"])
        return pick([f"<footer>{inside}</footer>", hinted("foot", inside)])

    def advert() -> str:
        return hinted("ad", pick([say(3, 25), f"<p>{say(3, 25)}</p>", f"<h3>{say(1, 4)}</h3><p>{say(5, 20)}</p>", link()]), ("div", "aside", "section"))

    def side() -> str:
        inside = "".join(pick([f"<h3>{say(1, 3)}</h3><ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{say(5, 40)}</p>", f"<div>{say(4, 30)}</div>"]) for _ in range(rng.randint(1, 3)))
        return pick([f"<aside>{inside}</aside>", hinted("side", inside, ("div", "aside", "section"))])

    def notice() -> str:
        return hinted("notice", pick([say(4, 40), f"<p>{say(4, 40)}</p><button>{say(1, 2)}</button>"]), ("div", "section", "aside", "dialog"))

    def blank() -> str:
        inside = f"<label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button>"
        inside = pick([inside, f"<p>{say(4, 25)}</p>{inside}", f"<h3>{say(1, 3)}</h3>{inside}<select><option>{word()}<option>{word()}</select>"])
        return pick([f"<form action=/x>{inside}</form>", hinted("form", f"<form>{inside}</form>")])

    def comments() -> str:
        one = lambda: pick([f'<div class="comment"><p>{say(5, 60)}</p></div>', f'<article class="comment"><h4>{say(1, 2)}</h4><p>{say(5, 60)}</p></article>', f"<li><p>{say(4, 50)}</p></li>", f"<div>{say(5, 60)}</div>", f"<p>{say(5, 50)}</p>"])
        return hinted("comment", pick([f"<h3>{say(1, 2)}</h3>", ""]) + "".join(one() for _ in range(rng.randint(1, 5))) + pick(["", blank()]), ("div", "section", "ol", "ul", "aside"))

    def article() -> str:
        y = " data-y"
        parts = [f"<h1{y}>{say(2, 9)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.3:
            parts = [f"<header{y}>{''.join(parts)}</header>"] if parts else []
        for _ in range(rng.randint(1, 9)):
            parts.append(pick([
                paragraph(y), paragraph(y), paragraph(y), f"<p{y}><b>{say(2, 30)}<br>", f"<h2{y}>{say(1, 6)}</h2>", f"<div{y}>{say(6, 60)}</div>",
                f"<ul{y}><li{y}>{say(2, 20)}<li{y}>{say(2, 20)}</ul>", f"<blockquote{y}><p{y}>{say(4, 30)}</p></blockquote>", f"<pre{y}>{say(3, 30)}</pre>",
                f"<table{y}><tbody{y}><tr{y}><td{y}>{say(1, 4)}</td><td{y}>{say(1, 4)}</td></tr></tbody></table>", f"<figure{y}><img src=x><figcaption{y}>{say(3, 12)}</figcaption></figure>",
                f"<section{y}><h3{y}>{say(1, 5)}</h3>{paragraph(y)}</section>", f"<p{y}>{say(1, 3)}</p>", f"<p{y}>{link()}</p>" if rng.random() < 0.2 else paragraph(y)]))
            if rng.random() < 0.12:
                parts.append(pick([advert, notice, lambda: hinted("share", link() + link()), lambda: hinted("side", f"<h3>{say(1, 2)}</h3><ul><li>{link()}</li></ul>", ("div", "aside")), blank, comments])())
        inside = "".join(parts)
        name = pick(HINTS["main"].split())
        return pick([
            f"<article{y}>{inside}</article>", f"<article{y}>{inside}</article>", f"<main{y}>{inside}</main>", f"<main{y}><article{y}>{inside}</article></main>",
            f'<div class="{name}"{y}>{inside}</div>', f'<div id="{name}"{y}><div{y}>{inside}</div></div>', f'<article class="{name}"{y}>{inside}</article>', f"<div{y}>{inside}</div>", f'<section class="{name}"{y}>{inside}</section>'])

    pages = []
    for _ in range(count):
        some = lambda f, p: f() if rng.random() < p else ""
        body = some(notice, 0.3) + some(top, 0.6) + some(menu, 0.6) + some(advert, 0.5) + some(side, 0.2)
        middle = article() + some(comments, 0.4) + some(advert, 0.2) + some(side, 0.3) + some(blank, 0.3)
        body += pick([middle, f"<div>{middle}</div>", f'<div class="wrapper">{middle}</div>']) + some(notice, 0.2) + some(bottom, 0.7)
        pages.append(f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title></head><body>{body}</body></html>")
    return pages


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def main_texts(pages: list[str | None], weights: np.ndarray, table: np.ndarray) -> list[str]:
    """The main text of every page."""
    if not pages:
        return []
    read = [Page(p or "") for p in pages]
    forest = Forest(read)
    p = content(forest, weights, table)
    return [" ".join(text for node, text in page.blocks if p[base + node] > 0.5) for page, base in zip(read, forest.base.tolist(), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    weights, table = model()

    def run(batches):
        for batch in text_slices(batches, 2, 1 << 19):
            texts = main_texts(batch.column(2).to_pylist(), weights, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
