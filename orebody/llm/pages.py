"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A block is the text between two block-level tags. It is described by its ancestors' tags, by what their class, id
and role names speak of, by its own element, and by its text (length, links, punctuation). The field gives each block
the label main or other: a weight for each feature, for each pair of neighbouring labels, and for the labels at a
page's ends. It is trained by gradient ascent of the likelihood (forward-backward) on labelled pages and decoded by
Viterbi. The labelled pages are composed here, with their labels, from many layouts; callers may bring their own.

Only comments, tags, scripts, styles and the window's title are no blocks; what else stands in a page is for the field
to judge. Pages of any length are read in time in proportion to it.

Edge cases: null, empty and text-free html give the empty text; unclosed and stray tags, cut-off pages and broken
character references are read as browsers read them; rows with equal or null ids stay apart; labels of equal score tie
for "other"; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import ship, steps

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
#: The same where quotes don't count: from the first tag on whose quotes don't close before the page's end.
_PLAIN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page: code, and the window's title.
SKIPPED = {"script", "style", "title"}
#: Form controls: blocks below a form, wherever they stand.
CONTROLS = {"button", "select", "textarea", "datalist"}
INLINE = {"a", "abbr", "audio", "b", "bdi", "bdo", "big", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "object", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "text", "time", "tspan", "tt", "u", "var", "video", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "nav", "aside", "footer", "header", "form", "body"}

#: Ancestors that are features, and what names speak of.
ANCESTORS = ["nav", "header", "footer", "aside", "article", "main", "section", "form", "ul", "ol", "table", "blockquote", "pre", "figure", "div", "body", "address", "details", "dialog", "menu"]
GROUPS = {
    "navigation": "nav navigation navbar menu breadcrumb breadcrumbs toc pager pagination tabs topbar skip",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense teaser",
    "foot": "footer foot copyright legal colophon imprint bottom",
    "head": "header masthead logo branding tagline topnav",
    "side": "sidebar side aside widget related recommended recommendations more popular trending rail",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe subscription paywall notification privacy",
    "comment": "comment comments reply replies respond disqus discussion responses reader feedback thread",
    "share": "share sharing social follow likes tools print",
    "form": "form login search signup signin register contact input field",
    "meta": "meta byline author date timestamp tags categories tag published bio",
    "content": "article content post entry story main body text prose page blog hentry articlebody",
    "hidden": "hidden invisible sr offscreen collapsed",
}
_OF_NAME = {word: i for i, words in enumerate(GROUPS.values()) for word in words.split()}
PARENTS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "section", "article", "body", "blockquote", "pre", "figcaption", "footer", "header", "nav", "aside", "dt", "dd", "main", "form", "label", "address", "caption", "summary", "other"]
TEXTS = ["words", "few", "many", "links", "all_links", "stop", "commas", "sign", "first", "last", "one"]
SIZE = len(ANCESTORS) + len(GROUPS) + len(PARENTS) + len(TEXTS)
_ENDS = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)", re.I) for t in SKIPPED}
_ANCESTOR = {t: 1 << i for i, t in enumerate(ANCESTORS)}
_PARENT = {t: i for i, t in enumerate(PARENTS)}

Block = tuple[str, int, int, int]  # text, ancestors and groups as bits, the element's number, characters in links


def _named(attributes: str, seen: dict[str, int]) -> int:
    """The groups that an element's names speak of, as bits."""
    if attributes not in seen:
        if len(seen) > 5000:
            seen.clear()
        bits = 0
        for found in _NAMES.findall(attributes):
            for part in _PART.findall("".join(found)):
                i = _OF_NAME.get(part.lower())
                if i is not None:
                    bits |= 1 << (len(ANCESTORS) + i)
        if re.search(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
            bits |= 1 << (len(ANCESTORS) + list(GROUPS).index("hidden"))
        seen[attributes] = bits
    return seen[attributes]


def blocks(page: str, seen: dict[str, int] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order; white space inside them is one space and they are trimmed."""
    seen = {} if seen is None else seen
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open block-level elements and the bits down to them
    where: dict[str, list[int]] = {}  # each name's places in the stack
    fences: list[int] = [-1]
    parts: list[str] = []
    linked, links = 0, 0
    at, n, tag = 0, len(page), _TAG

    def cut(i: int) -> None:
        while len(stack) > i:
            name = stack.pop()[0]
            where[name].pop()
            if name in FENCES:
                fences.pop()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                name, bits = stack[-1] if stack else ("body", 0)
                out.append((text, bits, _PARENT.get(name, len(PARENTS) - 1), min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < n:
        m = tag.search(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        slash, name, attributes = m[1], m[2], m[3]
        if tag is _TAG and m[5]:
            slash, name, attributes, tag = m[4], m[5], m[6], _PLAIN
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE or name in VOID:
                continue
            close()
            if where.get(name):
                cut(where[name][-1])
                links = 0
        elif name in SKIPPED:
            after = _ENDS[name].search(page, at)
            at = after.end() if after else n
            parts.append(" ")
        elif name == "a":
            links = 1
        elif name in INLINE:
            continue
        elif name in VOID:
            if name in ("br", "hr", "input", "img"):
                parts.append(" ")
        else:
            close()
            links = 0
            ended = CLOSES.get(name)
            if ended:
                last = max((where[x][-1] for x in ended if where.get(x)), default=-1)
                if last > fences[-1]:
                    cut(last)
            elif stack and stack[-1][0] == "p":
                cut(len(stack) - 1)  # a block-level element ends an open paragraph
            bits = (stack[-1][1] if stack else 0) | _ANCESTOR.get("form" if name in CONTROLS else name, 0) | (_named(attributes, seen) if attributes else 0)
            where.setdefault(name, []).append(len(stack))
            if name in FENCES:
                fences.append(len(stack))
            stack.append((name, bits))
    close()
    return out


def text_features(text: str, linked: int, place: int, total: int) -> list[float]:
    n = text.count(" ") + 1
    return [min(np.log1p(n), 6.0) / 3, float(n <= 3), float(n >= 25), linked / len(text), float(linked >= 0.9 * len(text)), float(text[-1] in ".!?:;\"'”»…"), min(1.0, text.count(",") / n * 5), float("©" in text or "®" in text or "|" in text[:40]), float(place == 0 < total - 1), float(place == total - 1 > 0), float(total == 1)]


def matrix(found: list[Block]) -> np.ndarray:
    """A row of features for each block."""
    out = np.zeros((len(found), SIZE))
    base = len(ANCESTORS) + len(GROUPS)
    for i, (text, bits, parent, linked) in enumerate(found):
        out[i, [j for j in range(base) if bits >> j & 1]] = 1
        out[i, base + parent] = 1
        out[i, base + len(PARENTS) :] = text_features(text, linked, i, len(found))
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps_: int = 250, rate: float = 0.08, penalty: float = 0.02) -> dict[str, np.ndarray]:
    """Fit the field to pages, each (features of its blocks, labels: 1 main, 0 other), by Adam."""
    longest, n = max(len(y) for _, y in pages), len(pages)
    x, y, live = np.zeros((n, longest, SIZE)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
    last = live.sum(axis=1) - 1
    w = {"emit": np.zeros(SIZE), "bias": np.zeros(1), "pair": np.zeros((2, 2)), "start": np.zeros(2), "end": np.zeros(2)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    rows = np.arange(n)

    def logsum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps_ + 1):
        s = np.zeros((n, longest, 2))
        s[:, :, 1] = x @ w["emit"] + w["bias"]
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = s[:, 0] + w["start"]
        for t in range(1, longest):
            forward[:, t] = logsum(forward[:, t - 1, :, None] + w["pair"], 1) + s[:, t]
        backward[rows, last] = w["end"]
        for t in range(longest - 2, -1, -1):
            step_back = logsum(w["pair"][None] + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < last)[:, None], step_back, np.where((t == last)[:, None], w["end"], 0))
        z = logsum(forward[rows, last] + w["end"], 1)
        p = np.exp(forward + backward - z[:, None, None]) * live[:, :, None]
        pair = np.zeros((2, 2))
        both = live[:, 1:]
        joint = np.exp(forward[:, :-1, :, None] + w["pair"] + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
        pair -= (joint * both[:, :, None, None]).sum(axis=(0, 1))
        np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1)
        d = ((y == 1) - p[:, :, 1]) * live
        one = np.eye(2)
        g = {"emit": np.einsum("nt,ntf->f", d, x), "bias": np.array([d.sum()]), "pair": pair, "start": (one[y[:, 0]] - p[:, 0]).sum(axis=0), "end": (one[y[rows, last]] - p[rows, last]).sum(axis=0)}
        for k in w:
            gk = g[k] / n - penalty * w[k] * (k != "bias") / 10
            m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.99 * v[k] + 0.01 * gk * gk
            w[k] = w[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w


class Extractor:
    def __init__(self, weights: dict[str, np.ndarray]):
        e = weights["emit"].tolist()
        base = len(ANCESTORS) + len(GROUPS)
        self.bits, self.parent, self.text = e[:base], e[base : base + len(PARENTS)], e[base + len(PARENTS) :]
        self.bias, self.pair, self.start, self.end = float(weights["bias"][0]), weights["pair"].tolist(), weights["start"].tolist(), weights["end"].tolist()
        self.paths: dict[tuple[int, int], float] = {}
        self.seen: dict[str, int] = {}

    def _score(self, bits: int, parent: int) -> float:
        key = (bits, parent)
        if key not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[key] = self.bias + self.parent[parent] + sum(w for j, w in enumerate(self.bits) if bits >> j & 1)
        return self.paths[key]

    def labels(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not found:
            return []
        (a, b), (c, d) = self.pair
        back: list[tuple[int, int]] = []
        no = yes = 0.0
        for i, (text, bits, parent, linked) in enumerate(found):
            s = self._score(bits, parent) + sum(w * f for w, f in zip(self.text, text_features(text, linked, i, len(found)), strict=True))
            if i == 0:
                no, yes = self.start[0], self.start[1] + s
                continue
            from_no, from_yes = int(yes + c > no + a), int(yes + d > no + b)
            back.append((from_no, from_yes))
            no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
        label = int(yes + self.end[1] > no + self.end[0])
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def __call__(self, page: str) -> str:
        found = blocks(page, self.seen)
        return " ".join(b[0] for b, label in zip(found, self.labels(found), strict=True) if label)


def labelled_pages(count: int = 420, seed: int = 3) -> list[tuple[str, dict[str, int]]]:
    """Composed pages with the label of each block's text: many layouts of the same few kinds of parts."""
    rng = np.random.default_rng(seed)
    syllables = "an be ca do en fi ga he in jo ka lo mi no or pa qui re st th un ve wa éa ö ü ción".split()
    pick = lambda *a: a[int(rng.integers(len(a)))]

    def words(low: int, high: int) -> str:
        return " ".join("".join(syllables[k] for k in rng.integers(len(syllables), size=int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high))))

    def prose(low: int, high: int) -> str:
        out, left = [], int(rng.integers(low, high))
        while left > 0:
            k = min(left, int(rng.integers(3, 16)))
            out.append(words(k, k + 1).replace(" ", ", ", int(rng.integers(0, 2))).capitalize() + pick(".", ".", ".", "!", "?"))
            left -= k
        return " ".join(out)

    pages = []
    for _ in range(count):
        label: dict[str, int] = {}

        def block(tag: str, text: str, y: int, label: dict[str, int] = label) -> str:
            while text in label:
                text += " " + words(1, 3)
            label[text] = y
            body = pick(text, text, text, text.replace(" ", " <b>", 1) + "</b>", "<span>" + text + "</span>")
            return f"<{tag}>{body}</{tag.split()[0]}>" if rng.random() < 0.9 or tag[0] != "p" else f"<{tag}>{body}"

        def links(low: int, high: int, label: dict[str, int] = label) -> str:
            items = []
            for _ in range(int(rng.integers(low, high))):
                text = words(1, 4)
                while text in label:
                    text += " " + words(1, 3)
                label[text] = 0
                items.append(f'<li><a href="/{len(items)}">{text}</a></li>')
            return "<ul>" + "".join(items) + "</ul>"

        def content(block=block) -> str:
            out = [block("h1", words(2, 12), 1)] if rng.random() < 0.8 else []
            for _ in range(int(rng.integers(1, 14))):
                r = rng.random()
                if r < 0.62:
                    out.append(block("p", prose(2, 120), 1))
                elif r < 0.72:
                    out.append(block("p", pick(words(1, 3).capitalize() + ".", words(2, 8)), 1))
                elif r < 0.80:
                    out.append(block(pick("h2", "h3"), words(1, 8), 1))
                elif r < 0.87:
                    out.append("<ul>" + "".join(block("li", pick(words(2, 20), prose(5, 30)), 1) for _ in range(int(rng.integers(2, 6)))) + "</ul>")
                elif r < 0.92:
                    out.append("<blockquote>" + block("p", prose(5, 40), 1) + "</blockquote>")
                elif r < 0.95:
                    out.append("<table><tr>" + "".join(block("td", words(1, 6), 1) for _ in range(int(rng.integers(2, 5)))) + "</tr></table>")
                else:
                    out.append("<figure><img src=x>" + block("figcaption", words(3, 12), 1) + "</figure>")
                if rng.random() < 0.10:
                    out.append(pick(advert, share, meta, related, notice)())
            return "".join(out)

        advert = lambda block=block: pick(f'<div class="{pick("ad", "ads", "advert box", "promo", "sponsored", "ad-banner")}">', '<aside class="ad">') + block(pick("p", "span", "div"), pick(prose(3, 25), words(2, 10)), 0) + "</div>"
        share = lambda links=links: f'<div class="{pick("share", "social-share", "sharing")}">' + links(2, 5) + "</div>"
        meta = lambda block=block: block(f'{pick("p", "div")} class="{pick("byline", "meta", "author", "post-date", "tags")}"', words(2, 8), 0)
        related = lambda links=links, block=block: f'<{(t := pick("div", "aside", "section"))} class="{pick("related", "recommended", "more", "popular")}">' + block("h3", words(1, 4), 0) + pick(links(2, 6), block("p", prose(4, 30), 0)) + f"</{t}>"
        notice = lambda block=block: f'<div {pick("class", "id")}="{pick("cookie-notice", "consent", "newsletter", "notice", "gdpr-banner", "paywall", "alert", "popup")}">' + block("p", prose(4, 40), 0) + pick("", block("button", words(1, 3), 0)) + "</div>"
        nav = lambda links=links: pick("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="navigation">{}</div>', '<ul class="breadcrumb">{}</ul>', '<header><nav>{}</nav></header>').format(links(2, 9))
        header = lambda block=block: pick("<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>').format(block(pick("h1", "div", "p", "h2"), pick(words(1, 5), prose(3, 12)), 0) + pick("", block("p", prose(3, 15), 0)))
        footer = lambda block=block, links=links: pick("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>').format(pick("", links(1, 5)) + pick(block("p", "© " + prose(2, 14), 0), block("div", "© " + words(1, 3) + " · " + prose(3, 14), 0), block("p", prose(3, 30), 0)))
        side = lambda block=block, links=links: pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="widget">{}</div>').format(block("h3", words(1, 4), 0) + pick(links(2, 6), block("p", prose(5, 60), 0), ""))
        comments = lambda block=block: pick('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>', '<ol class="replies">{}</ol>').format(block("h3", words(1, 4), 0) + "".join(block(pick("p", "p", 'div class="comment"'), prose(3, 70), 0) for _ in range(int(rng.integers(1, 5)))))
        form = lambda block=block: '<form action="/s">' + block("p", words(1, 6), 0) + "<input name=q>" + block("button", words(1, 3), 0) + "</form>"

        shell = pick("<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post entry">{}</div>', "<main><article>{}</article></main>", '<section class="story">{}</section>', "<div>{}</div>", "{}", '<div class="article-body">{}</div>')
        inner = content()
        if rng.random() < 0.25:
            inner += comments()
        top = [part() for part in (header, nav, notice, advert, form, side) if rng.random() < 0.4]
        below = [part() for part in (comments, related, side, advert, form, notice, nav) if rng.random() < 0.25]
        if rng.random() < 0.1:  # nothing but content
            top, below, inner = [], [], pick(inner, block("p", prose(3, 60), 1))
        page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(top) + shell.format(inner) + "".join(below) + (footer() if rng.random() < 0.85 and (top or below) else "") + pick("</body></html>", "")
        pages.append((page, label))
    return pages


def fit_extractor(pages: list[tuple[str, dict[str, int]]] | None = None) -> dict[str, np.ndarray]:
    """The field's weights, from labelled pages (html, label of each block's text); the composed ones by default."""
    rows = []
    for page, label in labelled_pages() if pages is None else pages:
        found = [b for b in blocks(page) if b[0] in label]
        if found:
            rows.append((matrix(found), np.array([label[b[0]] for b in found])))
    return train(rows)


@functools.cache
def default_weights() -> dict[str, np.ndarray]:
    """The weights fitted to the composed pages, once in a process: they depend on nothing else."""
    return fit_extractor()


def main_text(table: DataFrame, html: str = "html", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The columns of op3's contract: page_id, url, text and its code points."""
    spark = table.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(default_weights() if weights is None else weights)  # SIZE numbers and a few more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(sent.value)
        for batch in steps(batches, "html", limit=4 << 20):
            texts = [extract(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
