"""Main text of web pages: a linear-chain conditional random field over their text blocks.

``blocks`` walks a page once, tolerant of markup that is not closed or cut off, and
gives its leaf blocks: runs of text that no block-level tag interrupts (``br`` is
white space).  Scripts, styles, titles, comments and other markup give none.  A block's features
are its ancestors' tags, the words of their ``class``, ``id`` and ``role``, the nearest sectioning
tag, its own tag, and the text's length, share of links and punctuation; the words
of the text itself are no features, so no language is favoured.  Two labels, main text and the rest,
form a chain with learned transitions; ``fit`` maximises the penalised likelihood of labelled pages
by forward-backward sums, ``extract`` decodes by Viterbi.

Labelled pages are rows whose blocks begin with the mark ``MAIN`` or ``REST``; ``labelled_pages``
makes ``n`` of them by rule, in many layouts, with and without telling names, since the
given tables label none.  Fitting is one task over at most ``FIT_PAGES`` pages; the
driver receives the weights alone.

Odd input: null or empty html, or a page without main text, gives ''; very long pages are walked
in one pass, none is cut; repeated rows and null ids are kept; an empty table
gives no rows; other columns are not read.  Of equally good labellings the one with main text
is taken, from the last block on.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN, REST = "\ue000", "\ue001"
#: Pages of the default training set, the most that ``fit`` takes, and its steps and penalty.
PAGES, FIT_PAGES, STEPS, PENALTY = 700, 5000, 250, 0.02

# Fixed values of HTML: elements by how they are read.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "canvas", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SECTION = {"article", "main", "nav", "aside", "footer", "header", "form", "section", "table", "ul", "ol", "body", "blockquote", "figure"}
#: What an opening tag closes, up to the tags that stop the search.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS: dict[str, re.Pattern] = {}


class _Node:
    """An open element; ``own`` are the features that it adds to those above it."""

    __slots__ = ("tag", "above", "own", "near", "score")

    def __init__(self, tag, above, own, near, score):
        self.tag, self.above, self.own, self.near, self.score = tag, above, own, near, score

    def features(self):
        node = self
        while node is not None:
            yield from node.own
            node = node.above


def blocks(page: str, weights: dict[str, float] | None = None):
    """Rows (text, characters inside links, node) of the page's leaf blocks."""
    w = weights or {}
    root = _Node("", None, (), "", 0.0)
    stack, on_path = [root], Counter()
    text: list[str] = []
    out = []
    linked, link = 0, 0

    def end_block():
        nonlocal linked
        if text:
            t = " ".join("".join(text).split())
            text.clear()
            if t:
                out.append((t, linked, stack[-1]))
        linked = 0

    def pop(to):
        while len(stack) > to:
            on_path.subtract(stack.pop().own)

    at = 0
    find = _TOKEN.search
    while True:
        m = find(page, at)
        end = m.start() if m else len(page)
        if end > at:
            piece = html.unescape(page[at:end])
            text.append(piece)
            if link:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(1)
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
            continue
        end_block()
        link = 0 if tag in ("p", "li", "div") and not closing else link
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not m.group(3).endswith("/"):
                ends = _ENDS.get(tag) or _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I))
                stop = ends.search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if stack[-1].tag == "p" or (len(stack) > 1 and tag in CLOSES):
            closes, stops = CLOSES.get(tag, (frozenset(), frozenset()))
            if stack[-1].tag == "p":
                pop(len(stack) - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    pop(k)
                    break
                if stack[k].tag in stops:
                    break
        above = stack[-1]
        found = {f"t:{tag}"}
        if "=" in m.group(3):
            for q in _NAMES.finditer(m.group(3)):
                found.update("n:" + x.lower() for x in _WORD.findall(q.group(1) or q.group(2) or q.group(3) or ""))
        near = tag if tag in SECTION else above.near
        own = tuple(f for f in found if not on_path[f])
        on_path.update(own)
        stack.append(_Node(tag, above, own, near, above.score + sum(w.get(f, 0.0) for f in own)))
    end_block()
    return out


def text_features(text: str, linked: int, node: _Node) -> tuple[str, ...]:
    """Features of a block beside its ancestors'."""
    n = text.count(" ") + 1
    share = linked / len(text)
    size = "1" if n < 2 else "4" if n < 5 else "10" if n < 11 else "25" if n < 26 else "60" if n < 61 else "more"
    links = "none" if linked == 0 else "some" if share < 0.35 else "half" if share < 0.85 else "all"
    return ("bias", f"words:{size}", f"links:{links}", f"words:{size} links:{links}", f"own:{node.tag}", f"near:{node.near}", f"own:{node.tag} near:{node.near}",
            "end:stop" if text[-1] in ".!?…。»”\"" else "end:other", "sign" if text[0] in "©®«»›|•" else "plain")


class Model:
    """Weights towards main text by feature, and the chain's: start, and from (rest, main) to (rest, main)."""

    def __init__(self, weights: dict[str, float], start: float, step: list[list[float]]):
        self.weights, self.start, self.step = weights, start, step

    def main_text(self, page: str | None) -> str:
        found = blocks(page, self.weights) if page else []
        if not found:
            return ""
        w = self.weights
        (rr, rm), (mr, mm) = self.step
        back = []
        rest, main = 0.0, self.start
        for k, (t, linked, node) in enumerate(found):
            s = node.score + sum(w.get(f, 0.0) for f in text_features(t, linked, node))
            if k == 0:
                main += s
                continue
            to_rest, to_main = main + mr >= rest + rr, main + mm >= rest + rm
            back.append((to_rest, to_main))
            rest, main = (main + mr if to_rest else rest + rr), (main + mm if to_main else rest + rm) + s
        label = main >= rest
        labels = [label]
        for to_rest, to_main in reversed(back):
            label = to_main if label else to_rest
            labels.append(label)
        return "\n".join(t for (t, _, _), keep in zip(found, reversed(labels), strict=True) if keep)



def chain(emit: np.ndarray, length: np.ndarray, start: float, step: np.ndarray):
    """Log-likelihood parts of padded pages (pages x blocks): log of the sum over all
    labellings, each block's probability of main text, and of each pair of neighbouring labels."""
    pages, most = emit.shape
    on = np.arange(most)[None, :] < length[:, None]
    fwd, bwd = np.zeros((most, pages, 2)), np.zeros((most, pages, 2))
    fwd[0, :, 1] = start + emit[:, 0]
    for k in range(1, most):
        for y in (0, 1):
            s = np.logaddexp(fwd[k - 1, :, 0] + step[0, y], fwd[k - 1, :, 1] + step[1, y]) + (emit[:, k] if y else 0)
            fwd[k, :, y] = np.where(on[:, k], s, fwd[k - 1, :, y])
    total = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
    pairs = np.zeros((2, 2))
    main = np.zeros((pages, most))
    main[:, -1] = np.exp(fwd[-1, :, 1] + bwd[-1, :, 1] - total)
    for k in range(most - 1, 0, -1):
        later = [bwd[k, :, 0], bwd[k, :, 1] + emit[:, k]]
        for x in (0, 1):
            s = np.logaddexp(step[x, 0] + later[0], step[x, 1] + later[1])
            bwd[k - 1, :, x] = np.where(on[:, k], s, 0.0)
            for y in (0, 1):
                pairs[x, y] += np.exp(fwd[k - 1, :, x] + step[x, y] + later[y] - total)[on[:, k]].sum()
        main[:, k - 1] = np.exp(fwd[k - 1, :, 1] + bwd[k - 1, :, 1] - total)
    return total, np.where(on, main, 0.0), pairs


def train(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The model of labelled pages; features of fewer than three pages are left out."""
    rows = []
    for page in pages:
        row = []
        for t, linked, node in blocks(page):
            mark, t = t[0], t[1:].strip()
            if mark not in (MAIN, REST):
                raise ValueError("a labelled page has a block without a mark")
            if t:
                row.append((int(mark == MAIN), [*node.features(), *text_features(t, max(0, linked - 1), node)]))
        if row:
            rows.append(row)
    seen = Counter(f for row in rows for f in {f for _, fs in row for f in fs})
    number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    length = np.array([len(r) for r in rows])
    most, pages_n = int(length.max()), len(rows)
    block, feature = [], []
    gold = np.zeros((pages_n, most))
    for p, row in enumerate(rows):
        for k, (y, fs) in enumerate(row):
            gold[p, k] = y
            own = [number[f] for f in fs if f in number]
            feature += own
            block += [p * most + k] * len(own)
    block, feature = np.array(block), np.array(feature)
    on = np.arange(most)[None, :] < length[:, None]
    both = on[:, 1:]
    want_pairs = np.array([[(both & (gold[:, :-1] == x) & (gold[:, 1:] == y)).sum() for y in (0, 1)] for x in (0, 1)], dtype=float)
    size = len(number)
    theta = np.zeros(size + 5)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        emit = np.bincount(block, theta[feature], pages_n * most).reshape(pages_n, most)
        _, main, pairs = chain(emit, length, theta[size], theta[size + 1:].reshape(2, 2))
        off = (gold - main).ravel()
        grad = np.concatenate([np.bincount(feature, off[block], size), [(gold[:, 0] - main[:, 0]).sum()], (want_pairs - pairs).ravel()]) - penalty * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta = theta + 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return Model({f: float(theta[k]) for f, k in number.items()}, float(theta[size]), theta[size + 1:].reshape(2, 2).tolist())


# --- labelled pages by rule ---------------------------------------------------

#: Names that pages give to their parts.
NAMES = {
    "main": ["content", "main content", "post content", "entry content", "article body", "story body", "post", "entry", "text", "article content", "body copy", "page content"],
    "menu": ["nav", "menu", "navbar", "main menu", "navigation", "top nav", "breadcrumb", "breadcrumbs", "site nav", "pagination", "pager", "tabs", "toc links"],
    "header": ["header", "site header", "masthead", "top bar", "banner", "branding", "page header", "logo"],
    "footer": ["footer", "site footer", "colophon", "bottom", "copyright", "legal", "footer links", "credits"],
    "side": ["sidebar", "side", "aside", "widget", "related", "related posts", "popular", "recommended", "trending", "teaser list", "more stories", "right column", "tags", "author bio"],
    "notice": ["notice", "cookie notice", "cookie banner", "consent", "alert", "popup", "modal", "gdpr", "disclaimer", "paywall", "message bar", "warning"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad slot", "banner ad", "sponsor", "promotion", "dfp ad", "affiliate"],
    "form": ["search form", "newsletter", "subscribe", "login", "signup", "contact form", "search box", "poll"],
    "comments": ["comments", "comment list", "comment", "responses", "discussion", "disqus thread", "replies", "respond", "reader comments"],
    "meta": ["byline", "meta", "post meta", "share", "social", "share buttons", "author", "published", "dateline", "tools"],
}
TAGS = {"menu": ["nav", "div", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"],
        "notice": ["div", "section", "p", "aside"], "ad": ["div", "aside", "section", "ins"], "form": ["form"], "comments": ["section", "div", "ol"],
        "meta": ["div", "p", "ul"]}


class _Maker:
    """One labelled page."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.named = rng.random() < 0.85  # else names that tell nothing

    def pick(self, of):
        return of[int(self.rng.integers(0, len(of)))]

    def words(self, low: int, high: int, stop: bool = True) -> str:
        n = int(self.rng.integers(low, high + 1))
        w = ["".join(self.pick("aeioutnsrldmcpé") for _ in range(int(self.rng.integers(1, 9)))) for _ in range(n)]
        if self.rng.random() < 0.12:
            w = [x + self.pick(["&amp;", "%%%", "***", "###", " 12", ","]) for x in w]
        s = " ".join(w)
        if n > 12:
            s = s[:len(s) // 2] + ". " + s[len(s) // 2:]
        return s.capitalize() + ("." if stop and self.rng.random() < 0.9 else "")

    def attr(self, kind: str) -> str:
        if not self.named or self.rng.random() < 0.1:
            return "" if self.rng.random() < 0.6 else f' class="{self.pick("abcdxyz")}{self.rng.integers(0, 99)}"'
        name = self.pick(NAMES[kind])
        return f' {self.pick(["class", "class", "id"])}="{name.replace(" ", self.pick([" ", "-", "_"]))}"'

    def links(self, label: str, low=2, high=8) -> str:
        item = lambda: f'<li><a href="/{self.words(1, 1, False)}">{label}{self.words(1, 4, False)}</a></li>'
        return "<ul>" + "".join(item() for _ in range(int(self.rng.integers(low, high)))) + "</ul>"

    def box(self, kind: str) -> str:
        """A part of the page that is no main text."""
        rng, r = self.rng, REST
        tag = self.pick(TAGS[kind])
        attr = self.attr(kind)
        if kind in ("ad", "notice", "comments", "form") and tag in ("div", "p", "section", "ins", "ol", "aside") and not attr:
            attr = f' class="{self.pick(NAMES[kind])}"'
        sentence = f"<p>{r}{self.words(3, 45)}</p>"
        if kind == "menu":
            inner = self.links(r) if tag != "ul" else self.links(r)[4:-5]
        elif kind == "header":
            inner = self.pick([f"<h1>{r}{self.words(1, 4, False)}</h1>", f"<div><a href='/'>{r}{self.words(1, 3, False)}</a></div>"]) + self.pick(["", f"<p>{r}{self.words(2, 9)}</p>", self.links(r)])
        elif kind == "footer":
            inner = self.pick([f"{r}&copy; {self.words(1, 12)}", f"<p>{r}&copy; {self.words(2, 20)}</p>", f"{r}{self.words(1, 25)}"]) + self.pick(["", self.links(r)])
        elif kind == "side":
            inner = self.pick([f"<h3>{r}{self.words(1, 4, False)}</h3>", ""]) + self.pick([self.links(r), sentence, f"<div><a href='/x'>{r}{self.words(3, 12)}</a></div>" + sentence])
        elif kind == "form":
            inner = f"<label>{r}{self.words(1, 4, False)}</label><input name='q'>" + self.pick(["", f"<p>{r}{self.words(3, 20)}</p>"]) + f"<button>{r}{self.words(1, 2, False)}</button>"
        elif kind == "comments":
            one = lambda: f"<{(t := self.pick(['li', 'div', 'article']))} class='comment'>" + self.pick(["", f"<h4>{r}{self.words(1, 3, False)}</h4>"]) + f"<p>{r}{self.words(1, 60)}</p></{t}>"
            inner = self.pick(["", f"<h3>{r}{self.words(1, 3, False)}</h3>"]) + "".join(one() for _ in range(int(rng.integers(1, 6))))
        else:  # notices, adverts, bylines: bare text or paragraphs, short or long
            inner = self.pick([f"{r}{self.words(1, 40)}", f"{r}{self.words(1, 10)}"] if tag in ("p", "ul", "ins") else [f"{r}{self.words(1, 40)}", sentence, f"<a href='/x'>{r}{self.words(1, 12)}</a>", sentence + sentence])
            if tag == "ul":
                inner = f"<li>{inner}</li>"
        return f"<{tag}{attr}>{inner}</{tag}>"

    def article(self) -> str:
        rng, m = self.rng, MAIN
        out = [f"<h1>{m}{self.words(1, 14)}</h1>"] if rng.random() < 0.85 else []
        if out and rng.random() < 0.1:
            out = [f"<header>{out[0]}</header>"]
        if rng.random() < 0.25:
            out.append(self.box("meta"))
        for _ in range(int(rng.integers(1, 14))):
            x = rng.random()
            if x < 0.66:
                p = self.words(1, 90 if rng.random() < 0.6 else 8)
                if rng.random() < 0.2:
                    p = f"<b>{m}{p}<br>"
                    out.append(f"<p>{p}" + ("</p>" if rng.random() < 0.5 else ""))
                    continue
                if rng.random() < 0.25:
                    p += f" <a href='/l'>{self.words(1, 4, False)}</a> {self.words(1, 20)}"
                out.append(f"<p>{m}{p}" + ("</p>" if rng.random() < 0.9 else ""))
            elif x < 0.74:
                out.append(f"<{(t := self.pick(['h2', 'h3', 'h4']))}>{m}{self.words(1, 9, False)}</{t}>")
            elif x < 0.80:
                out.append("<ul>" + "".join(f"<li>{m}{self.words(1, 25)}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ul>")
            elif x < 0.84:
                out.append(f"<blockquote><p>{m}{self.words(4, 40)}</p></blockquote>")
            elif x < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 3, False)}</td><td>{m}{self.words(1, 3, False)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.90:
                out.append(f"<pre>{m}{self.words(3, 30)}</pre>")
            elif x < 0.93:
                out.append(f"<figure><img src='x'><figcaption>{m}{self.words(3, 15)}</figcaption></figure>")
            else:
                out.append(self.box(self.pick(["ad", "ad", "notice", "form", "side"])))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        kind = rng.random()
        body = self.article()
        if kind < 0.5:
            body = f"<article{self.attr('main') if rng.random() < 0.4 else ''}>{body}</article>"
        elif kind < 0.62:
            body = f"<main>{body}</main>"
        elif kind < 0.9:
            body = f"<div{self.attr('main')}>{body}</div>"
        elif kind < 0.95:
            body = f"<table><tr><td>{body}</td></tr></table>"
        if rng.random() < 0.25:
            body = f"<{(t := self.pick(['main', 'section', 'div']))}{self.attr('main') if rng.random() < 0.5 else ''}>{body}</{t}>"
        before = [k for k in ("header", "menu", "notice", "ad", "form", "side") if rng.random() < (0.7 if k == "menu" else 0.3)]
        after = [k for k in ("meta", "side", "ad", "form", "comments", "notice", "menu") if rng.random() < 0.28]
        if rng.random() < 0.85:
            after.append("footer")
        rng.shuffle(before)
        inner = "".join(self.box(k) for k in before) + body + "".join(self.box(k) for k in after)
        if rng.random() < 0.2:
            inner = f"<div class='{self.pick(['wrapper', 'page', 'container', 'layout', 'site'])}'>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><script>var a='</p>';</script></head><body>{inner}" + ("</body></html>" if rng.random() < 0.9 else "")


def labelled_pages(spark: SparkSession, n: int = PAGES, seed: int = 1) -> DataFrame:
    """``n`` labelled pages (page_id, html), each from its own number and the seed."""

    def make(batches):
        for b in batches:
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([_Maker(np.random.default_rng([seed, i])).page() for i in ids])], ["page_id", "html"])

    return spark.range(0, n, numPartitions=4).mapInArrow(make, "page_id long, html string")


def fit(labelled: DataFrame, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The model of the labelled pages' ``html``, trained in one task."""

    def run(batches):
        pages = sorted(p for b in batches for p in b.column("html").to_pylist() if p)
        if len(pages) > FIT_PAGES:
            raise ValueError(f"at most {FIT_PAGES} labelled pages")
        m = train(pages, steps, penalty)
        names = [*m.weights, "", " 0", " 1", " 2", " 3"]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*m.weights.values(), m.start, *np.ravel(m.step).tolist()])], ["feature", "weight"])

    w = {r["feature"]: r["weight"] for r in labelled.select("html").repartition(1).mapInArrow(run, "feature string, weight double").collect()}
    start, step = w.pop(""), [[w.pop(" 0"), w.pop(" 1")], [w.pop(" 2"), w.pop(" 3")]]
    return Model(w, start, step)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Rows (page_id, url, text, n_chars): every page's main text."""
    columns = [F.col(c) for c in ("page_id", "url", "html")]
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(*columns).schema.fields}

    def run(batches):
        for b in batches:
            texts = [model.main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(*columns).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
