"""HTML main text by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, with
the path of open elements (names, classes, ids, roles).  A bidirectional LSTM in numpy reads
hashed path and word vectors and a few statistics of all blocks of the page, both ways, and
labels every block as main text or not, so each decision uses the whole document.

The network is trained here, on the driver, on pages that ``made_page`` generates with known
labels: a bounded number (``PAGES``), of random layouts and words, and none of any corpus.

Comments, scripts, styles and other raw elements are markup and never blocks; they end at
their own end tag.  Elements that are hidden (``hidden``, ``aria-hidden="true"``, or a style of
their own without display or visibility) are no blocks either.  Text in math belongs to the block around it, that in object is blocks.  Character
references are decoded, white space inside a block becomes one space, blocks are trimmed,
and those labelled main are joined in page order by one space.  Pages are read whole.  Null
or empty html gives the empty text.  Rows with null or repeated page_ids are each extracted.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

PATH, TEXT, STATS = 256, 24, 10
HIDDEN = 16
PAGES = 4500
CELLS = 1 << 13

#: Fixed names of HTML: elements that do not end a block, that have no end tag, and whose content is not text of the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mmultiscripts mprescripts merror maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|iframe"
#: As RAW, but only up to an end tag of the same name: one that is self-closed or never closed hides nothing.
HIDDEN_TAGS = "template|noscript|svg|select|canvas"
#: A start tag of the key ends an open element of the value.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)} | {
    k: ("p",) for k in "article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header main nav ol pre section table ul".split()
}

_IN = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_OWN = r"<(?P=hid)(?=[\s/>])" + _IN
_BODY = r"[^<]*+(?:<(?!/?(?P=hid)[\s/>])[^<]*+)*+"
for _ in range(3):  # nested elements of the same name
    _BODY = rf"[^<]*+(?:(?:<(?!/?(?P=hid)[\s/>])|{_OWN}(?<=/)>|{_OWN}(?<!/)>{_BODY}</(?P=hid)[^>]*+>)[^<]*+)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){_IN}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(?P<hid>{HIDDEN_TAGS})(?=[\s/>]){_IN}(?<!/)>{_BODY}</(?P=hid)[^>]*+>|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_IN})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)")


def _names(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """Names of an element for paths, and whether it is hidden."""
    found, unseen = [tag], False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            found += [f".{x}" for x in _PART.findall(value)]
        unseen |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value) is not None
    return tuple(found), unseen


_short_names = functools.lru_cache(1 << 12)(_names)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def leaf_blocks(source: str | None) -> list[Block]:
    """The blocks of a page in order."""
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    out: list[Block] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = links = unseen = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(path, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal links, unseen
        links -= sum(t == "a" for t, _, _ in stack[k:])
        unseen -= sum(h for _, _, h in stack[k:])
        del stack[k:]

    for m in _TOKEN.finditer(source or ""):
        text = m[9]
        if text is not None:
            if unseen:
                continue
            if not parts and not text.isspace():
                path = tuple(dict.fromkeys(x for _, n, _ in stack for x in n))
            if "&" in text:
                text = html_lib.unescape(text)
            parts.append(text)
            linked += len(text) * (links > 0)
            continue
        name = m[4] or m[7]
        if name is None:
            continue
        name, end = name.lower(), bool(m[3] or m[6])
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if end:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None and not (name in INLINE and any(t not in INLINE for t, _, _ in stack[at + 1 :])):
                close(at)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS.get(name, ()):
                    close(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p", "li", "td", "th", "dt", "dd"):
                    break
            if name not in VOID and not (m[5] or m[8] or "").endswith("/"):
                attrs = m[5] or m[8] or ""
                names, hides = (_short_names if len(attrs) < 256 else _names)(name, attrs)
                stack.append((name, names, hides))
                links += name == "a"
                unseen += hides
    flush()
    return out


@functools.lru_cache(1 << 14)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return (h >> 1) % size, 1.0 if h & 1 else -1.0


def vectors(blocks: list[Block]) -> np.ndarray:
    """(blocks, PATH + TEXT + STATS)."""
    x = np.zeros((len(blocks), PATH + TEXT + STATS))
    for k, b in enumerate(blocks):
        for name in b.path:  # two places each, so that names which share one differ in the other
            for salted in (name, name + "#"):
                i, s = _slot(salted, PATH)
                x[k, i] += s
        ws = b.text.lower().split()
        kinds = set(ws)
        for w in kinds:
            i, s = _slot(w, TEXT)
            x[k, PATH + i] += s
        x[k, PATH : PATH + TEXT] /= 3 * math.sqrt(len(kinds))
        n = len(b.text)
        x[k, PATH + TEXT :] = (
            math.log1p(len(ws)) / 4, b.linked, b.text[-1] in ".!?…", sum(map(b.text.count, ",.;")) / len(ws) / 2, sum(map(str.isdigit, b.text)) / n,
            k / len(blocks), k == 0, k == len(blocks) - 1, "©" in b.text, math.log1p(len(b.path)) / 3,
        )
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = 5, size: int = PATH + TEXT + STATS, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p["W" + way] = rng.normal(0, 1 / math.sqrt(size), (size, 4 * hidden))
            self.p["U" + way] = rng.normal(0, 1 / math.sqrt(hidden), (hidden, 4 * hidden))
            self.p["c" + way] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["v"] = rng.normal(0, 0.3, (2 * hidden, 1))
        self.p["d"] = np.zeros(1)

    def _run(self, x: np.ndarray, real: np.ndarray, way: str, keep: bool):
        """x (steps, pages, size), real (steps, pages): states stay as they are past a page's end."""
        h = c = np.zeros((x.shape[1], self.hidden))
        pre, n = x @ self.p["W" + way] + self.p["c" + way], self.hidden
        out, log = np.zeros((*x.shape[:2], n)), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ self.p["U" + way]
            ifo, g = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = real[t][:, None]
            if keep:
                log.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, c2, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, log

    def chances(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, real, w, False)[0] for w in "fb"], axis=2)
        return 0.5 + 0.5 * np.tanh(0.5 * (both @ self.p["v"] + self.p["d"])[..., 0])

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, grads = self.hidden, {}
        runs = {w: self._run(x, real, w, True) for w in "fb"}
        both = np.concatenate([runs[w][0] for w in "fb"], axis=2)
        p = 0.5 + 0.5 * np.tanh(0.5 * (both @ self.p["v"] + self.p["d"])[..., 0])
        err = np.where(real, p - y, 0)[..., None] / real.sum()
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grads["v"], grads["d"] = flat(both).T @ flat(err), err.sum((0, 1))
        back = err @ self.p["v"].T
        for k, w in enumerate("fb"):
            dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            dz_all, dU = np.zeros((*x.shape[:2], 4 * n)), np.zeros((n, 4 * n))
            for t, h0, c0, i, f, o, g, tc, m in reversed(runs[w][1]):
                dh = dh + back[t][:, k * n : (k + 1) * n]
                dct = np.where(m, dc + dh * o * (1 - tc * tc), 0)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                dU += h0.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.p["U" + w].T
                dc = np.where(m, dct * f, dc)
            grads["W" + w], grads["U" + w], grads["c" + w] = flat(x).T @ flat(dz_all), dU, dz_all.sum((0, 1))
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, real = np.zeros((steps, len(pages), PATH + TEXT + STATS)), np.zeros((steps, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], real[: len(v), k] = v, True
    return x, real


#: Fixed words: class and id names of page parts, and words that such parts often hold.
_JUNK = {
    "nav": "nav menu navbar navigation mainmenu topnav links breadcrumb breadcrumbs pager pagination toc tabs", "header": "header masthead topbar site-header banner logo branding top",
    "footer": "footer site-footer bottom copyright legal colophon foot credits", "aside": "sidebar aside widget related rail recommended trending popular tags side more",
    "ad": "ad ads advert advertisement sponsored sponsor promo promoted banner-ad adsense teaser affiliate", "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning disclaimer paywall",
    "form": "form login search signup subscribe newsletter contact register poll", "share": "share social sharing follow buttons tools print", "comments": "comments comment reply replies discussion respond thread disqus commentlist",
}
_GOOD = "content post entry story body article-body post-content entry-content article-text text main-content article page-content news blog".split()
_TALK = "home about contact login subscribe cookie privacy terms copyright search menu newsletter share comments reply advertisement sponsored sign accept policy rights reserved more read".split()


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of random layout and invented words, and whether each of its leaf blocks is main text."""
    r = rng.choice
    p = lambda x: rng.random() < x
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))

    def phrase(lo: int, hi: int, junk: bool = False) -> str:
        ws = [r(_TALK) if junk and p(0.3) else word() + ("," if p(0.08) else "." if p(0.05) else "") for _ in range(rng.randrange(lo, hi + 1))]
        ws[0] = ws[0].capitalize() if p(0.8) else ws[0]
        return " ".join(ws) + ("." if p(0.3 if hi < 8 else 0.85) else "")

    out, marks = [], []

    def leaf(tag: str, text: str, main: bool, attrs: str = "") -> None:
        inner = f"<{r(['b', 'em', 'span', 'strong'])}>{text}" + ("</b>" if p(0.7) else "<br>") if p(0.12) else f'<a href="/{word()}">{text}</a>' if not main and p(0.35) else text
        out.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if tag not in ("p", "li") or p(0.85) else ""))
        marks.append(main)

    def links() -> None:
        for _ in range(rng.randrange(1, 9)):
            out.append(f'<li><a href="/{word()}">')
            out.append(phrase(1, 3, True) if p(0.7) else phrase(3, 10))
            out.append("</a></li>")
            marks.append(False)

    def column() -> None:
        """A column beside the article that no name tells apart: links, most often with a heading."""
        out.append("<td>" if grid else r(["<div>", f'<div class="{beside}">']))
        if p(0.8):
            leaf(r(["h2", "h3", "h4", "p", "div"]), phrase(1, 4, p(0.5)), False)
        out.append("<ul>")
        links()
        out.append("</ul></td>" if grid else "</ul></div>")

    def junk(kind: str, cell: bool = False) -> None:
        names = _JUNK[kind].split()
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "section") if p(0.5) else r(["div", "div", "section", "ul" if kind == "nav" else "div"])
        tag = "td" if cell else tag
        named = p(0.8 if kind in ("nav", "share") else 1) if tag in ("div", "section", "ul", "td") else p(0.4)
        attrs = (f' {r(["class", "class", "id"])}="{" ".join(dict.fromkeys([r(names), *([word()] if p(0.3) else [])]))}"' if named else "") + (f' data-x="{word()}"' if p(0.1) else "")
        out.append(f"<{tag}{attrs}>")
        lone = kind == "footer" and p(0.4)  # a copyright line and nothing else
        if lone:
            out.append(f"&copy; {word()}.example {phrase(1, 12, p(0.5))}")
            marks.append(False)
        elif kind == "nav" and tag != "ul" and (named or tag == "nav") and p(0.5 if cell else 0.3):  # a menu in one line, with links or without
            plain = named and p(0.6)
            out.append(r([" ", " | ", "<br>"]).join(phrase(1, 2, True) if plain else f'<a href="/{word()}">{phrase(1, 2, True)}</a>' for _ in range(rng.randrange(1, 7))))
            marks.append(False)
        elif kind in ("nav", "share") or kind in ("header", "footer", "aside") and p(0.4):
            if tag != "ul" and p(0.6 if kind == "aside" else 0.1):
                leaf(r(["h2", "h3", "h4", "p", "div"]), phrase(1, 4, True), False)
            many = tag != "ul" and p(0.7)
            out.append("<ul>" if many else "")
            links()
            out.append("</ul>" if many else "")
        elif kind == "comments":
            for _ in range(rng.randrange(1, 5)):
                leaf(r(["p", "div", "li", "p"]), phrase(4, 40), False, f' class="{r(names)}"' if p(0.5) else "")
        elif p(0.4):
            out.append(phrase(2, 14, kind != "ad" or p(0.5)))
            marks.append(False)
        else:
            for _ in range(rng.randrange(1, 4)):
                leaf(r(["p", "div", "h3", "p", "label"]) if kind != "form" else r(["p", "div", "h3", "button"]), phrase(1, 25, p(0.6)), False)
        if kind == "footer" and not lone and p(0.7):
            out.append(f"<p>&copy; {word()}.example &middot; {phrase(1, 8, True)}</p>")
            marks.append(False)
        out.append(f"</{tag}>")

    title = phrase(2, 9)
    out.append("<!DOCTYPE html><html><head><meta charset='utf-8'>")
    if p(0.75):
        out.append(f"<title>{title}</title>")
        marks.append(False)
    out.append("<style>p{margin:0}</style></head><body>" if p(0.5) else "<script>var t='</p>';</script></head><body>")
    wrap = p(0.3)
    out.append('<div class="%s">' % r(["wrap", "container", "page", "site", word()]) if wrap else "")
    bare = p(0.15)  # nothing but the article
    grid = not bare and p(0.2)  # laid out as a table
    beside = r(["col", "column", "grid", word()])
    pair = not (bare or grid) and p(0.12)  # two columns of one name
    out.append(f"<div {r(['hidden', 'aria-hidden=true', 'style=display:none'])}><p>{phrase(3, 20)}</p></div>" if p(0.1) else "")
    for kind in () if bare else ("header", "nav", "notice", "ad", "share", "aside"):
        if p({"header": 0.4, "nav": 0.7}.get(kind, 0.25)):
            junk(kind)
    if grid:
        out.append(f"<table{r(['', ' border=0', ' width=100%'])}><tr>")
        if p(0.4):
            junk("header", True)
            out.append("</tr><tr>")
        if p(0.7):
            junk(r(["nav", "nav", "nav", "aside"]), True)
        out.append("<td%s>" % r(["", "", " valign=top", f' class="{r(_GOOD)}"']))
    out.append(f'<div class="row"><div class="{beside}">' if pair else "")
    tag, attrs = r([("article", ""), ("article", f' class="{r(_GOOD)}"'), ("main", ""), ("div", f' class="{r(_GOOD)}"'), ("div", f' id="{r(_GOOD)}"'), ("section", f' class="{r(_GOOD)}"'), ("article", ""), ("div", ""), ("div", ""), ("section", ""), ("div", f' class="{word()}"'), ("", "")])
    out.append(f"<{tag}{attrs}>" if tag else "")
    if bare and p(0.2):  # text without any elements of its own
        out.append("<br><br>".join(phrase(4, 60) for _ in range(rng.randrange(1, 5))))
        out.append(f"</{tag}>" if tag else "")
        marks.append(True)
        return "".join(out), marks
    inner = p(0.2)
    if p(0.8):
        head = p(0.15)
        out.append("<header>" if head and tag in ("article", "main") else "")
        leaf(r(["h1", "h1", "h2"]), title, True)
        out.append("</header>" if head and tag in ("article", "main") else "")
    out.append(f'<div class="{r(_GOOD)}">' if inner else "")
    for _ in range(rng.randrange(1, 4) if p(0.3) else rng.randrange(1, 16) if p(0.9) else rng.randrange(15, 40)):
        what = rng.random()
        if what < 0.1 and len(marks) > 2 and not bare:
            junk(r(["ad", "share", "aside", "form", "notice", "ad"]))
        elif what < 0.2:
            leaf(r(["h2", "h3", "h4"]), phrase(1, 7), True)
        elif what < 0.28:
            out.append("<ul>")
            for _ in range(rng.randrange(1, 6)):
                leaf("li", phrase(1, 20), True)
            out.append("</ul>")
        elif what < 0.31:
            out.append("<table>")
            for k in range(rng.randrange(1, 4)):
                out.append("<tr>")
                for _ in range(rng.randrange(1, 4)):
                    leaf("td" if k else r(["td", "th"]), phrase(1, 6), True)
                out.append("</tr>")
            out.append("</table>")
        else:
            leaf(r(["p", "p", "p", "p", "p", "blockquote", "pre", "p" if grid else "td", "div"]), phrase(1, r([1, 2, 12, 16])) if p(0.35) else phrase(8, 120), True)
    out.append("</div>" if inner else "")
    if p(0.15) and not bare:
        junk("comments")
    out.append(f"</{tag}>" if tag else "")
    out.append("</div>" if pair else "")
    if pair or not (bare or grid) and p(0.1):
        column()
    out.append("</div>" if pair else "")
    if grid:
        out.append("</td>")
        if p(0.4):
            column() if p(0.5) else junk(r(["aside", "nav", "ad", "notice", "form"]), True)
        if p(0.4):
            out.append("</tr><tr>")
            junk("footer", True)
        out.append("</tr></table>")
    for kind in () if bare else ("footer",) if p(0.4) else ("share", "comments", "aside", "ad", "form", "notice", "nav", "footer"):
        if p({"footer": 0.8, "comments": 0.35}.get(kind, 0.2)):
            junk(kind)
    out.append("</div>" if wrap else "")
    if p(0.8):
        out.append("</body></html>")
    return "".join(out), marks


@functools.lru_cache(2)
def trained(pages: int = PAGES, epochs: int = 9, seed: int = 3) -> Labeller:
    """Trained by Adam on ``pages`` generated pages; the same on every run."""
    rng, maker, net = np.random.default_rng(seed), random.Random(seed), Labeller()
    data = []
    while len(data) < pages:
        source, marks = made_page(maker)
        blocks = leaf_blocks(source)
        if len(blocks) == len(marks):  # the generator may nest what the parser merges
            data.append((vectors(blocks), np.array(marks, float)))
    data.sort(key=lambda d: len(d[0]))
    parts = [data[k : k + 40] for k in range(0, len(data), 40)]
    first, second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        for k in rng.permutation(len(parts)):
            x, real = padded([v for v, _ in parts[k]])
            y = np.zeros(real.shape)
            for j, (_, marks) in enumerate(parts[k]):
                y[: len(marks), j] = marks
            step += 1
            for name, g in net.gradients(x, real, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net.p[name] = net.p[name] - 0.02 * 0.75**epoch * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return net


def main_texts(sources: list[str | None], net: Labeller) -> list[str]:
    pages = [leaf_blocks(s) for s in sources]
    out = [""] * len(pages)
    order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
    while order:
        most = max(1, CELLS // len(pages[order[-1]]))
        now, order = order[-most:], order[:-most]
        chance = net.chances(*padded([vectors(pages[k]) for k in now]))
        for j, k in enumerate(now):
            out[k] = " ".join(b.text for b, c in zip(pages[k], chance[:, j]) if c >= 0.5)
    return out


def extract(pages: DataFrame, net: Labeller | None = None, step: int = 256) -> DataFrame:
    """page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(net or trained())  # some 20,000 numbers

    def run(batches):
        for b in batches:
            source, out = b["html"].tolist(), []
            for s in range(0, len(source), step):
                out += main_texts(source[s : s + step], sent.value)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out})

    rows = lean(pages, page_id="bigint", url="string", html="string")
    return rows.mapInPandas(run, "page_id bigint, url string, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))
