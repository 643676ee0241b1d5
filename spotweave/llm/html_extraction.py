"""HTML extraction: a linear-chain conditional random field over the DOM's leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks (text between block-level tags) with the tags, classes, ids and roles of their
ancestors. Each block gets ancestor and text features, and coarse ones of its neighbours' links and words and of its container's share of the page, links and sentences; the field has one weight for every feature and label (main text
or not) and one for every pair of labels in a row. It is trained by gradient ascent on the log-likelihood of the
labelled pages in `labelled_pages`, which are few, fixed and made here; pages to extract are never trained on, and never
move: the weights go to them.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line break.
`<br>` is white space. Scripts, styles, comments, templates, titles and the text areas of forms are left out. Formulas and
drawings are text of the block that they stand in; what stands in an object, video, frame or the like is a block of its own.

Defined cases: pages of any length and depth are read whole, in time linear in both; null or empty html gives an empty text; markup that is cut off or badly nested is read as far as it
goes (an unclosed tag at the end is dropped, so is what follows a script or style that never ends); repeated rows each get their result; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea noframes title".split())
#: Elements within text whose content is a block of its own; they end no paragraph.
_EMBED = frozenset("noscript select iframe object canvas audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|data-main)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
#: What notices, adverts, forms and the like say of themselves.
_DIGIT = re.compile(r"\d")
_SAYS = "cookie consent privacy subscri newsletter login accept advert sponsor comment reply register datenschutz anmelden anzeige publicidad publicit suscr inscri abonn".split() + ["sign up", "sign in", "log in", "share this", "share on", "click here", "read more"]


class Node:
    """An open element: its parent, its tag, and the features of the ancestors that it is the first to have."""

    __slots__ = ("parent", "tag", "fresh", "main", "score")

    def __init__(self, parent: Node | None, tag: str, fresh: tuple[str, ...], main: bool):
        self.parent, self.tag, self.fresh, self.main, self.score = parent, tag, fresh, main, None


def blocks(html: str) -> Iterator[tuple[str, Node | None, int, bool]]:
    """(text, innermost element, link characters, labelled) of each leaf block, in page order.

    Time and memory grow with the page's length, however deep its elements are nested: an element keeps a pointer to
    its parent and the features that no ancestor has.
    """
    stack: list[tuple[Node, tuple[str, ...]]] = []
    open_tags: dict[str, int] = {}
    active: dict[str, int] = {}
    parts: list[str] = []
    links: list[int] = []
    in_link = False
    endless: set[str] = set()

    def flush():
        nonlocal parts, links
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                node = stack[-1][0] if stack else None
                yield text, node, min(sum(links), len(text)), bool(node and node.main)
            parts, links = [], []

    def push(name: str, names: tuple[str, ...], main: bool) -> None:
        mine = (*(() if name in ("html", "body") else (f"in:{name}",)), *(f"name:{w}" for w in names))
        fresh = tuple(f for f in mine if not active.get(f))
        for f in mine:
            active[f] = active.get(f, 0) + 1
        parent = stack[-1][0] if stack else None
        stack.append((Node(parent, name, fresh, main or bool(parent and parent.main)), mine))
        open_tags[name] = open_tags.get(name, 0) + 1

    def pop() -> str:
        node, mine = stack.pop()
        for f in mine:
            active[f] -= 1
        open_tags[node.tag] -= 1
        return node.tag

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        m = _TOKEN.match(html, lt) if lt < end else None
        if lt > at or not m:
            chunk = html[at : lt if m or lt == end else lt + 1]
            parts.append(chunk)
            if in_link:
                links.append(len(chunk))
            if not m:
                at = lt + 1
                continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name == "a":
            in_link = not closing
        elif name in _RAW:
            if not closing and not attrs.endswith("/") and name not in endless:
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                if stop:
                    at = stop.end()
                elif name in ("script", "style"):
                    at = end
                else:  # never closed: what follows is read as if the tag weren't there
                    endless.add(name)
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK or name in _EMBED:
            yield from flush()
            if name == "hr":
                continue
            if closing:
                if open_tags.get(name):
                    while pop() != name:
                        pass
                in_link = in_link and name in _EMBED
                continue
            while name in _BLOCK and stack and ((top := stack[-1][0].tag) == "p" or top in _HEADINGS or top == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                pop()
            names, main = (), False
            if attrs and ("=" in attrs or "data-main" in attrs):
                found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)}
                main = "data-main" in found
                names = tuple(sorted({w for k, v in found.items() if k != "data-main" for w in _NAME.findall(v.lower())}))
            if name not in _VOID and not (name in _EMBED and attrs.endswith("/")):
                push(name, names, main)
    yield from flush()


def _path_features(node: Node | None) -> list[str]:
    """Features of the ancestors: their tags and the words of their classes, ids and roles."""
    out: list[str] = []
    while node:
        out += node.fresh
        node = node.parent
    return sorted(out)


def _shape(text: str, node: Node | None, linked: int) -> tuple:
    """Coarse features of a block: its tag, length, share of links, ends like a sentence, commas, words, odd characters, what it says."""
    n = len(text)
    words = text.count(" ") + 1
    share = linked / n
    return (
        node.tag if node else "-", min(n.bit_length(), 11), 0 if not linked else 1 if share < 0.4 else 2 if share < 0.9 else 3, text[-1] in ".!?:;…。\"'”)", min(text.count(","), 3),
        0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3, "©" in text or "(c)" in text, "|" in text or "·" in text or "»" in text, len(_DIGIT.findall(text, 0, 40)) > 8, any(map(text[:300].lower().__contains__, _SAYS)),
    )


def _shape_features(shape: tuple) -> list[str]:
    tag, n, link, ends, commas, words, rights, bars, digits, says = shape
    out = [f"tag:{tag}", f"len:{n}", f"link:{link}", f"ends:{ends}", f"commas:{commas}", f"words:{words}", f"rights:{rights}", f"bars:{bars}", f"digits:{digits}", f"says:{says}"]
    return [*out, f"ends:{ends} words:{words}", f"tag:{tag} link:{link}", f"tag:{tag} words:{words}", f"says:{says} words:{words}"]


def _context(found: list[tuple]) -> list[tuple]:
    """Coarse features of what is around each block: the page's number of blocks; of the element that the block's own element stands in, its share
    of the page's text, share of links and sentences; links and words of the blocks before and after."""
    seen: dict[int, list[int]] = {}
    mine, kinds, total = [], [("-", "-")], 0
    for text, node, linked, _ in found:
        box = node.parent if node and node.parent and (node.tag in ("p", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote") or node.tag in _HEADINGS) else node
        sums = seen.setdefault(id(box), [0, 0, 0])
        n, words = len(text), text.count(" ") + 1
        sums[0] += n
        sums[1] += linked
        sums[2] += words > 5 and text[-1] in ".!?:;…。\"'”)"
        total += n
        mine.append(sums)
        kinds.append((0 if not linked else 1 if linked < 0.6 * n else 2, 0 if words < 4 else 1 if words < 12 else 2))
    kinds.append(("-", "-"))
    size = min(len(found).bit_length(), 4)
    return [(size, 0 if c < 0.02 * total else 1 if c < 0.1 * total else 2 if c < 0.4 * total else 3, 0 if not k else 1 if k < 0.3 * c else 2 if k < 0.8 * c else 3, min(e, 3), *kinds[i], *kinds[i + 2]) for i, (c, k, e) in enumerate(mine)]


def _context_features(context: tuple) -> list[str]:
    size, share, links, sentences, before, shorter, after, longer = context
    return [f"blocks:{size}", f"share:{share}", f"box links:{links}", f"sentences:{sentences}", f"share:{share} sentences:{sentences}", f"share:{share} blocks:{size}", f"links:{links} sentences:{sentences}", f"before:{before} {shorter}", f"after:{after} {longer}"]


class Field:
    """Weights of a two-label linear chain; label 1 is main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], pairs: np.ndarray, start: np.ndarray):
        self.weights, self.pairs, self.start = weights, pairs, start
        self._shapes: dict = {}
        self._contexts: dict = {}

    def _sum(self, features: Iterable[str]) -> float:
        return sum(w[1] - w[0] for f in features if (w := self.weights.get(f)))

    def _path_score(self, node: Node | None) -> float:
        """Sum over the ancestors' features; each element adds its own to its parent's sum, once."""
        above = []
        while node and node.score is None:
            above.append(node)
            node = node.parent
        total = node.score if node else 0.0
        for n in reversed(above):
            total += self._sum(n.fresh)
            n.score = total
        return total

    def scores(self, found: list[tuple]) -> list[float]:
        """For each block, how much more label 1 scores than label 0."""
        out = []
        for (text, node, linked, _), context in zip(found, _context(found), strict=True):
            shape = _shape(text, node, linked)
            if (s := self._shapes.get(shape)) is None:
                s = self._shapes[shape] = self._sum(_shape_features(shape))
            if (c := self._contexts.get(context)) is None:
                c = self._contexts[context] = self._sum(_context_features(context))
            out.append(self._path_score(node) + s + c)
        return out

    def decode(self, found: list[tuple]) -> list[int]:
        """The most likely labels, by Viterbi."""
        scores = self.scores(found)
        (a, b), (c, d) = self.pairs.tolist()
        zero, one = self.start.tolist()
        back = []
        for k, s in enumerate(scores):
            if k:
                back.append((int(zero + a < one + c), int(zero + b <= one + d)))
                zero, one = max(zero + a, one + c), max(zero + b, one + d) + s
            else:
                one += s
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        found = list(blocks(html)) if html else []
        return "\n".join(f[0] for f, y in zip(found, self.decode(found), strict=True) if y) if found else ""


def _expected(e: np.ndarray, t: np.ndarray, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums of all pages at once: the probability of label 1 for each block, and the expected pairs
    of labels in a row. e: pages x blocks x 2 scores; size: blocks of each page (the rest is ignored)."""
    pages, n, _ = e.shape
    add = np.logaddexp
    forward, backward = np.zeros((n, pages, 2)), np.zeros((n, pages, 2))
    forward[0] = s + e[:, 0]
    for k in range(1, n):
        forward[k] = add(forward[k - 1][:, :1] + t[0], forward[k - 1][:, 1:] + t[1]) + e[:, k]
    last = np.maximum(size - 1, 0)
    z = add(*forward[last, np.arange(pages)].T)
    for k in range(n - 2, -1, -1):
        x = e[:, k + 1] + backward[k + 1]
        backward[k] = np.where((k < last)[:, None], add(x[:, :1] + t[:, 0], x[:, 1:] + t[:, 1]), 0.0)
    inside = np.arange(n)[:, None] < size
    one = np.where(inside, np.exp(np.where(inside, forward[..., 1] + backward[..., 1] - z, -np.inf)), 0.0)
    pairs = np.zeros((2, 2))
    for k in range(n - 1):
        some = np.flatnonzero(k < last)
        both = forward[k, some, :, None] + t + (e[some, k + 1] + backward[k + 1, some])[:, None, :] - z[some, None, None]
        pairs += np.exp(both).sum(0)
    return one.T, pairs


def train(pages: list[str], rounds: int = 120, rate: float = 0.4, decay: float = 0.0004) -> Field:
    """Maximum likelihood with L2 decay: forward-backward gradients on all pages at once, Adagrad steps."""
    names: dict[str, int] = {}
    owner, feats, labels, size = [], [], [], []
    for page in pages:
        before = len(labels)
        found = list(blocks(page))
        for (text, node, linked, main), context in zip(found, _context(found), strict=True):
            mine = [names.setdefault(f, len(names)) for f in _path_features(node) + _shape_features(_shape(text, node, linked)) + _context_features(context)]
            owner += [len(labels)] * len(mine)
            feats += mine
            labels.append(int(main))
        size.append(len(labels) - before)
    owner, feats, y, size = np.array(owner), np.array(feats), np.array(labels), np.array(size)
    page_of, place = np.repeat(np.arange(len(pages)), size), np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size)
    firsts, follow = y[place == 0], np.flatnonzero(place > 0)
    seen_pairs = np.bincount(y[follow - 1] * 2 + y[follow], minlength=4).reshape(2, 2)
    w, t, s = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-8) for x in (w, t, s)]
    for _ in range(rounds):
        flat = np.stack([np.bincount(owner, w[feats, c], len(y)) for c in (0, 1)], 1)
        e = np.zeros((len(pages), size.max(), 2))
        e[page_of, place] = flat
        one, pairs = _expected(e, t, s, size)
        p, first = one[page_of, place], one[size > 0, 0]
        d = y - p
        gw = np.bincount(feats, d[owner], len(names))
        grads = (np.stack([-gw, gw], 1) - decay * len(pages) * w, seen_pairs - pairs - decay * len(pages) * t, np.array([first.sum() - firsts.sum(), firsts.sum() - first.sum()]) - decay * len(pages) * s)
        for x, grad, total in zip((w, t, s), grads, sums, strict=True):
            total += grad * grad
            x += rate * grad / np.sqrt(total)
    return Field({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, t, s)


#: Kinds of layout of the labelled pages, and the share of pages of each.
KINDS = {"usual": 0.56, "bare": 0.06, "table": 0.08, "blog": 0.08, "hashed": 0.08, "contents": 0.05, "forum": 0.06, "plain": 0.03}


def labelled_pages(n: int = 480, seed: int = 7, kinds: Iterable[str] = tuple(KINDS)) -> list[str]:
    """Pages of many layouts, made here, with `data-main` on what is main text.

    Names of classes are from lists, made up, or left out, so that tags, text and neighbours count as well as names.
    """
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v z sh tr st".split() for b in "a e i o u en or il".split()]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def words(n: int) -> str:
        return " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(n)).strip(",").capitalize()

    def sentence() -> str:
        return words(r.randint(1, 22)) + r.choice("....?!") + (r.choice(["&amp;&amp;", "***", "$$$", " (12)", " [3]"]) if r.random() < 0.1 else "")

    def para() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8])))

    def says() -> str:
        return r.choice([
            "We use cookies to improve this site.", "By using this page you accept our privacy policy.", "Subscribe to our newsletter.", "Sign up for free.", "Log in or register to go on.", "Accept all cookies.", "Advertisement", "Sponsored content",
            "Share this page", "Diese Seite verwendet Cookies.", "Datenschutz und Cookies", "Anzeige", "Publicidad", "Publicité", "Read more", "Click here to buy.", "Your consent is needed for cookies.",
        ]) + r.choice(["", "", " " + sentence()])

    def items(a: int, b: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{words(r.randint(1, 3))}{r.choice(["", "", ".", ","])}</a></{tag}>' for _ in range(r.randint(a, b)))

    def cls(*names: str) -> str:
        """One of the names, with a made-up one beside it at times; or only that; or none."""
        x = r.random()
        own = r.choice(names) + r.choice(["", "", "-" + word(), " " + word()]) if x < 0.75 else word()
        return "" if x > 0.9 else f'{r.choice(["class", "class", "id"])}="{own}"'

    def menu() -> str:
        return r.choice([
            lambda: f"<nav><ul>{items(3, 8)}</ul></nav>", lambda: f'<div {cls("menu", "navbar", "main-menu", "nav", "navigation", "top-nav", "links", "toolbar")}><ul>{items(3, 9)}</ul></div>',
            lambda: f'<header><div {cls("logo", "brand", "site-title")}>{words(2)}</div><nav>{items(3, 6, "span")}</nav></header>', lambda: f'<div {cls("header", "site-header", "masthead", "top-bar", "banner")}><h2>{words(2)}</h2><p>{words(4)}.</p></div>',
            lambda: f"<header><h1>{words(2)}</h1><p>{sentence()}</p></header>", lambda: f'<ul {cls("breadcrumb", "breadcrumbs", "crumbs")}>{items(2, 4)}</ul>', lambda: f'<div role="navigation">{items(3, 6, "div")}</div>',
            lambda: f'<div {cls("menu", "nav")}>' + " | ".join(f'<a href="/{k}">{words(1)}</a>' for k in range(r.randint(3, 7))) + "</div>",
        ])()

    def advert() -> str:
        return f'<{(t := r.choice(["div", "div", "aside", "section"]))} {cls("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-box", "sponsor", "adsbygoogle", "ad-slot")}>{r.choice([sentence, says, para, lambda: f"<p>{sentence()}</p>", lambda: f"<p>{says()}</p>"])()}</{t}>'

    def notice() -> str:
        text = r.choice([says, says, para])()
        return f'<div {cls("cookie", "cookie-notice", "cookies", "notice", "consent", "gdpr-banner", "alert", "newsletter", "subscribe", "popup", "modal", "disclaimer", "overlay", "privacy", "window", "dialog", "bar")}><p>{text}</p>{r.choice(["<button>", "<a href=/ok>"])}{r.choice([words(1), "OK", "Accept"])}</div>'

    def side() -> str:
        return r.choice([
            lambda: f"<aside><h3>{words(2)}</h3><ul>{items(2, 6)}</ul><p>{sentence()}</p></aside>", lambda: f'<div {cls("sidebar", "related", "widget", "popular", "recommended", "tags", "share", "social", "toc", "rail")}><h4>{words(2)}</h4>{r.choice([f"<ul>{items(2, 5)}</ul>", f"<p>{para()}</p>"])}</div>',
            lambda: f'<form action="/s"><label>{words(2)}</label><input name="q"><p>{sentence()}</p><button>{words(1)}</button></form>', lambda: f'<div {cls("login", "search", "search-form", "signup")}><form><p>{words(3)}</p></form></div>',
        ])()

    def comments() -> str:
        return f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "responses", "discussion", "disqus", "replies", "comments-area"])}"><h3>{words(2)}</h3>' + "".join(f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><p>{para()}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>"

    def foot() -> str:
        return r.choice([
            lambda: f"<footer>&copy; {words(1)}.example.com &middot; {sentence()}</footer>", lambda: f'<div {cls("footer", "site-footer", "copyright", "bottom", "legal")}><p>&copy; 2024 {words(3)}. All rights reserved.</p><ul>{items(2, 5)}</ul></div>',
            lambda: f"<footer><p>{para()}</p><ul>{items(2, 6)}</ul></footer>", lambda: f'<div role="contentinfo"><p>{sentence()}</p></div>',
            lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["footer", "site-footer", "page-footer"])}"><ul><li>{sentence()}</li><li>{sentence()}</li><li><a href="/p">{words(2)}</a></li></ul></div>',
        ])()

    def body(mark: str) -> str:
        out = [f"<h{(h := r.choice([1, 1, 2]))}{mark}>{words(r.randint(2, 10))}{r.choice(['', '.'])}</h{h}>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 10)):
            out.append(r.choice([
                *[lambda: f"<p{mark}>{para()}</p>"] * 8, lambda: f"<p{mark}><b>{sentence()}</b><br>{sentence()}", lambda: f"<p{mark}>{para()}", lambda: f"<h3{mark}>{words(3)}</h3>", lambda: f"<blockquote{mark}>{para()}</blockquote>",
                lambda: f"<ul{mark}>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>", lambda: f'<p{mark}>{sentence()} <a href="/y">{words(2)}</a> {sentence()}</p>', lambda: f"<pre{mark}>{words(9)}</pre>",
                lambda: f"<div{mark}>{para()}</div>", lambda: f"<table{mark} {cls('infobox', 'data', 'wikitable')}><tr><th>{words(1)}</th><td>{words(2)}</td><td>{words(1)} 12</td></tr></table>", lambda: f"<figure{mark}><img src=x><figcaption>{sentence()}</figcaption></figure>",
                lambda: f"<p{mark}>{words(2)}.</p>", lambda: f"<p{mark}>{words(1)}</p>", lambda: f"<p{mark}>{sentence()} {says()} {sentence()}</p>", lambda: f"<section{mark} {cls('banner-text', 'hero', 'section', 'intro', 'lead', 'notes', 'highlight', 'box')}><h2>{words(3)}</h2><p>{para()}</p><p>{para()}</p></section>",
            ])())
            if r.random() < 0.12:
                out.append(advert())
        if r.random() < 0.15:
            out.append(f"<div{mark} {cls('reflist', 'references', 'footnotes', 'notes')}><ol>" + "".join(f'<li><a href="#c">^</a> {sentence()}</li>' for _ in range(r.randint(1, 4))) + "</ol></div>")
        return "".join(out)

    def article() -> str:
        inside = body(" data-main")
        return r.choice([
            *[lambda: f"<article>{inside}</article>"] * 4, lambda: f"<main>{inside}</main>", lambda: f"<main><article>{inside}{r.choice(['', comments()])}</article></main>",
            *[lambda: f'<div {cls("content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "text", "mw-body", "parser-output", "page-content")}>{inside}</div>'] * 3,
            lambda: f'<div {cls("container", "wrapper", "page")}><section>{inside}</section></div>', lambda: f'<div role="main">{inside}</div>', lambda: f"<div>{inside}</div>", lambda: f'<div {cls("content")}><div {cls("output", "body")}>{inside}</div></div>',
        ])()

    def hashed() -> str:
        """A class that says nothing."""
        return f'class="{r.choice(["css", "sc", "jsx", "x", "c"])}-{r.choice([str(r.randint(1, 999)), word()])}"'

    def byline() -> str:
        return r.choice([f'Posted on <a href="/d">{r.randint(1, 28)} {words(1)} 20{r.randint(10, 24)}</a> by <a href="/u">{words(2)}</a>', f"By {words(2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.2021, {r.randint(0, 23)}:15", f"{words(1)}, {r.randint(2, 30)} min"])

    def blog() -> str:
        many = r.randint(1, 40)
        head = f'<{(t := r.choice(["header", "div"]))} class="{r.choice(["entry-header", "post-header", "post-head"])}"><h1 data-main>{words(r.randint(2, 8))}</h1><{(u := r.choice(["div", "p"]))} class="{r.choice(["entry-meta", "post-meta", "byline", "meta", "posted-on"])}">{byline()}</{u}></{t}>'
        tail = f'<{(t := r.choice(["footer", "div", "p"]))} class="{r.choice(["entry-footer", "post-footer", "entry-meta", "post-tags", "cat-links", "meta"])}">{r.choice(["Filed under", "Posted in", "Tagged", "Categories:", "Topics", words(2)])} {r.choice(["", words(2)])}{", ".join(f"<a href=/t>{words(1)}</a>" for _ in range(r.randint(0, 4)))}</{t}>'
        said = "".join(f'<{(t := r.choice(["li", "div"]))} class="{r.choice(["comment", "comment even", "depth-1 comment"])}"><div class="comment-meta">{words(2)} {r.choice(["says:", "on 3 May 2020"])}</div><p>{para()}</p><a href=#r>Reply</a></{t}>' for _ in range(r.randint(0, 4)))
        talk = f'<div id="comments" class="comments-area"><h{(h := r.choice([2, 3]))} class="comments-title">{many} {r.choice(["thoughts", "comments", "responses", "replies", words(1)])}{r.choice(["", f" on {words(3)}"])}</h{h}><ol class="comment-list">{said}</ol>{r.choice(["", f"<div id=respond><h3>Leave a reply</h3><form><p>{sentence()}</p><button>Send</button></form></div>"])}</div>'
        return f'{menu()}<{(t := r.choice(["article", "div"]))} class="post {word()}">{head}<div class="{r.choice(["entry-content", "post-content", "entry", "the-content"])}">{body(" data-main")}</div>{tail}</{t}>{r.choice([talk, talk, ""])}{r.choice([side(), ""])}{foot()}'

    def nameless() -> str:
        """Nothing but made-up classes: tags, text and neighbours have to tell."""
        links = lambda a, b: "".join(f'<{(t := r.choice(["div", "span", "li"]))} {hashed()}><a href="/x">{words(r.randint(1, 7))}</a></{t}>' for _ in range(r.randint(a, b)))
        inside = f"<h1 {hashed()} data-main>{words(r.randint(3, 9))}</h1>" + "".join(r.choice([lambda: f"<p {hashed()} data-main>{para()}</p>", lambda: f"<div {hashed()} data-main>{sentence()} {para()}</div>", lambda: f"<h2 {hashed()} data-main>{words(3)}</h2><p {hashed()} data-main>{para()}</p>"])() for _ in range(r.randint(2, 8)))
        more = f'<div {hashed()}><h{(h := r.choice([2, 3, 4]))}>{r.choice(["More on this", "Read next", "You may also like", "Related", words(3)])}{r.choice(["", " " + words(1)])}</h{h}>{links(1, 5)}</div>'
        return f"<div {hashed()}><div {hashed()}>{links(3, 7)}</div><div {hashed()}>{inside}</div>{r.choice([more, more, ''])}<div {hashed()}>{r.choice([f'&copy; 2022 {words(2)}', sentence()])} {links(0, 4)}</div></div>"

    def contents() -> str:
        toc = f'<{(t := r.choice(["div", "nav", "div"]))} {r.choice(["id=toc class=toc", "class=toc", "class=table-of-contents", "class=contents"])}><h{(h := r.choice([2, 3]))}>{r.choice(["Contents", "On this page", "In this article", words(1)])}</h{h}><{(u := r.choice(["ul", "ol"]))}>' + "".join(f'<li><a href="#s{k}">{r.choice(["", f"{k + 1} "])}{words(r.randint(1, 4))}</a>{r.choice(["", f"<ul><li><a href=#s{k}a>{k + 1}.1 {words(2)}</a></li></ul>"])}</li>' for k in range(r.randint(2, 8))) + f"</{u}></{t}>"
        return f'{menu()}<div id="content" class="{r.choice(["mw-body", "page", "content", "document"])}"><h1 data-main>{words(2)}</h1><div class="{r.choice(["mw-parser-output", "body", "text"])}"><p data-main>{para()}</p>{toc}{body(" data-main")}</div></div>{foot()}'

    def forum() -> str:
        item, text = r.choice([("post", "post-body"), ("message", "message-content"), ("reply-post", "content"), ("post", "postbody"), ("topic-post", "cooked"), ("row", "text")])
        posts = "".join(f'<div class="{item}" id="p{k}"><{(t := r.choice(["div", "span", "p"]))} class="{r.choice(["author", "username", "poster", "user"])}">{words(r.randint(1, 2))}</{t}>{r.choice(["", f"<div class=date>{r.randint(1, 28)} May 20{r.randint(10, 24)}, {r.randint(0, 23)}:{r.randint(10, 59)}</div>"])}<div class="{text}" data-main>{r.choice([para(), f"<p>{para()}</p><p>{sentence()}</p>"])}</div>{r.choice(["", "<div class=buttons><a href=#q>Quote</a> <a href=#r>Reply</a></div>"])}</div>' for k in range(r.randint(2, 6)))
        return f'{menu()}<div class="{r.choice(["thread", "topic", "forum", "posts", "viewtopic"])}"><h{(h := r.choice([1, 2]))} data-main>{words(r.randint(3, 9))}</h{h}>{posts}</div>{r.choice(["", f"<form class=quick-reply><p>{sentence()}</p></form>"])}{foot()}'

    def plain() -> str:
        return r.choice([lambda: f"<div data-main>{words(r.randint(1, 4))}</div>", lambda: f"<div data-main>{sentence()}</div>", lambda: f"<h1 data-main>{words(3)}</h1><div data-main>{para()}</div>", lambda: f"<p data-main>{para()}</p>" * r.randint(1, 4), lambda: f"<pre data-main>{para()}</pre>"])()

    pages, kinds = [], list(kinds)
    own = {"blog": blog, "hashed": nameless, "contents": contents, "forum": forum}
    for _ in range(n):
        kind = r.choices(kinds, [KINDS[k] for k in kinds])[0]
        top = [menu()] + [x() for x in r.sample([menu, advert, notice, side], r.randint(0, 3))]
        tail = [x() for x in r.sample([side, comments, advert, notice], r.randint(0, 3))] + ([foot()] if r.random() < 0.9 else [])
        whole = ""
        if kind in own:
            page = own[kind]()
        elif kind == "plain":
            page, whole = r.choice([(plain(), ""), (plain(), ""), (words(r.randint(1, 5)), " data-main"), (para(), " data-main"), (f"{sentence()}<br>{para()}", " data-main")])
        elif kind == "bare":  # nothing else
            page = r.choice([article(), f"<article><p data-main>{para()}", f"<article><p data-main>{words(r.randint(3, 12))}", f"<main><p data-main>{sentence()}</p></main>"])
        elif kind == "table":  # laid out by a table
            cells = [f"<td {cls('left', 'nav')}>{menu()}</td>", f"<td>{body(' data-main')}</td>", *([f"<td>{side()}</td>"] if r.random() < 0.4 else [])]
            page = f"<table><tr><td colspan=3>{words(2)}</td></tr><tr>{''.join(cells)}</tr></table>{foot()}"
        else:
            page = f"{''.join(top)}{article()}{''.join(tail)}"
        pages.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body{whole}>{page}</body></html>")
    return pages


_field: list[Field] = []


def fitted() -> Field:
    """The field trained on the labelled pages; trained once in a process."""
    if not _field:
        _field.append(train(labelled_pages()))
    return _field[0]


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    field = field or fitted()
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.pairs, field.start))

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            text = [field.extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
