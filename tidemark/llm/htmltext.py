"""HTML extraction: a linear-chain conditional random field over a page's DOM leaf
blocks, decoded by Viterbi.

A leaf block is the run of text between two block-level tags. Its features are
its ancestors' tags, class, id and role words, and properties of its text (length,
share of link text, punctuation, place in the page, a few telling words). The two
labels are main text and boilerplate; label pairs of neighbours have weights too.

The field is trained on labelled pages by gradient ascent on the exact
log-likelihood (forward-backward in numpy, seconds on the driver). The labelled
pages come from ``labelled_page``, a generator of varied page layouts; a caller may
pass labelled pages of their own.

Text rules: contents of scripts, styles, comments and other raw elements are no
text, but those of formulas (math) are; a self-closing or unclosed media or embedded
element is empty; character references are decoded; white space inside a block becomes one
space; <br> counts as white space; blocks are joined by a blank line.

Reader comments are told by names of their elements, or by a short heading that
announces them: what follows it within the heading's parent has a feature of its own.

Edge cases: null or empty html, and pages without main text, give an empty text;
broken markup never raises, and a page with a quote that is never closed is read with
tags that end before the next one starts; very long and deeply nested pages take time in
proportion to their length; blocks whose scores tie are boilerplate; repeated rows each
give a row; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import named, table

_OPEN = re.compile(r"<!--|<[!?]|</?[a-zA-Z]")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
#: Of a page in which a quote is never closed: no tag reaches over the next one's start.
_SHORT_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?>[^>"'<]+|"[^"<]*"|'[^'<]*'|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom mfenced menclose merror mmultiscripts mprescripts semantics annotation annotation-xml maction".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video head title".split())
#: Media and embedded elements, which are empty if they close themselves or nothing closes them.
EMBEDS = frozenset("svg iframe object canvas audio video".split())
#: Raw elements that take the rest of the page if nothing closes them.
ENDLESS = frozenset("script style title".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html div article section main aside nav header footer".split())
_LEXICON = ("cookie", "consent", "subscribe", "newsletter", "copyright", "©", "rights", "reserved", "advert", "advertisement", "sponsored", "share", "comment", "comments", "reply", "login", "sign", "search", "menu", "related", "privacy", "terms")
#: A short heading that can stand above readers' comments (in four languages), and such as can also head a part of an article.
_COMMENTS = re.compile(r"(\d+ |(leave|post|write|add) an? |reader |all )*(comments?|replies|responses|reply|discussion|comentarios|kommentare|commentaires)( \(?\d+\)?)?:?", re.I)
_PARTS = re.compile("(replies|responses|reply|discussion):?", re.I)
#: Elements around what isn't an article, whatever stands in them.
_APART = ("tag:nav", "tag:header", "tag:footer", "tag:aside", "tag:form")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAX_NAMES = 20_000


class Paths:
    """Features of elements, found once for each tag and its attributes; with weights, blocks get sums instead."""

    def __init__(self, weights: Model | None = None):
        self.weights = weights
        self.known: dict[tuple[str, str], tuple[str, ...]] = {}

    def of(self, tag: str, attributes: str) -> tuple[str, ...]:
        key = (tag, attributes if "=" in attributes else "")
        found = self.known.get(key)
        if found is None:
            own = {f"tag:{tag}"}
            for name, value in _ATTRIBUTE.findall(attributes) if key[1] else ():
                for word in _WORD.findall(html.unescape(value)):
                    own |= {f"name:{word.lower()}", f"begins:{word.lower()[:5]}"} if name.lower() != "role" else {f"role:{word.lower()}"}
            if len(self.known) >= MAX_NAMES:
                self.known.clear()
            found = self.known[key] = tuple(sorted(own))
        return found


class _Stack:
    """Open elements, and how often each feature occurs among them."""

    def __init__(self, paths: Paths):
        self.paths, self.get = paths, paths.weights.weights.get if paths.weights else None
        self.tags: list[str] = []
        self.own: list[tuple[str, ...]] = []
        self.sums: list[float] = [0.0]
        self.counts: dict[str, int] = {}
        #: For each element, how many blocks stood before it.
        self.since: list[int] = []
        #: Depths of open elements that a start tag can close, by tag, and of those that keep it from doing so.
        self.depths: dict[str, list[int]] = {t: [] for closes in _CLOSES.values() for t in closes}
        self.scopes: list[int] = []

    def push(self, tag: str, attributes: str, before: int = 0) -> None:
        own, total = self.paths.of(tag, attributes), self.sums[-1]
        for f in own:
            n = self.counts.get(f, 0)
            self.counts[f] = n + 1
            if not n and self.get:
                total += self.get(f, 0.0)
        if tag in self.depths:
            self.depths[tag].append(len(self.tags))
        elif tag in _SCOPE:
            self.scopes.append(len(self.tags))
        self.since.append(before)
        self.tags.append(tag)
        self.own.append(own)
        self.sums.append(total)

    def cut(self, depth: int) -> None:
        """Closes the elements from this depth on."""
        for tag, own in zip(reversed(self.tags[depth:]), reversed(self.own[depth:])):
            for f in own:
                self.counts[f] -= 1
            if tag in self.depths:
                self.depths[tag].pop()
            elif tag in _SCOPE:
                self.scopes.pop()
        del self.tags[depth:], self.own[depth:], self.sums[depth + 1 :], self.since[depth:]

    def closed_by(self, tag: str) -> int:
        """The depth of the nearest element that this start tag closes, -1 if there is none."""
        found = max((self.depths[t][-1] for t in _CLOSES.get(tag, ()) if self.depths[t]), default=-1)
        return found if not self.scopes or found > self.scopes[-1] else -1

    def context(self, *more: str):
        """What a block here has of its ancestors: the sum of their features' weights, or the features."""
        if self.get:
            return self.sums[-1] + sum(self.get(f, 0.0) for f in more)
        return frozenset([f for f, n in self.counts.items() if n] + list(more))


def _closings(page: str, tag: str) -> dict[int, int]:
    """The end of each element of that name by its start; none for those that nothing closes."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.compile(rf"""<(/?){tag}(?![^\s/>])((?>[^>"'<]+|"[^"<]*"|'[^'<]*')*+)>""", re.I).finditer(page):
        if not m[1]:
            if not m[2].endswith("/"):
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


Block = tuple[str, object, str, int, int, bool]


def blocks(page: str, paths: Paths) -> list[Block]:
    """The page's leaf blocks: text, context of ancestors, own tag, letters of link text,
    controls inside, and whether it stands in navigation, a form, comments or the like.
    Every character is looked at a bounded number of times."""
    out: list[Block] = []
    stack = _Stack(paths)
    tags = stack.tags
    text: list[str] = []
    linked = controls = links = 0
    under = -1  # depth of the element in which a heading announced comments
    title: tuple[int, int] | None = None  # depth of the element that holds the first heading, and the blocks before it
    bodies: list[int] | None = None
    closings: dict[str, dict[int, int]] = {}
    lasts: dict[str, int] = {}
    tag_at, end_of_tags = _TAG, page.rfind(">")
    at, n = 0, len(page)

    def announces(whole: str) -> bool:
        """Whether a heading stands above readers' comments: never the page's first one. It
        opens its element, or tells their number; a word that can also head a part of an
        article counts only outside of the element that holds the title."""
        if title is None or len(whole) >= 40 or not _COMMENTS.fullmatch(whole):
            return False
        if any(c.isdigit() for c in whole):
            return True
        opens = len(tags) > 1 and stack.since[len(tags) - 2] == len(out)
        depth, before = title
        inside = depth >= 0 and len(tags) > depth and stack.since[depth] == before and tags[depth] not in ("html", "body")
        return opens and not (inside and _PARTS.fullmatch(whole))

    def flush() -> None:
        nonlocal linked, controls, under, title
        if under > len(tags):
            under = -1
        if text:
            if whole := " ".join("".join(text).split()):
                tag = tags[-1] if tags else ""
                if tag in HEADINGS:
                    if under < 0 and announces(whole):
                        under = len(tags) - 1
                    title = title or (len(tags) - 2, stack.since[len(tags) - 2] if len(tags) > 1 else 0)
                apart = under >= 0 or any(stack.counts.get(t) for t in _APART)
                out.append((whole, stack.context("under:comments") if under >= 0 else stack.context(), tag, linked, controls, apart))
            text.clear()
        linked = controls = 0

    def add(part: str) -> None:
        nonlocal linked
        if "&" in part:
            part = html.unescape(part)
        text.append(part)
        if links:
            linked += len(part)

    def end_of(tag: str) -> re.Match | None:
        """The next closing tag of a raw element, looked for only if there is one."""
        if tag not in lasts:
            lasts[tag] = max((m.start() for m in re.compile(f"</{tag}\\b", re.I).finditer(page)), default=-1)
        return re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at) if at <= lasts[tag] <= end_of_tags else None

    while at < n:
        m = _OPEN.search(page, at) if at <= end_of_tags else None
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            to = page.find("-->", at)
            at = n if to < 0 else to + 3
            continue
        if m[0] in ("<!", "<?"):
            to = page.find(">", at)
            if to < 0:
                add(m[0])
            at = at if to < 0 else to + 1
            continue
        found = tag_at.match(page, m.start())
        if found is None:
            tag_at = _SHORT_TAG
            found = tag_at.match(page, m.start())
        if found is None:
            add("<")
            at = m.start() + 1
            continue
        m, at = found, found.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
                if stack.counts.get(f"tag:{tag}"):
                    k = len(tags) - 1
                    while tags[k] != tag:
                        k -= 1
                    stack.cut(k)
            continue
        if tag in RAW:
            if tag in EMBEDS:
                if tag not in closings:
                    closings[tag] = _closings(page, tag)
                at = closings[tag].get(m.start(), at)
                continue
            end = end_of(tag)
            if tag == "head":
                if bodies is None:
                    bodies = [b.start() for b in re.finditer(r"<body\b", page, re.I)]
                k = bisect_left(bodies, at)
                if k < len(bodies) and bodies[k] < (end.start() if end else n):
                    at = bodies[k]
                    continue
            if end:
                at = end.end()
            elif tag in ENDLESS:
                at = n
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links += 1
            continue
        if tag in ("input", "button", "select", "textarea"):
            controls += 1
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        links = 0
        if tags and tags[-1] == "p":
            stack.cut(len(tags) - 1)
        if (k := stack.closed_by(tag)) >= 0:
            stack.cut(k)
        stack.push(tag, m[3], len(out))
    flush()
    return out


def _size(n: int) -> int:
    return sum(n > k for k in (2, 5, 10, 20, 50))


def text_features(block: Block, k: int, total: int) -> list[str]:
    text, _, tag, linked, controls, _ = block
    words = text.split(" ")
    share = linked / max(1, len(text))
    found = [f"own:{tag}", f"size:{_size(len(words))}", f"linked:{(share > 0) + (share > 0.3) + (share > 0.7)}", f"end:{text[-1] in '.!?…\"”)'}", f"place:{4 * k // max(total, 1)}", f"sizelink:{_size(len(words))}:{share > 0.5}"]
    if controls:
        found.append("controls")
    if k == 0:
        found.append("first")
    if k == total - 1:
        found.append("last")
    if len(words) < 25:
        lower = {w.strip(".,:;!?()").lower() for w in words}
        found += [f"word:{w}" for w in _LEXICON if w in lower]
    return found


@dataclass(frozen=True)
class Model:
    """weights: by feature, of main text against boilerplate; pairs: by label before and after; ends: of the first label."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]
    first: float

    def of(self, features) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the likeliest labels; ties go to boilerplate."""
        if not scores:
            return []
        (aa, ab), (ba, bb) = self.pairs
        zero, one, back = 0.0, self.first + scores[0], []
        for s in scores[1:]:
            z, o = (zero + aa, one + ba), (zero + ab, one + bb)
            back.append((z[1] > z[0], o[1] > o[0]))
            zero, one = max(z), max(o) + s
        labels = [int(one > zero)]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def extract(page: str, model: Model, paths: Paths) -> str:
    found = blocks(page, paths)
    scores = [b[1] + model.of(text_features(b, k, len(found))) for k, b in enumerate(found)]
    labels = model.decode(scores)
    if not any(labels):
        labels = _plain_labels(found)
    return "\n\n".join(b[0] for b, label in zip(found, labels) if label)


def _plain_labels(found: list[Block]) -> list[bool]:
    """Of a page in which the field finds no article, as in layouts without any structure:
    its prose, which is blocks with few links that end like sentences, and its headings
    from the first one before prose on. Nothing from navigation, forms or comments."""
    prose = [not apart and not controls and len(text.split(" ")) > 3 and text[-1] in ".!?…\"”)" and linked <= 0.3 * len(text) for text, _, _, linked, controls, apart in found]
    if not any(prose):
        return prose
    last = len(prose) - prose[::-1].index(True)
    return [p or (k < last and b[2] in HEADINGS and not b[5]) for k, (p, b) in enumerate(zip(prose, found))]


def train(pages: list[tuple[str, list[int]]], *, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """pages: html, and the label of each of its leaf blocks (1: main text)."""
    paths, rows, number = Paths(), [], {}
    for page, labels in pages:
        found = blocks(page, paths)
        assert len(found) == len(labels), "one label for each leaf block"
        rows.append(([[number.setdefault(f, len(number)) for f in {*b[1], *text_features(b, k, len(found))}] for k, b in enumerate(found)], labels))
    longest = max(len(x[1]) for x in rows)
    flat = np.concatenate([np.array(f) for x in rows for f in x[0]])
    owner = np.concatenate([np.full(len(f), p * longest + k) for p, x in enumerate(rows) for k, f in enumerate(x[0])])
    gold = np.zeros((len(rows), longest), int)
    there = np.zeros((len(rows), longest), bool)
    for p, x in enumerate(rows):
        gold[p, : len(x[1])], there[p, : len(x[1])] = x[1], True
    w, pairs, first = np.zeros(len(number)), np.zeros((2, 2)), 0.0
    m1, m2 = np.zeros(len(w) + 5), np.zeros(len(w) + 5)
    both = there[:, 1:]
    for t in range(1, rounds + 1):
        unary = np.zeros((len(rows), longest, 2))
        unary[:, :, 1] = np.bincount(owner, w[flat], minlength=gold.size).reshape(gold.shape)
        unary[:, 0, 1] += first
        fore, back = np.zeros_like(unary), np.zeros_like(unary)
        fore[:, 0] = unary[:, 0]
        for k in range(1, longest):
            step = np.logaddexp.reduce(fore[:, k - 1, :, None] + pairs[None], axis=1) + unary[:, k]
            fore[:, k] = np.where(there[:, k, None], step, fore[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(pairs[None] + (unary[:, k + 1] + back[:, k + 1])[:, None, :], axis=2)
            back[:, k] = np.where(there[:, k + 1, None], step, 0)
        z = np.logaddexp.reduce(fore[:, -1], axis=1)
        p1 = np.exp(fore[:, :, 1] + back[:, :, 1] - z[:, None])
        miss = np.where(there, gold - p1, 0)
        joint = np.exp(fore[:, :-1, :, None] + pairs[None, None] + (unary[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None])
        got = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        step = np.concatenate([np.bincount(flat, miss.ravel()[owner], minlength=len(w)), (got - np.where(both[:, :, None, None], joint, 0).sum((0, 1))).ravel(), [miss[:, 0].sum()]]) / len(rows)
        step -= decay * np.concatenate([w, pairs.ravel(), [first]])
        m1, m2 = 0.9 * m1 + 0.1 * step, 0.99 * m2 + 0.01 * step**2
        move = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, pairs, first = w + move[: len(w)], pairs + move[len(w) : -1].reshape(2, 2), first + move[-1]
    return Model({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-6}, tuple(map(tuple, pairs.tolist())), float(first))


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page in one of many layouts, and its leaf blocks' labels."""
    r = random.Random(seed)
    syllables = "an be ci do en fa gi ho in ka lo mi no or pa qu re sa ti un ve wa ex yo ch st th el".split()
    parts: list[str] = []
    labels: list[int] = []

    def words(low: int, high: int, stop: bool = True) -> str:
        out = " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return out.capitalize() + ("." if stop else "")

    def prose() -> str:
        return " ".join(words(4, 18) for _ in range(r.randint(1, 5)))

    def name(*options: str) -> str:
        word = r.choice(options)
        return r.choice([f' class="{word}"', f' id="{word}"', f' class="{r.choice(("site", "page", "top", "box", "main"))}-{word}"', f" class='{word} c{r.randint(1, 9)}'"])

    def leaf(tag: str, text: str, label: int, attributes: str = "") -> None:
        parts.append(f"<{tag}{attributes}>{text}" + ("" if tag in ("li", "p") and r.random() < 0.2 else f"</{tag}>"))
        labels.append(label)

    def around(tag: str, attributes: str, inside) -> None:
        parts.append(f"<{tag}{attributes}>")
        inside()
        parts.append(f"</{tag}>")

    def menu() -> None:
        def items() -> None:
            for _ in range(r.randint(2, 7)):
                leaf("li", f'<a href="/x">{words(1, 3, False)}</a>', 0)

        kind = r.choice(["nav", "div", "header"])
        around(kind, "" if kind == "nav" and r.random() < 0.5 else name("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs"), lambda: around("ul", "", items))

    def header() -> None:
        around("header", r.choice(["", name("header", "masthead", "banner")]), lambda: [leaf(r.choice(["h1", "div", "p"]), words(1, 6, False), 0), r.random() < 0.4 and leaf("p", words(3, 12), 0)])

    def boxed(tag: str, attributes: str) -> None:
        def inside() -> None:
            if r.random() < 0.5:
                leaf(r.choice(["h2", "h3", "h4"]), words(1, 4, False), 0)
            for _ in range(r.randint(1, 3)):
                leaf(r.choice(["p", "div", "li"]), prose() if r.random() < 0.6 else f'<a href="#">{words(2, 6, False)}</a>', 0)

        if r.random() < 0.35:
            leaf(tag, words(3, 25), 0, attributes)
        else:
            around(tag, attributes, inside)

    def advert() -> None:
        boxed(r.choice(["div", "aside", "section"]), name("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adslot", "banner"))

    def notice() -> None:
        boxed("div", r.choice([name("cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall"), ' role="dialog"', ' role="alert"']))

    def sidebar() -> None:
        boxed(*r.choice([("aside", ""), ("aside", name("sidebar", "related")), ("div", name("sidebar", "widget", "related", "recommended", "trending", "popular", "share", "social", "tags", "author", "pagination"))]))

    def form() -> None:
        def inside() -> None:
            for _ in range(r.randint(1, 3)):
                leaf("label", words(1, 3, False), 0)
                parts.append('<input name="x">')
            leaf("button", words(1, 2, False), 0)

        around("form", r.choice(["", name("search", "login", "signup", "contact")]), inside)

    def comments() -> None:
        plain = r.random() < 0.4  # told by their heading only
        said = r.choice(["Comments", "{} comments", "Comments ({})", "Discussion", "Responses", "Leave a reply", "Reader comments", "Comentarios", "Kommentare", "Commentaires"]).format(r.randint(1, 99))

        def inside() -> None:
            leaf(r.choice(["h2", "h3", "h4"]), said if plain or r.random() < 0.5 else words(1, 3, False), 0)
            for _ in range(r.randint(1, 5)):
                kind = r.choice(["li", "div", "article"])
                around(kind, "" if plain else name("comment", "reply", "comment-body"), lambda: [plain and r.random() < 0.5 and leaf("div", words(1, 2, False), 0), leaf("p", prose(), 0), r.random() < 0.5 and leaf("div", r.choice(["Reply", words(1, 2, False)]), 0)])

        around(r.choice(["section", "div", "ol", "ul"]), "" if plain else name("comments", "discussion", "responses", "replies", "disqus", "reviews", "commentlist"), inside)

    def footer() -> None:
        def inside() -> None:
            for _ in range(r.randint(1, 3)):
                leaf(r.choice(["p", "div", "span p".split()[1]]), r.choice([f"&copy; {words(1, 3, False)} &middot; {words(3, 12)}", words(2, 14), f'<a href="#">{words(1, 3, False)}</a>']), 0)

        if r.random() < 0.4:
            leaf("footer", f"&copy; {words(1, 3, False)} &middot; {words(3, 14)}", 0)
        else:
            around(*r.choice([("footer", ""), ("footer", name("footer")), ("div", name("footer", "colophon", "bottom", "legal", "copyright"))]), inside)

    def article() -> None:
        if r.random() < 0.85:
            if r.random() < 0.25:
                around("header", "", lambda: leaf("h1", words(2, 12, r.random() < 0.3), 1))
            else:
                leaf("h1", words(1, 14, r.random() < 0.4), 1)
        for k in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.66:
                leaf("p", (r.choice(["", "", "<b>", "<em>"]) + prose() + r.choice(["", "", "<br>"])) if r.random() < 0.85 else words(1, 6), 1)
            elif x < 0.74:
                leaf(r.choice(["h2", "h3"]), words(1, 8, r.random() < 0.2), 1)
            elif x < 0.80:
                around(r.choice(["ul", "ol"]), "", lambda: [leaf("li", words(1, 14, r.random() < 0.5), 1) for _ in range(r.randint(2, 5))])
            elif x < 0.84:
                around("blockquote", "", lambda: leaf("p", prose(), 1))
            elif x < 0.87:
                around("table", "", lambda: around("tr", "", lambda: [leaf("td", words(1, 4, False), 1) for _ in range(r.randint(2, 4))]))
            elif x < 0.89:
                leaf("figcaption", words(2, 10), 1)
            elif x < 0.91:
                leaf("pre", words(3, 12), 1)
            elif x < 0.94 and k:
                advert()
            elif x < 0.96 and k:
                sidebar()
            elif x < 0.98:
                leaf("p", f'{words(2, 8, False)} <a href="#">{words(1, 4, False)}</a> {words(2, 8)}', 1)
            else:
                leaf("div", prose(), 1)
        if r.random() < 0.12:
            comments()
        if r.random() < 0.12:
            around("footer", r.choice(["", name("meta", "tags")]), lambda: leaf("p", words(2, 8, False), 0))

    for part, chance in ((notice, 0.25), (header, 0.4), (menu, 0.85), (advert, 0.5), (form, 0.2)):
        if r.random() < chance:
            part()
    tag, attributes = r.choice([("article", ""), ("article", name("post", "article", "entry")), ("main", ""), ("div", name("content", "article", "post", "entry", "story", "body", "text", "main")), ("section", name("content", "article", "post"))])
    wrap = r.choice([None, None, ("main", ""), ("div", name("wrapper", "container", "content"))])
    if wrap:
        around(*wrap, lambda: [r.random() < 0.2 and menu(), around(tag, attributes, article), r.random() < 0.2 and sidebar()])
    else:
        around(tag, attributes, article)
    for part, chance in ((comments, 0.4), (sidebar, 0.45), (advert, 0.25), (form, 0.2), (menu, 0.15), (notice, 0.15), (footer, 0.9)):
        if r.random() < chance:
            part()
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{''.join(parts)}<script>x='</p>'</script></body></html>", labels


_trained: dict[int, Model] = {}


def default_model(pages: int = 800) -> Model:
    """Trained on so many generated pages, once in a process."""
    if pages not in _trained:
        _trained[pages] = train([labelled_page(k) for k in range(pages)])
    return _trained[pages]


def extract_text(pages: DataFrame, model: Model | None = None, *, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), to: str = "text") -> DataFrame:
    """The kept columns of every row and the main text of its page."""
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.select(*[c.alias(f"k{i}") for i, c in enumerate(named(keep))], F.coalesce(F.col(page), F.lit("")).alias("text"))
    names = [f"k{i}" for i in range(len(keep))] + ["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(held.value)
        for batch in batches:
            for part, _, _ in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([extract(x, held.value, paths) for x in part.column("text").to_pylist()], pa.string())], names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["value string"])
    return rows.mapInArrow(run, schema).toDF(*keep, to)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
