"""Main text of web pages by a tree-structured graphical model over the DOM.

Elements and blocks of text are the nodes; each is content or not. A node has a log-linear potential of its tag, the kinds that the tokens of its class,
id and role tell, its text's length, links and punctuation; a parent and a child have a potential of their two states by the child's kind. A
token tells a kind as a whole: states (has-comments) and taxonomies (category-ads) tell nothing, nor do the names of body, which speak of the page. A kind
that only qualifies another noun (sidebar-right, header-sticky) is weaker than one that is the noun (site-header). Where an element that is told off also has a good
name, holds a main heading, is most of an article or has most of the page's sentences, the kind is only doubted, which has weights of its own: see `_doubt`.
Sum-product messages pass upward and then downward, which is exact on a tree, and give each block's marginal of being content. The
weights are fitted by gradient ascent on the exact likelihood of labelled pages; `labelled_pages` makes such pages from a seed, with articles,
menus, headers, footers, sidebars, notices, adverts, forms and reader comments in varied layouts, with misleading names on articles and neutral ones
on the rest.

A null html is empty and gives an empty text, as do pages without content. Broken markup is read as browsers do: unclosed
comments and raw text run to the end, a tag that never ends is dropped, elements that are not known are inline. Reading takes time in proportion to the
page, however long or deep. Elements that a style or attribute hides, and noscript, are judged like all others. Ties (a marginal of exactly one half) are content. Repeated rows give repeated rows; extra columns, whatever their names, are ignored. No pages give no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style template title textarea xmp iframe noembed noframes select option optgroup datalist button input annotation annotation-xml desc metadata".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav noscript ol option optgroup p plaintext pre search section select summary table tbody td template textarea tfoot th thead tr ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("table ul ol dl body article section div main aside nav".split())

TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
STOPS = re.compile(r"[.!?](?: |$)")

#: Words of class, id and role, by what they tell.
LEXICON = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs skip toc",
    "head": "header masthead banner logo topbar branding hero",
    "foot": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar aside rail widget complementary related recommended trending popular tags",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay warning disclaimer privacy paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense outbrain taboola",
    "form": "form search login signup subscribe subscription newsletter register contact",
    "comment": "comment comments reply replies discussion disqus respond feedback reviews",
    "share": "share sharing social byline author meta follow",
    "good": "article content main post entry story body text prose page blog news document",
}
KIND = {w: k for k, ws in LEXICON.items() for w in ws.split()}
KIND["contentinfo"], KIND["dialog"] = "foot", "notice"
#: Tokens that begin so name a state or a taxonomy of the whole page, not what an element is.
STATES = re.compile(r"(?:has|have|no|not|non|with|without|is|in|can|hide|hidden|show|enable|disable|category|cat|tag|term|postid|page-id|type|status|format|theme|layout|template|lang|t)[-_]")
#: Elements that are not content by their tag, names apart.
TOLD = frozenset("aside footer form nav".split())
CONTAINERS = frozenset("article aside body center div footer form header main nav section table".split())
GROUPS = {t: g for g, ts in {"heading": "h1 h2 h3 h4 h5 h6", "item": "li dd dt", "list": "ul ol dl menu", "cell": "td th", "grid": "table tr tbody thead tfoot", "quote": "blockquote pre figure figcaption"}.items() for t in ts.split()}


@dataclass
class Node:
    parent: int
    tag: str
    kinds: tuple[str, ...] = ()
    weak: bool = False
    doubted: bool = False
    text: str = ""
    linked: int = 0
    size: int = 0
    links: int = 0
    prose: int = 0
    headed: bool = False
    holds: bool = False
    inside: bool = False
    off: bool = False
    features: list[str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def kinds_of(told: str) -> tuple[tuple[str, ...], bool]:
    """Kinds of the tokens of class, id and role, and whether those that tell an element off are all weak. Of a token's words one that is told off outweighs a
    good one; it is weak if it isn't the token's noun, its last word."""
    found: set[str] = set()
    strong = False
    for token in told.split():
        if not STATES.match(token):
            words = WORDS.findall(token)
            kinds = {KIND[w] for w in words if w in KIND}
            found |= kinds - {"good"} or kinds
            strong |= bool(kinds) and KIND.get(words[-1], "good") != "good"
    return tuple(sorted(found)), not strong


def parse(html: str) -> list[Node]:
    """Nodes, parents before children: elements (but inline ones that tell nothing) and #block leaves, in the order of the page."""
    nodes = [Node(-1, "#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the node that their text belongs to
    hidden = 0  # how many of the open elements drop their text
    links = 0
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                nodes.append(Node(stack[-1][1], "#block", text=text, linked=min(linked, len(text))))
            pieces.clear()
        linked = 0

    opened: Counter = Counter()  # open elements by name, so that nothing is looked for that is not there

    def close(at: int) -> None:
        """Closes the open elements from place `at` on."""
        nonlocal hidden, links
        if any(stack[i][0] in BLOCK or stack[i][1] != stack[i - 1][1] for i in range(at, len(stack))):
            flush()
        for name, _ in stack[at:]:
            hidden -= name in DROPPED
            links -= name == "a"
            opened[name] -= 1
        del stack[at:]

    pos, n = 0, len(html)
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            at = n
        if at > pos and not hidden:
            piece = html[pos:at]
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            linked += len(piece.strip()) if links else 0
        if at >= n:
            break
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) if html[at + 4 : at + 5] != ">" else at + 2
            pos = n if end < 0 else end + 3
            continue
        if after in ("!", "?"):
            end = html.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        if after == "/":
            end = html.find(">", at)
            if end < 0:
                break
            m = re.match(r"[a-zA-Z][^\s/>]*", html[at + 2 : end])
            if m:
                name = m[0].lower()
                if name == "br" and not hidden:
                    pieces.append(" ")
                for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name not in BLOCK and stack[k][0] in BLOCK or name == "p" and stack[k][0] in SCOPES or name in ("li", "td", "th", "tr") and stack[k][0] == ("ul", "table")[name != "li"]:
                        break
            pos = end + 1
            continue
        if not after.isascii() or not after.isalpha():
            if not hidden:
                pieces.append("<")
            pos = at + 1
            continue
        m = TAG.match(html, at)
        if m:
            name, rest, pos = m[1].lower(), m[2], m.end()
        else:
            end = html.find(">", at)
            if end < 0:
                break
            inner = html[at + 1 : end]
            name = re.match(r"[^\s/>]*", inner)[0].lower()
            rest, pos = inner[len(name) :], end + 1
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, pos)
            if stop is None:
                pos = n
            else:
                end = html.find(">", stop.end())
                pos = n if end < 0 else end + 1
            if name in BLOCK and not hidden:
                flush()
            continue
        if name in VOID:
            if name == "br" and not hidden:
                pieces.append(" ")
            elif name == "hr":
                flush()
            continue
        found = _attributes(rest)
        if name in ("html", "body"):
            for k in range(len(stack) - 1, 0, -1) if opened["head"] else ():
                if stack[k][0] == "head":
                    close(k)
            if opened[name]:
                continue
        if name in ENDS_P or name in SIBLINGS:
            ends = ("p",) if name in ENDS_P else SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[k][0] in ends:
                    close(k)
                    if name not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif stack[k][0] in SCOPES:
                    break
        told = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        kinds, weak = kinds_of(told) if name not in ("html", "body") else ((), False)
        owner = stack[-1][1]
        if name in BLOCK or any(k != "good" for k in kinds):
            flush()
            nodes.append(Node(owner, name, kinds, weak))
            owner = len(nodes) - 1
        if rest.rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        stack.append((name, owner))
        opened[name] += 1
        hidden += name in DROPPED
        links += name == "a"
    flush()
    for k in range(len(nodes) - 1, 0, -1):
        x, up = nodes[k], nodes[nodes[k].parent]
        if x.tag == "#block":
            x.size, x.links = len(x.text), x.linked
            x.prose = x.size - x.links if STOPS.search(x.text) else 0
        up.size += x.size
        up.links += x.links
        up.prose += x.prose
        up.headed |= x.headed or x.tag == "h1" and x.size > 0
        up.holds |= x.holds or x.tag in ("article", "main") or "good" in x.kinds
    _doubt(nodes)
    return nodes


def _doubt(nodes: list[Node]) -> None:
    """Tells elements off, with all below them, or doubts their names. free: the sentences that no name tells off. An element that has most of the page's
    sentences is doubted if it holds an article or little is free beside it (less than 0.3 of its own for weak names, 0.1 for others); one of reader comments
    only if its name is weak and next to nothing is free. If all of the page would be told off, weak names tell nothing."""
    whole, free = nodes[0].prose, nodes[0].prose
    told = [False] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        x.inside = nodes[x.parent].inside or nodes[x.parent].tag in ("article", "main")
        named = any(c != "good" for c in x.kinds) or x.tag in TOLD
        told[k] = told[x.parent] or named
        if named and not told[x.parent]:
            free -= x.prose
    for lenient in (False, True):
        for x in nodes[1:]:
            up = nodes[x.parent]
            named = any(c != "good" for c in x.kinds)
            x.off, x.doubted = up.off, False
            if named or x.tag in TOLD:
                most = whole > 0 and x.prose >= 0.5 * whole
                weak, remarks = x.weak and x.tag not in TOLD, "comment" in x.kinds
                main = most and (weak or not remarks) and (x.holds and not remarks or free < (0.3 if weak and not remarks else 0.1) * x.prose)
                spared = x.headed or main or lenient and weak and not remarks and x.prose > 0
                if named:
                    x.doubted = spared or "good" in x.kinds or x.inside and x.size >= 0.7 * up.size and "comment" not in x.kinds
                    spared = x.doubted
                x.off |= not spared
        if any(x.tag == "#block" and x.prose and not x.off for x in nodes) or not whole:
            break


def _bucket(x: float, limits: tuple[float, ...]) -> int:
    return sum(x >= y for y in limits)


def describe(nodes: list[Node]) -> None:
    """Fills each node's features."""
    whole = max(nodes[0].size, 1)
    for x in nodes:
        group = GROUPS.get(x.tag, x.tag)
        density = x.links / x.size if x.size else 0.0
        dense, share = _bucket(density, (0.2, 0.5, 0.8)), _bucket(x.size / whole, (0.2, 0.6))
        f = ["bias", f"tag {group}", f"links {dense} {'in' if x.inside else 'out'}"]
        if x.off:
            f.append("off")
        f += [f"doubted {c} {share}" if x.doubted and c != "good" else f"kind {c}" for c in x.kinds]
        if x.tag == "#block":
            up = nodes[x.parent]
            f += [f"in {GROUPS.get(up.tag, up.tag)}", f"length {_bucket(x.size, (25, 80, 200))}", f"stops {min(len(STOPS.findall(x.text)), 2)}"]
            if "©" in x.text:
                f.append("copyright")
        elif x.tag in CONTAINERS:
            f += [f"share {share}", f"headed {share}" if x.headed else "no heading"]
        x.features = f


def _edge(child: Node) -> str:
    """The child's kind, for its potential with its parent."""
    if child.tag == "#block":
        return "block"
    if any(k != "good" for k in child.kinds):
        return "doubted" if child.doubted else "told off"
    if child.tag in ("nav", "header", "footer", "aside", "form"):
        return child.tag
    return "good" if child.kinds or child.tag in ("article", "main") else "plain"


@dataclass
class TreeModel:
    """unary: weight of each feature for content; edges: 2 by 2 log potentials (parent's state, child's state) by the child's kind."""

    unary: dict[str, float] = field(default_factory=dict)
    edges: dict[str, list[float]] = field(default_factory=dict)

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
        """(of each node's being content, of each edge's four states, log of the partition sum)."""
        n, get = len(nodes), self.unary.get
        score = [sum(get(f, 0.0) for f in x.features) for x in nodes]
        pots = [tuple(exp(v) for v in self.edges.get(_edge(x), (0.0,) * 4)) for x in nodes]
        # Upward: beliefs (not content, content) of each subtree, scaled; z gathers the scales.
        low, high = [1.0] * n, [0.0] * n
        for k, s in enumerate(score):
            low[k], high[k] = (exp(-s), 1.0) if s > 0 else (1.0, exp(s))
        z = sum(max(s, 0.0) for s in score)
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b, (p00, p01, p10, p11) = low[k], high[k], pots[k]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            t = m0 + m1
            up[k] = (m0 / t, m1 / t)
            z += log(t)
            j = nodes[k].parent
            low[j] *= up[k][0]
            high[j] *= up[k][1]
            if low[j] + high[j] < 1e-100:
                z += log(1e-100)
                low[j] *= 1e100
                high[j] *= 1e100
        z += log(low[0] + high[0])
        # Downward: what a node's parent says without the node itself.
        out, pairs = [0.0] * n, [(0.0,) * 4] * n
        out[0] = high[0] / (low[0] + high[0])
        for k in range(1, n):
            j = nodes[k].parent
            q0, q1 = (1 - out[j]) / max(up[k][0], 1e-300), out[j] / max(up[k][1], 1e-300)
            p00, p01, p10, p11 = pots[k]
            w = (q0 * p00 * low[k], q0 * p01 * high[k], q1 * p10 * low[k], q1 * p11 * high[k])
            t = sum(w)
            pairs[k] = (w[0] / t, w[1] / t, w[2] / t, w[3] / t)
            out[k] = pairs[k][1] + pairs[k][3]
        return out, pairs, z


def fit(pages: list[tuple[str, set[str]]], rounds: int = 60, rate: float = 0.5, decay: float = 0.02) -> TreeModel:
    """pages: (html, the texts of its content blocks). An element is content if a block below it is. Adagrad on the exact log-likelihood."""
    data = []
    for html, good in pages:
        nodes = parse(html)
        describe(nodes)
        state = [int(x.tag == "#block" and x.text in good) for x in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            state[nodes[k].parent] |= state[k]
        data.append((nodes, state))
    model, g2 = TreeModel(), {}
    for _ in range(rounds):
        unary: dict[str, float] = {}
        edges: dict[str, list[float]] = {}
        for nodes, state in data:
            out, pairs, _ = model.marginals(nodes)
            for k, x in enumerate(nodes):
                gap = state[k] - out[k]
                for f in x.features:
                    unary[f] = unary.get(f, 0.0) + gap
                if k:
                    e = edges.setdefault(_edge(x), [0.0] * 4)
                    for i in range(4):
                        e[i] -= pairs[k][i]
                    e[2 * state[x.parent] + state[k]] += 1
        for f, g in unary.items():
            g -= decay * model.unary.get(f, 0.0)
            g2[f] = g2.get(f, 1e-6) + g * g
            model.unary[f] = model.unary.get(f, 0.0) + rate * g / g2[f] ** 0.5
        for name, gs in edges.items():
            own = model.edges.setdefault(name, [0.0] * 4)
            for i, g in enumerate(gs):
                g -= decay * own[i]
                g2[name, i] = g2.get((name, i), 1e-6) + g * g
                own[i] += rate * g / g2[name, i] ** 0.5
    return model


def extract(html: str, model: TreeModel, threshold: float = 0.5) -> str:
    nodes = parse(html)
    describe(nodes)
    out, _, _ = model.marginals(nodes)
    return "\n\n".join(x.text for x, p in zip(nodes, out) if x.tag == "#block" and p >= threshold)


#: Names that stand on articles all the same.
MISLEADING = "has-comments social author-bio contact category-ads with-sidebar share reviews banner promo form widget news-alert legal related popular search-result post-meta".split()
#: Words of the names that labelled pages put around whole layouts: every other one of each kind, so that tests can draw from the rest.
DRAWN = [w for k, ws in LEXICON.items() if k not in ("good", "comment") for w in ws.split()[::2]]


def labelled_pages(n: int = 240, seed: int = 5, noise_share: float = 0.0) -> list[tuple[str, set[str]]]:
    """Pages made from a seed, with the texts of their content blocks. noise_share: of elements whose names mislead or tell nothing, and of linked
    content and headings in unusual places."""
    r = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    style = r.choice
    sentence = lambda a=3, b=14: style((lambda x: x + ".", lambda x: x + ".", lambda x: x + "!", lambda x: x, lambda x: x.replace(" ", " | "), lambda x: x.upper().replace(" ", "!! "), lambda x: x.replace(" ", "*** ")))(words(a, b).capitalize())
    para = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8))))

    def named(*names: str) -> str:
        """One of the names, or, now and then, one that tells nothing."""
        return word() if r.random() < 0.4 * noise_share else r.choice(names)

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(r.randint(2, 8)))
        return r.choice((f"<nav><ul>{items}</ul></nav>", f'<ul class="{named("menu", "nav-links")}">{items}</ul>', f'<div id="{named("nav", "main-menu")}"><ul>{items}</ul></div>', f'<div class="breadcrumb"><a href="/">{word()}</a> &gt; <a href="/x">{words(1, 2)}</a></div>'))

    def head() -> str:
        if r.random() < 0.4 * noise_share:
            return f'<div class="site-header"><h1><a href="/">{words(1, 3)}</a></h1>{menu()}</div>'
        return r.choice((f'<header><a href="/">{words(1, 2)}</a><p>{sentence()}</p></header>', f'<div id="header"><div class="logo">{word()}</div>{sentence()}</div>', f"<header><h1>{words(1, 3)}</h1>{menu()}</header>", ""))

    def foot() -> str:
        return r.choice((f"<footer>&copy; {word()}.com &middot; {para()}</footer>", f'<div class="{named("footer", "site-footer")}"><p>{sentence()}</p><p>&copy; 2024 {word()}</p></div>', f"<footer><ul><li><a href='/a'>{word()}</a></li></ul><p>{para()}</p></footer>"))

    def side() -> str:
        return r.choice((f"<aside><h3>{words(1, 3)}</h3><p>{para()}</p></aside>", f'<div class="sidebar"><h2>{words(1, 3)}</h2><ul><li><a href="/q">{words(2, 6)}</a></li><li>{sentence()}</li></ul></div>', f'<div id="related"><p><a href="/r">{sentence()}</a></p></div>', f'<div class="related-posts"><ul><li><a href="/r">{words(2, 6)}</a></li><li><a href="/s">{words(2, 6)}</a></li></ul></div>'))

    def noise() -> str:
        return r.choice((f'<div class="ad">{para()}</div>', f'<div class="ad">{" ".join(para() for _ in range(r.randint(1, 6)))}</div>', f'<div class="advert"><p>{para()}</p></div>', f'<section class="sponsored-box">{sentence()}</section>', f'<div class="cookie-notice"><p>{para()}</p><button>{word()}</button></div>', f'<div role="alert">{sentence()}</div>', f'<div id="newsletter"><p>{sentence()}</p><form><input name="e"><button>{word()}</button></form></div>', f'<form action="/s"><label>{words(1, 3)}</label><input><p>{sentence()}</p></form>', f'<div class="share-buttons"><a href="/f">{word()}</a> <a href="/t">{word()}</a></div>', f'<div class="author-bio"><p>{para()}</p></div>'))

    def comments() -> str:
        each = "".join(f'<div class="comment"><b>{word()}</b><p>{para()}</p></div>' for _ in range(r.choice((1, 2, 4, 12))))
        return r.choice((f'<section id="comments"><h3>{words(1, 2)}</h3>{each}</section>', f'<div class="comments">{each}<form><textarea>{word()}</textarea></form></div>', f"<ol class='comment-list'><li>{sentence()}</li><li>{para()}</li></ol>"))

    def around(inner: str) -> str:
        """Elements around an article, or all of a page, with names that only seem to tell them off."""
        name = r.choice((f"{r.choice(DRAWN)}-{word()}", f"{word()}-{r.choice(DRAWN)}-{word()}", f"{word()} {r.choice(DRAWN)}-{word()}"))
        return f'<div class="{name}">{inner}</div>'

    def wrap(inner: str) -> str:
        """The article's element, with misleading names at times: beside a good name, or around most of an article."""
        extra = f" {r.choice(MISLEADING)}" if r.random() < noise_share else ""
        if r.random() < 0.3 * noise_share:
            inner = f'<div class="{r.choice(MISLEADING)}">{inner}</div>'
            return r.choice(("<article>{}</article>", "<main>{}</main>")).format(inner)
        good = r.choice("content post entry story article-body blog-post post-content main-content".split())
        return r.choice((
            "<article>{}</article>", "<article>{}</article>", f'<article class="{good}{extra}">{{}}</article>', "<main>{}</main>", f'<main id="main" class="{good}{extra}">{{}}</main>', f'<div class="{good}{extra}">{{}}</div>', f'<div class="{good}{extra}">{{}}</div>',
            f'<div id="main"><div class="{good}{extra}">{{}}</div></div>', "<main><article>{}</article></main>", f'<section class="{good}{extra}">{{}}</section>', "<div>{}</div>", "{}",
        )).format(inner)

    pages = []
    for _ in range(n):
        good: set[str] = set()

        def keep(text: str, good: set[str] = good) -> str:
            good.add(text)
            return text

        body = [f"<h1>{keep(words(2, 8))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 6, 10, 25, 60))):
            if r.random() < 0.3 * noise_share:
                body.append(r.choice((lambda: f'<ul><li><a href="/z">{keep(words(1, 6))}</a></li><li>{keep(sentence())}</li></ul>', lambda: f'<p><a href="/w">{keep(words(2, 8))}</a></p>'))())
                continue
            body.append(r.choice((
                lambda: f"<p>{keep(para())}</p>", lambda: f"<p>{keep(para())}</p>", lambda: f"<p>{keep(para())}", lambda: f"<p><b>{keep(para())}<br></b></p>", lambda: f"<p>{keep(sentence(1, 3))}</p>",
                lambda: f"<h2>{keep(words(1, 6))}</h2>", lambda: f"<ul><li>{keep(sentence())}</li><li>{keep(words(1, 6))}</li></ul>", lambda: f"<blockquote>{keep(para())}</blockquote>",
                lambda: f"<table><tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr></table>", lambda: f"<div>{keep(para())}</div>", lambda: f"<pre>{keep(sentence())}</pre>",
            ))())
        if r.random() < 0.25:
            body.insert(r.randint(1, len(body)), r.choice((noise, side))())
        inner = "".join(body) + (comments() if r.random() < 0.2 else "")
        layout = r.choice((0, 0, 1, 2)) if noise_share else 0
        parts = [head(), menu() if r.random() < 0.8 else "", noise() if r.random() < 0.6 else "", around(wrap(inner)) if layout == 1 else wrap(inner), comments() if r.random() < 0.25 else "", side() if r.random() < 0.4 else "", noise() if r.random() < 0.2 else "", foot() if r.random() < 0.9 else ""]
        whole = around("".join(parts)) if layout == 2 else "".join(parts)
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var a='<p>';</script></head><body>{whole}</body></html>", good))
    return pages


@lru_cache(maxsize=2)
def trained(n: int = 240, seed: int = 5) -> TreeModel:
    return fit(labelled_pages(n // 2, seed) + labelled_pages(n - n // 2, seed + 1, 0.4))


def main_text(pages: DataFrame, model: TreeModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or trained()

    def run(part: pa.RecordBatch) -> dict:
        texts = [extract((x or b"").decode("utf-8", "replace"), model, threshold) for x in part.column("html").cast(pa.binary()).to_pylist()]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long", "html")
