"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down on the tree.

Each element gets features (tag group, attribute tokens, depth, subtree text
and link density, siblings, position); boosted trees give its log-odds of being
main content.  Decoding picks the labels of a whole tree at once: keeping or
dropping a node counts its log-odds for or against, and under a dropped node
everything is dropped, so no kept node has a dropped ancestor.

Training: a bounded sample of pages, by the order of a hash of the page_id.
Their own markup labels them (inside or outside of article/main).  As live
pages use other markup, each sample page is also shown in variants: with
generic elements and attribute tokens instead of the semantic ones, and with
boilerplate blocks (sidebars, notices, comments, forms, ...), made of text from
other pages, put around and into the article.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiccases.llm.common import python_workers

#: bounds of the fit
TRAIN_PAGES = 240
VARIANTS = 3
TREES, DEPTH, SHRINKAGE, BINS = 40, 4, 0.25, 32
#: pages scored together
BLOCK = 200
MARKER = "datamainmarker"

# fixed values: HTML element groups
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe svg math object select textarea button "
                   "title link meta option canvas audio video datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
                   "ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
#: an opening tag ends an open element of these, up to the nearest of the scope
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
           "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
           "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
TAG_GROUPS = ["article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol menu dl", "li dt dd", "nav",
              "aside", "header", "footer", "form fieldset label input dialog", "table tr td th tbody thead",
              "blockquote pre figure figcaption", "body html", "a"]
GOOD_TOKENS = frozenset("article main content post entry story text articlebody body prose maincontent page".split())
BAD_TOKENS = {  # by kind; a feature each
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip topbar toolbar",
    "frame": "header footer masthead banner copyright legal colophon bottom top site logo branding",
    "side": "sidebar aside side rail widget related recommended trending popular more tags tag share social sharing",
    "advert": "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored adbox adsense dfp",
    "comment": "comment comments reply replies discussion respond disqus reader thread feedback",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login gdpr privacy",
}
_BAD = {w: k for k, (_, words) in enumerate(BAD_TOKENS.items()) for w in words.split()}
_GROUP = {t: k for k, g in enumerate(TAG_GROUPS) for t in g.split()}
N_GROUPS, N_BAD = len(TAG_GROUPS), len(BAD_TOKENS)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"""
                    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.S)
_ATTRS = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: the attribute hidden, with or without a value, or a style that does not display
_UNSEEN = re.compile(r"""(?:^|[\s"'])hidden(?=[\s=/]|$)|style\s*=\s*(?:"[^"]*|'[^']*|)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)


@dataclass
class Dom:
    """Elements in document order as parallel lists; texts hang at their innermost element."""
    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple] = field(default_factory=lambda: [()])
    hidden: list[bool] = field(default_factory=lambda: [False])
    texts: list[tuple[int, str]] = field(default_factory=list)  # (element, text); block breaks as (element, None)


def attribute_tokens(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    # camelCase and separators end a token
    words = []
    for _, value in _ATTRS.findall(attrs):
        words += _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(words)


def parse(page: str) -> Dom:
    """A tolerant DOM: unclosed and misplaced tags end as browsers end them, in the cases that move text."""
    dom = Dom()
    tag, parent, tokens, hidden, texts = dom.tag, dom.parent, dom.tokens, dom.hidden, dom.texts
    stack, at, end = [0], 0, len(page)
    search, lower = _TOKEN.search, None

    def text(a: int, b: int) -> None:
        if b > a and not hidden[stack[-1]]:
            s = page[a:b]
            texts.append((stack[-1], html_lib.unescape(s) if "&" in s else s))

    def close(depth: int) -> None:
        for node in stack[depth:]:
            if tag[node] in BLOCKS:
                texts.append((node, None))
        del stack[depth:]

    while at < end:
        m = search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        closing, opening, attrs, empty = m.groups()
        if closing:
            name = closing.lower()
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tag[stack[depth]]
                if open_tag == name:
                    close(depth)
                    break
                if open_tag in BLOCKS and name not in BLOCKS:  # an inline end tag reaches no further
                    break
            continue
        if not opening:
            continue
        name = opening.lower()
        if name == "br":
            texts.append((stack[-1], " "))
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tag[stack[depth]]
                if open_tag == "p":
                    close(depth)
                    break
                if open_tag in BLOCKS:
                    break
        elif name in IMPLIED:
            ends, scope = IMPLIED[name]
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tag[stack[depth]]
                if open_tag in scope:
                    break
                if open_tag in ends:
                    close(depth)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        node = len(tag)
        tag.append(name)
        parent.append(stack[-1])
        tokens.append(attribute_tokens(attrs))
        hidden.append(hidden[stack[-1]] or name in HIDDEN or _UNSEEN.search(attrs) is not None)
        if name in BLOCKS:
            texts.append((stack[-1], None))
        if name in RAW:
            lower = page.lower() if lower is None else lower
            stop = lower.find("</" + name, at) if len(lower) == end else -1
            if stop < 0:
                found = re.compile("</" + name, re.I).search(page, at)
                stop = found.start() if found else end
            at = stop
            past = page.find(">", at)
            at = end if past < 0 else past + 1
            continue
        if name not in VOID and not (empty and name in ("svg", "path", "use")):
            stack.append(node)
    close(1)
    return dom


# --- features ----------------------------------------------------------------------

def features(dom: Dom) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows, parents, text length at each node) of all elements."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    own, linked = np.zeros(n), np.zeros(n)
    in_link = [False] * n
    depth = np.zeros(n)
    group = np.zeros((n, N_GROUPS))
    bad = np.zeros((n, N_BAD))
    good = np.zeros(n)
    seen_children: dict[int, int] = {}
    index = np.zeros(n)
    for i in range(n):
        p = dom.parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            in_link[i] = in_link[p] or dom.tag[i] == "a"
            index[i] = seen_children.get(p, 0)
            seen_children[p] = index[i] + 1
        k = _GROUP.get(dom.tag[i])
        if k is not None:
            group[i, k] = 1
        for w in dom.tokens[i]:
            kind = _BAD.get(w)
            if kind is not None:
                bad[i, kind] = 1
            elif w in GOOD_TOKENS:
                good[i] = 1
    for node, text in dom.texts:
        if text:
            size = len(text.strip())
            own[node] += size
            if in_link[node]:
                linked[node] += size
    total, links, nodes, paragraphs = own.copy(), linked.copy(), np.ones(n), group[:, 3].copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        nodes[p] += nodes[i]
        paragraphs[p] += paragraphs[i]
    above_bad, above_good, above_article = bad.copy(), good.copy(), group[:, 0].copy()
    for i in range(1, n):
        p = parent[i]
        above_bad[i] = np.maximum(above_bad[i], above_bad[p])
        above_good[i] = max(above_good[i], above_good[p])
        above_article[i] = max(above_article[i], above_article[p])
    p = np.maximum(parent, 0)
    order = np.cumsum(own) / max(own.sum(), 1)
    rows = np.column_stack([
        group, bad, above_bad, good, above_good, above_article, group[p], depth, index,
        np.array([seen_children.get(int(q), 0) for q in p]), np.log1p(total), np.log1p(own),
        links / np.maximum(total, 1), links[p] / np.maximum(total[p], 1), total / np.maximum(nodes, 1),
        total / max(total[0], 1), total / np.maximum(total[p], 1), paragraphs, order, np.log1p(nodes)])
    return rows, parent, own


# --- boosted trees -------------------------------------------------------------------

@dataclass
class Trees:
    """Complete trees of one depth: feature, threshold of inner nodes, value of leaves."""
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2 ** DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic gradient boosting with Newton leaf values over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    mean = np.average(y, weights=weight)
    base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    score = np.full(len(y), base)
    inner = 2 ** DEPTH - 1
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)
    value = np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            go_left = np.ones(len(mine), bool)
            if len(mine) > 20:
                best, total_g, total_h = 1e-6, g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[mine, j]
                    cg = np.cumsum(np.bincount(b, g[mine], len(e) + 1))[:-1]
                    ch = np.cumsum(np.bincount(b, h[mine], len(e) + 1))[:-1]
                    gain = cg ** 2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g ** 2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[t, node], threshold[t, node] = gain[k], j, e[k]
                        go_left = b <= k
            at[mine] = 2 * node + 1 + ~go_left
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = SHRINKAGE * gs / (hs + 1)
        score += value[t][leaf]
    return Trees(base, feature, threshold, value)


# --- decoding --------------------------------------------------------------------------

def decode(log_odds: np.ndarray, parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best consistent labels: a node is kept only under kept nodes.

    Nodes weigh by their own text (1 without); ties keep.
    """
    gain = np.clip(log_odds, -8, 8) * (1 + np.log1p(own))
    gain[0] = 0.0
    kept = gain.copy()          # value of the subtree with its root kept
    dropped = -gain             # value with all of it dropped
    for i in range(len(gain) - 1, 0, -1):
        p = parent[i]
        kept[p] += max(kept[i], dropped[i])
        dropped[p] += dropped[i]
    keep = np.zeros(len(gain), bool)
    keep[0] = kept[0] >= dropped[0]
    for i in range(1, len(gain)):
        keep[i] = keep[parent[i]] and kept[i] >= dropped[i]
    return keep


def assemble(dom: Dom, keep: np.ndarray) -> str:
    """Kept texts as blocks: white space runs are one space, blocks are trimmed, empty ones vanish."""
    blocks, current = [], []
    for node, text in dom.texts:
        if text is None:
            if current:
                blocks.append("".join(current))
                current = []
        elif keep[node]:
            current.append(text)
    if current:
        blocks.append("".join(current))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


# --- training ----------------------------------------------------------------------------

def markup_labels(dom: Dom) -> list[int]:
    """1 inside article or main, 0 outside and inside their nav, aside, footer, form or marked blocks, -1 around them."""
    n = len(dom.tag)
    inside = [0] * n
    for i in range(1, n):
        up = inside[dom.parent[i]]
        if dom.tag[i] in ("article", "main") and up == 0 and not any(w in _BAD for w in dom.tokens[i]):
            inside[i] = 1
        elif up == 1:
            off = dom.tag[i] in ("nav", "aside", "footer", "form") or any(w in _BAD for w in dom.tokens[i])
            inside[i] = 2 if off else 1
        else:
            inside[i] = up
    labels = [1 if x == 1 else 0 for x in inside]
    for i in range(n - 1, 0, -1):  # ancestors of main content are neither
        if labels[i] and not inside[dom.parent[i]]:
            p = dom.parent[i]
            while p >= 0:
                labels[p] = -1
                p = dom.parent[p]
    return labels


def variant(page: str, texts: list[str], rng: random.Random) -> tuple[str, str]:
    """The page in other markup: (html, marker attribute of the main element).

    Blocks of foreign text with boilerplate tokens go before, into and after the
    article; semantic elements may turn into div with tokens.
    """
    def words(n: int) -> str:
        return html_lib.escape(" ".join(rng.choice(texts).split()[:n]) or "more", quote=False)

    def filler() -> str:
        kind = rng.choice(list(BAD_TOKENS))
        name = rng.choice(BAD_TOKENS[kind].split())
        shown = rng.choice([f'class="{name}"', f'id="{name}"', f'class="{name}-box x{rng.randint(1, 99)}"',
                            f'class="page-{name}"'])
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="#">{words(2)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
            return rng.choice([f"<nav>{inner}</nav>", f"<div {shown}>{inner}</div>"])
        if kind == "comment":
            one = "".join(f'<div class="{rng.choice(["comment", "reply"])}"><b>{words(1)}</b><p>{words(rng.randint(5, 60))}</p></div>'
                          for _ in range(rng.randint(1, 4)))
            return rng.choice([f"<section {shown}><h3>{words(1)}</h3>{one}</section>", f"<div {shown}>{one}</div>"])
        body = "".join(f"<p>{words(rng.randint(3, 50))}</p>" for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.4:
            body = words(rng.randint(3, 30))
        if kind == "side":
            return rng.choice([f"<aside>{body}</aside>", f"<aside {shown}>{body}</aside>", f"<div {shown}>{body}</div>"])
        if kind == "frame":
            t = rng.choice(["header", "footer"])
            return rng.choice([f"<{t}>{body}</{t}>", f"<div {shown}>{body}</div>"])
        if kind == "notice" and rng.random() < 0.5:
            shown = rng.choice([shown, 'action="/go"'])
            return f'<form {shown}><label>{words(3)}</label><input name="q"><p>{words(6)}</p><button>ok</button></form>'
        return rng.choice([f"<div {shown}>{body}</div>", f"<section {shown}>{body}</section>", f"<p {shown}>{words(20)}</p>"])

    start, stop = re.search(r"<(article|main)\b[^>]*>", page, re.I), None
    for stop in re.finditer(r"</(article|main)\s*>", page, re.I):
        pass
    if not start or not stop or stop.start() < start.end():
        return page, ""
    before, inner, after = page[:start.start()], page[start.end():stop.start()], page[stop.end():]
    name = rng.choice(sorted(GOOD_TOKENS))
    opening, ending = rng.choice([
        ("<article data-main>", "</article>"), ("<main data-main>", "</main>"),
        (f'<article class="{name}" data-main>', "</article>"), (f'<div class="{name}" data-main>', "</div>"),
        (f'<div id="{name}" data-main>', "</div>"), (f'<div class="page-{name}" data-main>', "</div>"),
        (f'<section class="{name}" data-main>', "</section>"), ("<main><div data-main>", "</div></main>"),
        ("<div data-main>", "</div>")])
    inner = reshaped(inner, rng)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    if rng.random() < 0.3:
        inner = re.sub(r"(?i)</?h1\b[^>]*>", lambda m: m[0].lower().replace("h1", "h2"), inner)
    for place in range(2):  # inside the article, at its start or end
        if rng.random() < 0.5:
            inner = inner + filler() if place else filler() + inner
    around = ["".join(filler() for _ in range(rng.randint(0, 3))) for _ in range(2)]
    if rng.random() < 0.4:
        before, after = before + '<div class="wrap">', "</div>" + after
    return before + around[0] + opening + inner + ending + around[1] + after, "data-main"


def reshaped(inner: str, rng: random.Random) -> str:
    """The article's inside with fewer or shorter blocks, and some in other elements (list, quote, table, bare)."""
    blocks = [b for b in re.split(r"(?=<(?:p|h[1-6])\b)", inner) if b.strip()]
    if rng.random() < 0.4:
        blocks = blocks[:rng.randint(1, 4)]
    short = rng.random() < 0.35
    out = []
    for block in blocks:
        text = html_lib.unescape(re.sub(r"<[^>]+>", " ", block)).split()
        if not text:
            continue
        if short:
            text = text[:rng.randint(1, 12)]
        plain = html_lib.escape(" ".join(text), quote=False)
        turn = rng.random()
        if block.startswith("<h"):
            level = rng.randint(1, 3)
            out.append(f"<h{level}>{' '.join(plain.split()[:rng.randint(1, 12)])}</h{level}>")
        elif turn < 0.08:
            out.append(f"<ul><li>{plain}</li><li>{' '.join(plain.split()[:6])}</li></ul>")
        elif turn < 0.14:
            out.append(f"<blockquote><p>{plain}</p></blockquote>")
        elif turn < 0.18:
            out.append(f"<table><tr><td>{plain}</td><td>{' '.join(plain.split()[:3])}</td></tr></table>")
        elif turn < 0.21:
            out.append(f"<pre>{plain}</pre>")
        elif turn < 0.24:
            out.append(f"<p>{plain[:60]} <a href='#'>{plain[60:120]}</a> {plain[120:]}</p>")
        elif turn < 0.28:
            out.append(f"<h3>{' '.join(plain.split()[:5])}</h3><p>{plain}</p>")
        else:
            out.append(f"<p>{plain}</p>" if short else block)
    return "".join(out)


def training_set(pages: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels and weights of the pages and their variants."""
    rng = random.Random(seed)
    plain = [assemble(d, np.ones(len(d.tag), bool)) for d in map(parse, pages)]
    texts = [line for t in plain for line in t.split("\n") if line] or ["text"]
    xs, ys, ws = [], [], []
    for page in pages:
        for k in range(VARIANTS + 1):
            source, marker = (page, "") if k == 0 else variant(page, texts, rng)
            if marker:
                # the marker tells the main element while labelling; it is taken off before the features
                dom = parse(source.replace(f" {marker}>", f' role="{MARKER}">'))
                labels = marked_labels(dom)
            else:
                dom = parse(source)
                labels = markup_labels(dom)
            if 1 not in labels:
                continue
            x, _, own = features(dom)
            y = np.array(labels)
            use = y >= 0
            use[0] = False
            w = 1 + np.log1p(own)
            xs.append(x[use])
            ys.append(y[use])
            ws.append(w[use] / max(w[use].sum(), 1e-9))
    if not xs:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    x, y, w = np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws)
    return x, y, w * len(w) / w.sum()


def marked_labels(dom: Dom) -> list[int]:
    n = len(dom.tag)
    inside = [0] * n
    for i in range(1, n):
        up = inside[dom.parent[i]]
        if MARKER in dom.tokens[i]:
            inside[i] = 1
            dom.tokens[i] = tuple(w for w in dom.tokens[i] if w != MARKER)
        elif up == 1 and (dom.tag[i] in ("nav", "aside", "footer", "form", "header")
                          or any(w in _BAD for w in dom.tokens[i])):
            inside[i] = 2
        else:
            inside[i] = up
    labels = [1 if x == 1 else 0 for x in inside]
    for i in range(1, n):
        if labels[i]:
            p = dom.parent[i]
            while p >= 0 and inside[p] == 0:
                labels[p] = -1
                p = dom.parent[p]
    return labels


def fit(pages: list[str]) -> Trees | None:
    x, y, w = training_set(pages)
    return boost(x, y, w) if len(y) and 0 < y.mean() < 1 else None


def extract(pages: list[str | None], trees: Trees | None) -> list[str]:
    """Main text of each page; without a model (no labelled page) all visible text."""
    out = []
    for at in range(0, len(pages), BLOCK):
        doms = [parse(p or "") for p in pages[at:at + BLOCK]]
        parts = [features(d) for d in doms]
        if trees is None:
            out += [assemble(d, np.ones(len(d.tag), bool)) for d in doms]
            continue
        odds = trees.log_odds(np.concatenate([x for x, _, _ in parts]))
        k = 0
        for dom, (x, parent, own) in zip(doms, parts, strict=True):
            out.append(assemble(dom, decode(odds[k:k + len(x)], parent, own)))
            k += len(x)
    return out


def training_pages(pages: DataFrame, n: int = TRAIN_PAGES) -> list[str]:
    """At most ``n`` whole pages that mark their main content, in hash order of the page_id."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select("page_id", "html")
    count = marked.count()
    span = 1 << 40
    share = int(span * min(1.0, 1.5 * n / max(count, 1) + 1e-9))
    h = F.pmod(F.xxhash64("page_id"), F.lit(span))
    rows = marked.withColumn("_h", h).where(F.col("_h") < share).dropDuplicates(["_h"]).orderBy("_h").limit(n)
    return [r["html"] for r in rows.collect()]


def _extract_batches(batches: Iterator[pa.RecordBatch], trees: Trees | None):
    for batch in batches:
        texts = extract(batch.column(2).to_pylist(), trees)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def main_text_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text.  Repeated rows are extracted each.
    Extra columns are ignored; an empty table gives an empty result; if no page
    marks its main content, all visible text is kept.
    """
    spark = pages.sparkSession
    python_workers(spark, 1000)
    shared = spark.sparkContext.broadcast(fit(training_pages(pages)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda b: _extract_batches(b, shared.value),
                           "page_id long, url string, text string, n_chars long")
