"""Operator 2, HTML extraction: boosted trees over DOM nodes, decoded along the tree.

Each page is parsed into a tree of block elements and text runs (inline elements are
transparent; scripts, styles, comments and the like never give text). Gradient-boosted
trees score every node from its tag, attribute tokens of itself and its ancestors, depth,
subtree density, link density, punctuation and sibling statistics. Hierarchical decoding
then chooses, for each node, to take the whole subtree, to leave it, or to let its
children decide, so that the score of the chosen nodes is largest and no descendant
contradicts its ancestor.

The trees are grown on the driver from at most ``SAMPLE`` pages. Their labels are weak:
text runs of the sampled pages are dealt into generated layouts whose parts are known
(menus, headers, notices, adverts, forms, sidebars, comments, articles), and sampled
pages with an article element count with that element as the content.

Defined cases: null html gives an empty text; so does a page without any content. Broken
markup is closed at the end of the page; very long pages are parsed whole, in linear time. A
line break element is white space inside its block. Of nodes that score alike the upper one
decides. An empty table gives no row. Repeated rows are extracted one by one; other columns are ignored; without pages to
sample the layouts are filled with made-up words. Map-only: no shuffle, no key can be hot.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import bound_batches, hashed_sample, table

#: Pages that the driver samples to grow the trees.
SAMPLE = 300
TREES, DEPTH, RATE, BINS = 80, 4, 0.25, 24

#: Fixed by HTML: elements that have no end tag, whose content is no markup, that are inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements whose content is no text of the page; the second kind also ends where a block of the third begins.
DROPPED = frozenset("noscript template svg select datalist button object canvas audio video".split())
SHORT = frozenset("select datalist button".split())
BLOCKS = frozenset("article main section header footer nav aside form table h1 h2 h3 h4 h5 h6 p ul ol dl blockquote pre".split())
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msqrt semantics option optgroup a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Fixed by HTML: an open element of the first kind ends where one of the second begins.
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())

#: A quoted value ends at a quote that white space, a slash or the tag's end follows; any other quote is a letter like any.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|["'])*+)>""", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Attribute tokens that tell what a part of a page is for.
TOKENS = {
    "content": "article content main post entry story text body prose articlebody page single blog news",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs tabs pagination pager toc topnav skip",
    "header": "header masthead topbar top branding logo banner hero site",
    "footer": "footer bottom copyright colophon legal foot",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more tags teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning privacy disclaimer subscribe newsletter signup paywall toast",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense commercial",
    "form": "form search login register input field contact searchbox",
    "comment": "comment comments reply replies discussion disqus respond thread reader feedback commentlist",
    "share": "share social sharing follow twitter facebook meta byline author",
}
CATEGORY = {t: i for i, words in enumerate(TOKENS.values()) for t in words.split()}
N_CAT = len(TOKENS)
TAGS = {t: i for i, names in enumerate(["#text", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "li dd dt", "article main", "nav menu", "header", "footer", "aside", "form fieldset", "ul ol dl", "table tr td th tbody thead"]) for t in names.split()}
N_TAG = 13  # the last one: anything else
N_FEATURES = N_TAG * 2 + N_CAT * 2 + 11


@dataclass
class Dom:
    """Parallel lists; a parent comes before its children and a subtree is contiguous."""

    tag: list
    parent: list
    cats: list  # bit set of the attribute categories of the node itself
    text: list  # of text runs, white space normalised; else ""
    linked: list  # characters of the run inside links


class _Ends:
    """Where an element's end tag comes next; each text is searched once for a name that has none left."""

    def __init__(self, source: str):
        self.source, self.last, self.next = source, {}, {}

    def after(self, name: str, at: int) -> int:
        """The place of the next end tag from ``at``, -1 if there is none."""
        last = self.last.get(name)
        if last is not None and last < at:
            return -1
        if name not in self.last:
            self.last[name] = max((m.start() for m in _end(name).finditer(self.source, at)), default=-1)
            if self.last[name] < at:
                return -1
        if self.next.get(name, -1) < at:
            self.next[name] = _end(name).search(self.source, at).start()
        return self.next[name]


_END: dict[str, re.Pattern] = {}


def _end(name: str) -> re.Pattern:
    if name not in _END:
        _END[name] = re.compile(f"</{name}(?=[\\s/>])", re.I)
    return _END[name]


def parse(source: str) -> Dom:
    """The tree of a page, in time linear in its length.

    Raw elements (scripts and the like) end at their end tag, whatever they hold; a dropped element ends at its own
    end tag, where an element around it ends or, for controls, where a block begins, and isn't dropped if it has no end tag.
    """
    tag, parent, cats, text, linked = ["#root"], [-1], [0], [""], [0]
    stack = [0]
    open_: dict[str, int] = {"#root": 1}
    run: list[str] = []
    run_link = link_depth = 0
    ends = _Ends(source)

    def end_run():
        nonlocal run_link
        if run:
            words = " ".join(html.unescape("".join(run)).split())
            if words:
                tag.append("#text")
                parent.append(stack[-1])
                cats.append(0)
                text.append(words)
                linked.append(min(run_link, len(words)))
            run.clear()
        run_link = 0

    def close(names, until=()):
        if not any(open_.get(t) for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            t = tag[stack[i]]
            if t in names:
                for k in stack[i:]:
                    open_[tag[k]] -= 1
                del stack[i:]
                return
            if t in until:
                return

    def add(piece):
        nonlocal run_link
        run.append(piece)
        if link_depth:
            run_link += len(piece.strip())

    at, last = 0, source.rfind(">")
    in_head = False
    dropped: list[str] = []  # a dropped element and the blocks open in it
    while at < len(source):
        begin = source.find("<", at)
        piece = source[at : begin if begin >= 0 else len(source)]
        if piece and not dropped:
            if in_head and piece.strip():
                in_head = False
            if not in_head:
                add(piece)
        if begin < 0:
            break
        follows = source[begin + 1 : begin + 2]
        if follows in ("!", "?"):
            comment = source.startswith("<!--", begin)
            end = source.find("-->" if comment else ">", begin + 2)
            if end < 0:  # without an end it is the rest of the page
                break
            at = end + (3 if comment else 1)
            continue
        m = _TAG.match(source, begin) if begin < last and (follows == "/" or follows.isalpha()) else None
        if m is None:
            if begin > last and (follows == "/" or follows.isalpha()):
                break  # a tag that the page's end cuts off
            if not dropped:
                add("<")
            at = begin + 1
            continue
        at = m.end()
        ending, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if not ending and name in RAW:
            end = ends.after(name, at)
            if end >= 0:
                at = source.find(">", end) + 1 or len(source)
            elif name in ("script", "style"):
                break
            continue
        if dropped:
            if ending:
                if name in dropped:
                    del dropped[len(dropped) - 1 - dropped[::-1].index(name) :]
                    continue
                if name in INLINE or not open_.get(name):
                    continue
            elif dropped[0] in SHORT and name in BLOCKS:
                pass
            else:
                if name not in VOID and name not in INLINE and not attributes.rstrip().endswith("/"):
                    dropped.append(name)
                continue
            dropped.clear()
        if name == "head":
            in_head = not ending
            continue
        if not ending and name not in HEAD:
            in_head = False
        if in_head:
            if name in DROPPED and not ending and ends.after(name, at) >= 0:
                dropped.append(name)
            continue
        if not ending:
            if name in DROPPED:
                if name in SHORT:
                    run.append(" ")
                if not attributes.rstrip().endswith("/") and ends.after(name, at) >= 0:
                    dropped.append(name)
                continue
            if name in INLINE:
                if name == "a":
                    link_depth = 1
                elif name == "br":
                    run.append(" ")
                continue
            end_run()
            link_depth = 0
            if name in P_ENDS:
                close(("p",), ("td", "th", "button", "#root"))
            if name == "li":
                close(("li",), ("ul", "ol", "menu"))
            elif name in ("dd", "dt"):
                close(("dd", "dt"), ("dl",))
            elif name in ("td", "th"):
                close(("td", "th"), ("tr", "table"))
            elif name == "tr":
                close(("tr",), ("table",))
            if name in VOID:
                continue
            mask = 0
            if attributes:
                for a in _ATTR.finditer(attributes):
                    for w in _WORD.findall(a[1] or a[2] or a[3] or ""):
                        c = CATEGORY.get(w.lower())
                        if c is not None:
                            mask |= 1 << c
            tag.append(name)
            parent.append(stack[-1])
            cats.append(mask)
            text.append("")
            linked.append(0)
            if not attributes.rstrip().endswith("/"):
                stack.append(len(tag) - 1)
                open_[name] = open_.get(name, 0) + 1
        elif name in INLINE:
            if name == "a":
                link_depth = 0
        elif name not in DROPPED:
            end_run()
            close((name,))
    end_run()
    return Dom(tag, parent, cats, text, linked)


def features(dom: Dom) -> np.ndarray:
    """A row for each node."""
    n = len(dom.tag)
    parent = np.array(dom.parent)
    kind = np.array([TAGS.get(t, N_TAG - 1) for t in dom.tag])
    own = np.array([len(t) for t in dom.text], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in dom.text], np.float64)
    stops = np.array([t.count(". ") + t.count(", ") + t.endswith((".", "!", "?")) if t else 0 for t in dom.text], np.float64)
    sums = np.stack([own, words, stops, np.array(dom.linked, np.float64), np.ones(n), (own > 0).astype(np.float64)], 1)
    depth = np.zeros(n)
    above = np.zeros((n, N_TAG), bool)
    mask = list(dom.cats)
    upper = [0] * n
    for i in range(1, n):
        p = dom.parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p]
        above[i, kind[p]] = True
        upper[i] = upper[p] | mask[p]
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    first = np.cumsum(own) - own
    total = max(own.sum(), 1)
    chars, n_words, n_stops, link, tags, runs = sums.T
    children = np.bincount(parent[1:], minlength=n).astype(np.float64)
    up = np.maximum(parent, 0)
    bits = np.arange(N_CAT)
    out = np.empty((n, N_FEATURES), np.float32)
    out[:, :N_TAG] = kind[:, None] == np.arange(N_TAG)
    out[:, N_TAG : 2 * N_TAG] = above
    at = 2 * N_TAG
    out[:, at : at + N_CAT] = (np.array(mask)[:, None] >> bits) & 1
    out[:, at + N_CAT : at + 2 * N_CAT] = (np.array(upper)[:, None] >> bits) & 1
    rest = [
        np.log1p(chars), link / np.maximum(chars, 1), n_stops / np.maximum(n_words, 1), chars / tags, np.minimum(depth, 20), first / total,
        children[up], chars / np.maximum(chars[up], 1), np.log1p((chars[up] - chars) / np.maximum(children[up] - 1, 1)), n_words / np.maximum(runs, 1), chars / total,
    ]
    out[:, at + 2 * N_CAT :] = np.stack(rest, 1)
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: feature, threshold and leaf tables."""

    feature: np.ndarray  # TREES x (2 ** DEPTH - 1)
    cut: np.ndarray
    leaf: np.ndarray  # TREES x 2 ** DEPTH
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = 2**DEPTH - 1
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss with binned splits."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    p0 = float(np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99))
    bias = float(np.log(p0 / (1 - p0)))
    score = np.full(n, bias)
    inner = 2**DEPTH - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, inner + 1))
    rng = np.random.default_rng(1)
    for t in range(TREES):
        some = rng.choice(d, max(1, d // 2), replace=False)  # each tree sees half of the features
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-3, 0, -1)
            if len(mine) >= 20:
                G, H = g[mine].sum(), h[mine].sum()
                for j in some:
                    if not len(edges[j]):
                        continue
                    b = binned[mine, j]
                    gl = np.cumsum(np.bincount(b, g[mine], BINS + 1))[: len(edges[j])]
                    hl = np.cumsum(np.bincount(b, h[mine], BINS + 1))[: len(edges[j])]
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[2] >= 0:
                feature[t, node], cut[t, node] = best[1], edges[best[1]][best[2]]
            at[mine] = 2 * node + 1 + (x[mine, feature[t, node]] > cut[t, node])
        for k in range(inner + 1):
            mine = at - inner == k
            leaf[t, k] = RATE * g[mine].sum() / (h[mine].sum() + 1)
        score += leaf[t, at - inner]
    return Trees(feature, cut, leaf, bias)


#: What the score of a node counts against the scores of the runs below it.
OWN_WEIGHT = 1.0
#: Gain that letting the children decide must bring.
SPLIT = 0.25


def decode(dom: Dom, scores: np.ndarray) -> list[bool]:
    """Whether each text run is taken: the best consistent cut through the tree."""
    n = len(dom.tag)
    parent, s = dom.parent, scores.tolist()
    take, leave, free = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        # s > 0 speaks for content; a whole subtree is taken or left with all its scores
        take[i] += OWN_WEIGHT * s[i]
        leave[i] -= OWN_WEIGHT * s[i]
        if parent[i] >= 0:
            best = max(take[i], leave[i], free[i] - SPLIT if dom.tag[i] != "#text" else -np.inf)
            p = parent[i]
            take[p] += take[i]
            leave[p] += leave[i]
            free[p] += best
    state = [0] * n  # 1 taken, -1 left, 0 undecided
    for i in range(n):
        if i and state[parent[i]]:
            state[i] = state[parent[i]]
        elif dom.tag[i] == "#text":
            state[i] = 1 if take[i] > 0 else -1
        elif free[i] - SPLIT < max(take[i], leave[i]):
            state[i] = 1 if take[i] > leave[i] else -1
    return [x == 1 for x in state]


def _made_up(rng: random.Random) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(12, 60))).capitalize() + "."


def layout(rng: random.Random, paragraphs: list[str]) -> tuple[str, set[str]]:
    """A generated page and the marks of its content runs; each run begins with a mark of its own."""
    serial, content = [0], set()

    def words(lo: int, hi: int) -> str:
        x = rng.choice(paragraphs).split()
        k = rng.randint(lo, hi)
        i = rng.randrange(max(1, len(x) - k))
        return html.escape(" ".join(x[i : i + k]) or "word")

    def run(text: str, good: bool = False) -> str:
        serial[0] += 1
        mark = f"qz{serial[0]}x"
        if good:
            content.add(mark)
        return f"{mark} {text}"

    def part(tags: str, tokens: str, inside: str, bare: float = 0.15) -> str:
        t, token = rng.choice(tags.split()), rng.choice(tokens.split())
        semantic = t not in ("div", "section", "ul")
        attr = "" if semantic and rng.random() < 0.6 or rng.random() < bare and semantic else f' {rng.choice(["class", "id"])}="{token}{rng.choice(["", "-box", " wrap", "-inner", "1", "-area"])}"'
        return f"<{t}{attr}>{inside}</{t}>"

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{run(words(1, 3))}</a></li>' for _ in range(k))

    def prose(lo=8, hi=70, good=False) -> str:
        x = run(words(lo, hi), good)
        if rng.random() < 0.2:
            x = f"<b>{x}<br>"
        return f"<p>{x}" + ("</p>" if rng.random() < 0.9 else "")

    def junk(kind: str) -> str:
        if kind == "nav":
            return part("nav nav div ul", "nav menu navbar navigation breadcrumb", f"<ul>{links(rng.randint(2, 9))}</ul>")
        if kind == "header":
            return part("header header div", "header masthead topbar branding", f"<a href='/'>{run(words(1, 4))}</a>" + (f"<p>{run(words(2, 9))}</p>" if rng.random() < 0.5 else ""))
        if kind == "footer":
            return part("footer footer div", "footer colophon copyright site-footer", f"&copy; {run(words(2, 12))}" + (f"<ul>{links(3)}</ul>" if rng.random() < 0.3 else ""))
        if kind == "side":
            return part("aside aside div section", "sidebar widget related popular recommended", f"<h3>{run(words(1, 4))}</h3>" + (f"<ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else prose(5, 40)))
        if kind == "notice":
            return part("div section", "cookie notice consent alert gdpr newsletter disclaimer popup", rng.choice([prose(4, 30), run(words(4, 30))]))
        if kind == "ad":
            return part("div div section", "ad ads advert sponsored promo advertisement", rng.choice([prose(4, 30), run(words(3, 25)), f"<a href='/buy'>{run(words(3, 12))}</a>"]))
        if kind == "form":
            return f"<form{rng.choice(['', ' class=search', ' id=login'])}><label>{run(words(1, 4))}</label><input name=q>{rng.choice(['', prose(3, 15)])}<button>Go</button></form>"
        many = "".join(part("div li article", "comment reply", f"<h4>{run(words(1, 3))}</h4>" + prose(5, 45), 0.0) for _ in range(rng.randint(1, 5)))
        return part("section div", "comments discussion replies comment-list", f"<h2>{run(words(1, 3))}</h2>{many}", 0.0)

    def block() -> str:
        x = rng.random()
        if x < 0.64:
            return prose(3 if rng.random() < 0.2 else 10, 80, True)
        if x < 0.72:
            return f"<h2>{run(words(2, 8), True)}</h2>"
        if x < 0.77:
            return "<ul>" + "".join(f"<li>{run(words(3, 25), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if x < 0.81:
            return f"<blockquote>{prose(8, 40, True)}</blockquote>"
        if x < 0.84:
            return f"<div>{run(words(10, 50), True)}</div>"
        return junk(rng.choice(["ad", "ad", "notice", "side", "form"]))

    body = f"<h1>{run(words(2, 10), True)}</h1>" * (rng.random() < 0.9) + "".join(block() for _ in range(rng.randint(1, 12)))
    if rng.random() < 0.25:
        body += junk(rng.choice(["comment", "comment", "nav", "form"]))
    plain = rng.random() < 0.12  # no part of its own: the text stands in the page or in a nameless element
    main = rng.choice([body, f"<div>{body}</div>", f"<p>{run(words(10, 60), True)}</p>", run(words(10, 60), True)]) if plain else part("article article main div div section", "content article post entry-content article-body story main-content post-text", body, 0.0)
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        main = part("div main section", "main wrapper page container row content", rng.choice(["", junk("side")]) + main, 0.3)
    rate = rng.choice([0.0, 0.3, 0.6])
    before = [junk(k) for k in ("header", "nav", "notice", "ad", "form", "side") if rng.random() < rate]
    after = [junk(k) for k in ("comment", "side", "ad", "form", "notice", "nav") if rng.random() < rate]
    rng.shuffle(before)
    end = junk("footer") if rng.random() < 0.85 else ""
    return f"<html><head><title>x</title></head><body>{''.join(before)}{main}{''.join(after)}{end}" + "</body></html>" * (rng.random() < 0.9), content


def fit_trees(pages: list[str], layouts: int = 700, seed: int = 7) -> Trees:
    """Trees from generated layouts filled with the sampled pages' runs, and from the pages themselves."""
    rng = random.Random(seed)
    doms = [parse(p) for p in pages]
    paragraphs = [t for d in doms for t, g in zip(d.text, d.tag) if g == "#text" and t.count(" ") >= 8] or [_made_up(rng) for _ in range(200)]
    xs, ys, ws = [], [], []

    def add(dom: Dom, good: list[bool], weight: float = 1.0):
        n = len(dom.tag)
        chars, yes = np.array([len(t) for t in dom.text], float), np.zeros(n)
        yes = chars * np.array(good)
        for i in range(n - 1, 0, -1):
            chars[dom.parent[i]] += chars[i]
            yes[dom.parent[i]] += yes[i]
        keep = chars > 0
        share = yes[keep] / chars[keep]
        xs.append(features(dom)[keep])
        ys.append((share > 0.5).astype(float))
        ws.append(weight * (np.abs(share - 0.5) * 2 + 0.02))

    for _ in range(layouts):
        source, content = layout(rng, paragraphs)
        dom = parse(source)
        add(dom, [t.partition(" ")[0] in content for t in dom.text])
    for dom in doms:
        inside = [False] * len(dom.tag)
        for i in range(1, len(dom.tag)):
            inside[i] = inside[dom.parent[i]] or dom.tag[i] == "article"
        if any(inside) and "form" not in dom.tag and not any(c & 0b0111111110 for i, c in enumerate(dom.cats) if inside[i]):
            add(dom, [a and g == "#text" for a, g in zip(inside, dom.tag)], 4.0)
    return grow(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extract(source: str, trees: Trees) -> str:
    """The main text of one page."""
    dom = parse(source)
    taken = decode(dom, trees.score(features(dom)))
    return "\n".join(t for t, y in zip(dom.text, taken) if y and t)


def extract_pages(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    bound_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            doms = [parse(x or "") for x in batch.column(2).to_pylist()]
            sizes = np.cumsum([0] + [len(d.tag) for d in doms])
            scores = trees.score(np.concatenate([features(d) for d in doms])) if doms else np.zeros(0)
            texts = []
            for d, a, b in zip(doms, sizes, sizes[1:]):
                texts.append("\n".join(t for t, y in zip(d.text, decode(d, scores[a:b])) if y and t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` pages, chosen by a hash of their ids."""
    some = pages.where(F.col("html").isNotNull()).select("page_id", "html")
    some = hashed_sample(some, "page_id", sample, some.count()).collect()
    return fit_trees([r["html"] for r in some])


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fitted(pages))
