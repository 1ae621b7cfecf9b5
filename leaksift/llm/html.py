"""HTML extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is cut into block elements and text blocks. Every element gets features
of its tag, attribute words, depth, subtree density, links and siblings; the
trees say how likely its text belongs to the article. Decoding picks the best
consistent labels: a dropped element drops all below it, a kept one may hold
dropped ones, and only elements above the article stay undecided.

The trees are fitted on layouts built around text of a bounded sample of the
given pages, where what is article is known. Each page is extracted on its
own, so nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksift.llm.boosting import Trees, boosted

SAMPLE_PAGES = 256
SAMPLE_CHARS = 200_000  # of each page of the sample that the trees are fitted on; pages are extracted whole
LAYOUTS = 1000
BATCH = 256

# Element classes of HTML.
BLOCKS = frozenset("""html body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
 table tbody thead tfoot tr blockquote pre figure figcaption details summary address center hgroup dialog""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style noscript template svg iframe object textarea select button canvas audio video math title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
SPACED = frozenset("br hr td th img option label".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "tbody": ("tbody", "thead", "tr"), "p": ("p",)}
ENDS_P = BLOCKS - frozenset("html body".split())

TAGS = ("article", "main", "section", "div", "p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "other")
_TAG_GROUP = {"article": 0, "main": 1, "section": 2, "div": 3, "p": 4, "li": 6, "dt": 6, "dd": 6, "ul": 7, "ol": 7, "dl": 7, "nav": 8, "header": 9,
              "footer": 10, "aside": 11, "form": 12, "fieldset": 12, "dialog": 12, "table": 13, "tr": 13, "tbody": 13, "thead": 13, "tfoot": 13,
              "blockquote": 14, "pre": 14, "figure": 15, "figcaption": 15, **{f"h{i}": 5 for i in range(1, 7)}}
# Attribute words by what they name; a word counts where it begins an attribute token.
WORDS = (
    ("article", "content", "main", "post", "entry", "body", "story", "text", "page"),
    ("nav", "menu", "breadcrumb", "crumb", "toc", "pagination", "pager", "skip", "topbar"),
    ("header", "masthead", "logo", "brand", "sitetitle", "site", "tagline", "hero"),
    ("footer", "foot", "copyright", "legal", "bottom", "colophon", "imprint"),
    ("sidebar", "side", "aside", "widget", "related", "rail", "recommend", "trending", "popular", "more", "teaser", "tags"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adsense", "affiliate"),
    ("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "privacy", "disclaimer", "warning"),
    ("form", "login", "signup", "subscribe", "newsletter", "search", "contact", "register", "share", "social"),
    ("comment", "comments", "reply", "replies", "respond", "response", "responses", "disqus", "discussion", "thread", "review", "reviews"),
)
_WORD_GROUP = {w: i for i, group in enumerate(WORDS) for w in group}
_TOKEN = re.compile(r"[a-z]+")
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I | re.A)
_HIDING = re.compile(r"(?:\A|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|\Z)", re.I | re.A)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
# Lower case can be longer than the text itself, so the text is searched, with ASCII letters of either case.
_RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
MARK = "x-main"

GROUPS = len(WORDS)
NODE_FEATURES = len(TAGS) * 2 + GROUPS * 2 + 24


def is_hidden(attrs: str) -> bool:
    """Whether attributes hide their element: ``hidden``, ``aria-hidden=true``, or a style of display none or visibility hidden."""
    if not _MAY_HIDE.search(attrs):
        return False
    for found in _ATTRIBUTE.finditer(attrs):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if (name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true")
                or (name == "style" and _HIDING.search(value))):
            return True
    return False


class Page:
    """Block elements of one page in document order, and its text blocks."""

    __slots__ = ("tag", "parent", "depth", "words", "hidden", "marked", "tags", "blocks")

    def __init__(self, html: str | None) -> None:
        self.tag, self.parent, self.depth, self.words, self.hidden, self.marked = [len(TAGS) - 1], [-1], [0], [()], [False], [False]
        self.tags, self.blocks = [0], []  # tags per element; blocks: (element, text, characters in links)
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = []
        node, never, inside_link = 0, 0, 0
        run: list[str] = []
        linked = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                run.clear()
                if text:
                    self.blocks.append((node, text, min(linked, len(text))))
            linked = 0

        def take(raw: str) -> None:
            nonlocal linked
            if raw and not never:
                text = unescape(raw) if "&" in raw else raw
                run.append(text)
                if inside_link:
                    linked += len(text)

        while True:
            found = _TAG.search(html, at)
            if found is None:
                take(html[at:])
                break
            take(html[at:found.start()])
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            name, closing, attrs = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
            if not closing:
                if name in VOID:
                    if name in SPACED and not never:
                        run.append(" ")
                    self.tags[node] += 1
                    continue
                if name in ENDS_P:
                    ends = CLOSES.get(name, ("p",)) if name != "p" else ("p",)
                    for i in range(len(stack) - 1, -1, -1):
                        other = stack[i][0]
                        if other in ends:
                            flush()
                            never -= sum(1 for o, _ in stack[i:] if o in NEVER)
                            inside_link -= sum(1 for o, _ in stack[i:] if o == "a")
                            node = stack[i][1]
                            del stack[i:]
                            break
                        if other in BLOCKS and other != "p":
                            break
                if name in BLOCKS:
                    flush()
                    stack.append((name, node))
                    self._open(name, attrs, node)
                    node = len(self.tag) - 1
                else:
                    if name in SPACED and not never:
                        run.append(" ")
                    stack.append((name, node))
                    self.tags[node] += 1
                    never += name in NEVER
                    inside_link += name == "a"
                    if name in RAW:
                        end = _RAW_END[name].search(html, at)
                        at = end.start() if end else len(html)
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(o in BLOCKS for o, _ in stack[i:]):
                        flush()
                    never -= sum(1 for o, _ in stack[i:] if o in NEVER)
                    inside_link -= sum(1 for o, _ in stack[i:] if o == "a")
                    node = stack[i][1]
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag does not close a block
            if name in SPACED and not never:
                run.append(" ")
        flush()

    def _open(self, name: str, attrs: str, parent: int) -> None:
        self.tag.append(_TAG_GROUP.get(name, len(TAGS) - 1))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        groups = ()
        hidden = marked = False
        if attrs:
            tokens = [t for value in _ATTR.findall(attrs) for t in _TOKEN.findall(value.lower())]
            groups = tuple(sorted({_WORD_GROUP[t] for t in tokens if t in _WORD_GROUP}
                                  | {_WORD_GROUP[t[:-1]] for t in tokens if t[:-1] in _WORD_GROUP and t not in _WORD_GROUP}))
            hidden, marked = is_hidden(attrs), MARK in attrs
        self.words.append(groups)
        self.hidden.append(hidden)
        self.marked.append(marked)
        self.tags.append(1)


def node_features(page: Page) -> np.ndarray:
    """One row per element: own and inherited tag and attribute words, depth, subtree density, links, siblings."""
    n = len(page.tag)
    chars, links, stops, blocks, tags, shorts = (np.zeros(n) for _ in range(6))
    first = np.full(n, np.inf)
    running = 0
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        stops[node] += text.count(".") + text.count(",")
        blocks[node] += 1
        shorts[node] += len(text) < 40
        first[node] = min(first[node], running)
        running += len(text)
    own = chars.copy()
    tags += page.tags
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
        blocks[p] += blocks[i]
        shorts[p] += shorts[i]
        tags[p] += tags[i]
        first[p] = min(first[p], first[i])
    total = max(chars[0], 1.0)
    up = np.array([max(p, 0) for p in parent])
    out = np.zeros((n, NODE_FEATURES), np.float32)
    tag = np.array(page.tag)
    out[np.arange(n), tag] = 1
    t = len(TAGS)
    inherited = out[:, t:2 * t]
    word_own, word_up = out[:, 2 * t:2 * t + GROUPS], out[:, 2 * t + GROUPS:2 * t + 2 * GROUPS]
    for i in range(1, n):
        for g in page.words[i]:
            word_own[i, g] = 1
        p = parent[i]
        inherited[i] = inherited[p]
        inherited[i, tag[p]] = 1
        word_up[i] = np.maximum(word_up[p], word_own[p])
    rest = out[:, 2 * t + 2 * GROUPS:]
    siblings = np.bincount(up[1:], minlength=n).astype(float)
    place = np.zeros(n)
    seen: dict[int, int] = {}
    same: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        place[i] = seen.get(parent[i], 0)
        seen[parent[i]] = int(place[i]) + 1
        key = (parent[i], page.tag[i])
        same[key] = same.get(key, 0) + 1
    alike = np.array([1] + [same[(parent[i], page.tag[i])] for i in range(1, n)], float)
    density = chars / np.maximum(tags, 1)
    rest[:, 0] = page.depth
    rest[:, 1] = np.log1p(chars)
    rest[:, 2] = chars / total
    rest[:, 3] = links / np.maximum(chars, 1)
    rest[:, 4] = np.log1p(density)
    rest[:, 5] = stops / np.maximum(chars, 1) * 100
    rest[:, 6] = blocks
    rest[:, 7] = shorts / np.maximum(blocks, 1)
    rest[:, 8] = np.log1p(chars / np.maximum(blocks, 1))
    rest[:, 9] = np.where(np.isfinite(first), first, 0) / total
    rest[:, 10] = own / np.maximum(chars, 1)
    rest[:, 11] = siblings[up]
    rest[:, 12] = place
    rest[:, 13] = siblings[up] - place
    rest[:, 14] = alike
    rest[:, 15] = chars / np.maximum(chars[up], 1)
    rest[:, 16] = rest[up, 3]
    rest[:, 17] = rest[up, 4]
    rest[:, 18] = rest[up, 8]
    rest[:, 19] = siblings
    rest[:, 20] = page.hidden
    rest[:, 21] = np.log1p(total)
    before, after = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    for i in range(1, n):
        j = last.get(parent[i])
        if j is not None:
            before[i], after[j] = chars[j], chars[i]
        last[parent[i]] = i
    rest[:, 22], rest[:, 23] = np.log1p(before), np.log1p(after)
    return out


def decoded(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each text block is kept: the labels of greatest total log odds that do not contradict each other.

    An element is undecided, kept or dropped. All below a dropped one is
    dropped; below a kept one elements are kept or dropped. A text block takes
    its element's label and cannot be undecided.
    """
    n = len(page.tag)
    has_text = [False] * n
    for node, _, _ in page.blocks:
        has_text[node] = True
    score = np.clip(odds, -6, 6).tolist()
    hidden = page.hidden
    below_keep, below_open, drop = [0.0] * n, [0.0] * n, [0.0] * n
    keep_best, open_best = [0.0] * n, [0.0] * n  # best of a subtree whose parent is kept, undecided
    choice_keep, choice_open = [0] * n, [0] * n
    drop_sum = [0.0] * n
    for i in range(n - 1, -1, -1):
        s = -6.0 if hidden[i] else score[i]
        dropped = drop_sum[i] - s
        kept = below_keep[i] + s
        undecided = -1e9 if has_text[i] and i else below_open[i]
        choice_keep[i], keep_best[i] = (1, kept) if kept > dropped else (2, dropped)
        choice_open[i], open_best[i] = max(((1, kept), (2, dropped), (0, undecided)), key=lambda c: c[1])
        if i:
            p = page.parent[i]
            below_keep[p] += keep_best[i]
            below_open[p] += open_best[i]
            drop_sum[p] += dropped
    state = [0] * n
    for i in range(1, n):
        above = state[page.parent[i]]
        state[i] = 2 if above == 2 else (choice_keep[i] if above == 1 else choice_open[i])
    # Text directly below the root has no element of its own; it goes by what the trees say of the root.
    state[0] = 1 if score[0] > 0 else 2
    return [state[node] == 1 for node, _, _ in page.blocks]


# --- layouts for fitting -------------------------------------------------------

SHOWN = (' style="overflow:hidden"', ' aria-hidden="false"', ' data-state="hidden"', ' style="backface-visibility:hidden"')


def _layout(rng: random.Random, long: list[str], short: list[str]) -> str:
    """One page around given texts; article blocks carry ``MARK``."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    say = lambda: esc(rng.choice(short))
    tell = lambda: esc(rng.choice(long))
    named = lambda *names: rng.choice(("class", "id")) + f'="{rng.choice(names)}{rng.choice(("", "", "-1", " wide", "-inner"))}"'
    plain = rng.random() < 0.12  # a site that names nothing
    # Attributes that speak of hiding and hide nothing, on blocks of every kind.
    shown = lambda: rng.choice(SHOWN) if rng.random() < 0.1 else ""

    def box(tag: str, body: str, *names: str) -> str:
        if plain and tag in ("nav", "aside", "footer", "header", "div", "section"):
            return f"<div{shown()}>{body}</div>"
        if rng.random() < 0.5 and tag != "div":
            return f"<{tag}{shown()}>{body}</{tag}>"
        return f"<div {named(*names)}{shown()}>{body}</div>" if rng.random() < 0.7 else f"<{tag} {named(*names)}{shown()}>{body}</{tag}>"

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{say()[:rng.randint(4, 40)]}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>" if rng.random() < 0.8 else " ".join(f'<a href="/{i}">{say()[:25]}</a>' for i in range(n))

    def text() -> str:
        return tell() if rng.random() < 0.35 else say()

    def paragraphs(n: int, body) -> str:
        return "".join(f"<p>{body()}</p>" for _ in range(n))

    nav = lambda: box("nav", links(rng.randint(3, 12)), "nav", "menu", "main-nav", "breadcrumbs", "navbar")
    header = lambda: box("header", rng.choice((say(), f"<h1>{say()[:40]}</h1>", f"<p>{say()}</p>")) + rng.choice(("", links(4))), "header", "masthead", "site-header")
    footer = lambda: box("footer", rng.choice((f"&copy; {text()}", f"<p>{text()}</p>", f"<p>{say()}</p>" + links(3))), "footer", "site-footer", "copyright", "legal")
    ad = lambda: box("div", rng.choice((text(), f"<p>{text()}</p>", f'<a href="x">{say()}</a>')), "ad", "ads", "advert", "sponsored", "promo", "ad-banner")
    side = lambda: box("aside", f"<h3>{say()[:30]}</h3>" + rng.choice((links(rng.randint(2, 8)), paragraphs(rng.randint(1, 3), text))), "sidebar", "widget", "related", "right-rail")
    notice = lambda: box("div", rng.choice((text(), f"<p>{text()}</p>")), "cookie-notice", "notice", "consent", "alert", "gdpr", "privacy-notice")
    form = lambda: rng.choice((f"<form>{say()[:30]}<input><p>{say()}</p></form>", box("form", f"<p>{say()}</p><input>", "newsletter", "subscribe", "search", "login")))

    def comments() -> str:
        each = "".join(box("div", f"<p>{text()}</p>", "comment", "reply") if rng.random() < 0.6 else f"<li><p>{text()}</p></li>" if rng.random() < 0.3 else
                       f"<p>{text()}</p>" for _ in range(rng.randint(1, 6)))
        return f"<{rng.choice(('section', 'div', 'div'))} {named('comments', 'comment-list', 'discussion', 'responses', 'replies', 'disqus')}><h3>{say()[:20]}</h3>{each}</section></div>"

    tiny = rng.random() < 0.14

    def main_block() -> str:
        kind = rng.random()
        if kind < 0.75:
            inner = tell() if rng.random() < (0.05 if tiny else 0.8) else say()
            inner = f"<b>{inner}<br>" if rng.random() < 0.1 else inner
            return f"<p {MARK}{shown()}>{inner}" + ("</p>" if rng.random() < 0.9 else "")
        if kind < 0.82:
            return f"<h{rng.randint(2, 4)} {MARK}>{say()[:60]}</h2></h3></h4>"
        if kind < 0.89:
            return "<ul>" + "".join(f"<li {MARK}>{text()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote {MARK}>{text()}</blockquote>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr {MARK}><td>{say()[:20]}</td><td>{say()[:20]}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div {MARK}>{tell()}</div>"

    inner = [f"<h1 {MARK}>{say()[:80]}</h1>"] if rng.random() < 0.8 else []
    inner += [main_block() for _ in range(rng.choice((1, 1, 2) if tiny else (1, 2, 3, 5, 8, 13, 20)))]
    for extra, chance in ((ad, 0.2), (side, 0.1), (form, 0.1), (notice, 0.08)):
        if rng.random() < chance:
            inner.insert(rng.randint(0, len(inner)), extra())
    if rng.random() < 0.2:
        inner.append(comments())
    body = "".join(inner)
    style = rng.random()
    if style < 0.45:
        body = f"<article{rng.choice(('', '', f' {named('post', 'entry', 'article')}'))}>{body}</article>"
    elif style < 0.6:
        body = f"<main>{body}</main>"
    elif style < 0.9:
        body = f"<div {named('content', 'post', 'entry-content', 'article-body', 'story', 'main', 'text', 'post-body')}>{body}</div>"
    else:
        body = f"<div>{body}</div>"
    if rng.random() < 0.3:
        body = f"<div {named('container', 'wrapper', 'page', 'row', 'layout')}{shown()}>{body}</div>"
    before = [part() for part, chance in ((header, 0.5), (nav, 0.8), (notice, 0.25), (ad, 0.35), (side, 0.15), (form, 0.1)) if rng.random() < chance]
    after = [part() for part, chance in ((comments, 0.3), (side, 0.35), (ad, 0.2), (form, 0.2), (nav, 0.1), (notice, 0.15)) if rng.random() < chance]
    rng.shuffle(before)
    rng.shuffle(after)
    end = footer() if rng.random() < 0.85 else ""
    return f"<html><head><title>x</title></head><body>{''.join(before)}{body}{''.join(after)}{end}</body></html>"


def fitted(pages: DataFrame, html: str, sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS, seed: int = 5) -> Trees | None:
    """Trees fitted on layouts around the texts of at most ``sample`` pages, chosen in seeded order."""
    # Only digests are ordered; the few pages they name are then read, so no task sends pages it is not asked for.
    mark = F.xxhash64(F.lit(seed), F.col(html))
    named = pages.where(F.col(html).isNotNull()).select(mark.alias("_o")).distinct().orderBy("_o").limit(sample)
    chosen = (pages.select(mark.alias("_o"), F.substring(html, 1, SAMPLE_CHARS).alias("_h")).join(F.broadcast(named), "_o")
              .groupBy("_o").agg(F.first("_h").alias("_h")))
    texts = sorted({t for r in chosen.collect() for _, t, _ in Page(r["_h"]).blocks})
    if not texts:
        return None
    rng = random.Random(seed)
    long = [t for t in texts if len(t) >= 120] or texts
    short = [t for t in texts if len(t) < 200] or texts
    rows, marks = [], []
    for _ in range(layouts):
        page = Page(_layout(rng, [rng.choice(long)[:1500] for _ in range(20)], [rng.choice(short) for _ in range(30)]))
        good, every = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for node, text, _ in page.blocks:
            every[node] += len(text)
            good[node] += len(text) * page.marked[node]
        for i in range(len(page.tag) - 1, 0, -1):
            good[page.parent[i]] += good[i]
            every[page.parent[i]] += every[i]
        used = every > 0
        rows.append(node_features(page)[used])
        marks.append((good[used] * 2 > every[used]).astype(float))
    return boosted(np.concatenate(rows).astype(np.float64), np.concatenate(marks))


def extract(htmls: list[str | None], trees: Trees | None) -> list[str]:
    """Main text of each page: kept blocks in page order, one per line."""
    pages = [Page(h) for h in htmls]
    if trees is None:
        return ["" for _ in pages]
    features = [node_features(p) for p in pages]
    odds = trees.margin(np.concatenate(features))
    out, at = [], 0
    for page, rows in zip(pages, features):
        keep = decoded(page, odds[at:at + len(rows)])
        at += len(rows)
        out.append("\n".join(text for (_, text, _), k in zip(page.blocks, keep) if k))
    return out


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (code points); every row kept.

    A null or empty page, and one without text, gives an empty text and 0.
    Character references are decoded and white space inside a block becomes one
    space. Unclosed and misnested tags are closed as browsers do for blocks.
    Equal pages give equal texts; an empty table gives an empty one. A column
    called ``text`` or ``n_chars`` is replaced.
    """
    trees = fitted(pages, html)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for lo in range(0, len(batch), BATCH):
                out += extract(batch.iloc[lo:lo + BATCH].tolist(), shared.value)
            yield pd.Series(out, dtype=object)

    text_of = text_of.asNondeterministic()  # keeps the length from computing it twice
    return pages.withColumn("text", text_of(F.col(html))).withColumn("n_chars", F.length("text").cast("bigint")).drop(html)
