"""Main-text extraction by minimum cut.

A page becomes a list of text blocks.  Each block has a cost for being called
content and one for being called boilerplate; these are the terminal
capacities.  They add the evidence of its markup (tags and attribute words,
fixed weights) to the log-odds of a logistic classifier of its shape (length,
link density, heading).  A mark counts by where it stands: on an element around
the article, or around most of the page's text, it says nothing of the text;
below the article it tells what does not belong to it; and text outside is
held against the article if there is one.  Pages carry no labels, so the classifier is fitted by
self-training: on a bounded sample of pages it learns the shape of the blocks
whose markup leaves no doubt.  Neighbouring blocks, and more so blocks under
the same parent element, are tied by smoothness edges.  The minimum cut
between the terminals separates content from boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import extended, slices
from matchloom.llm.crf import minimise

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mroot mrow msqrt msub msup mtext object q s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER_TAGS = frozenset("nav aside footer form menu button select option dialog input label fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Tags that some pages put around everything.
AROUND_TAGS = frozenset("form fieldset label menu".split())
# Words of class, id and role attributes.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies disqus respond share sharing social related recommended recommendations widget toolbar search pagination pager copyright legal skip tags".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
#: Elements of article kind that hold what readers say.
TALK_WORDS = frozenset("comment comments reply replies respond disqus".split())

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    text: str
    parent: int
    boiler: int  # marks of enclosing elements that speak for boilerplate
    content: int  # ... for content
    linked: int  # characters inside links
    heading: bool
    below: bool = False  # marked as boilerplate below the article
    outside: bool = False  # outside the article of a page that has one
    marked: tuple[int, ...] = ()  # enclosing elements with marks


@dataclass(slots=True)
class Mark:
    """What an element's tag and attributes say."""

    words: int
    tag: int
    content: int
    article: bool
    around: bool
    talk: bool
    hidden: bool
    size: int = 0  # characters of all blocks in it


#: An element that holds a larger share of the page's text is a wrapper; an article of at least so large a share is the page's article.
WRAPPER, ARTICLE = 0.6, 0.3


def _attr_marks(attrs: str) -> tuple[int, int, bool]:
    """How many attributes have words of boilerplate and of content, and whether one speaks of readers' comments."""
    if "=" not in attrs:
        return 0, 0, False
    boiler = content = 0
    talk = False
    for m in _ATTR.finditer(attrs):
        words = set(_WORD.findall((m[1] or m[2] or m[3] or "").lower()))
        boiler += bool(words & BOILER_WORDS)
        content += bool(words & CONTENT_WORDS)
        talk |= bool(words & TALK_WORDS)
    return boiler, content, talk


def weigh_marks(found: list[Block], marks: dict[int, Mark]) -> None:
    """Set what each block's enclosing elements say, now that it is known how much of the page each of them holds."""
    total = sum(len(b.text) for b in found)
    for b in found:
        for k in b.marked:
            marks[k].size += len(b.text)
    articles = [k for k, m in marks.items() if m.article and not m.hidden]
    articles = [k for k in articles if not marks[k].talk] or articles
    main = max(articles, key=lambda k: (marks[k].size, k), default=None)
    leads = main is not None and marks[main].size >= ARTICLE * total
    for b in found:
        inside = b.marked.index(main) if main in b.marked else -1
        b.boiler = b.content = 0
        for place, k in enumerate(b.marked):
            m = marks[k]
            wrapper = m.size > WRAPPER * total
            b.content += m.content if not m.words or wrapper or k == main else 0
            words = 0 if place <= inside or wrapper else m.words
            tag = 0 if place < inside or wrapper and m.around else m.tag
            b.boiler += words + tag + 2 * m.hidden
            b.below |= place > inside >= 0 and words + tag > 0
        b.outside = leads and not any(marks[k].article for k in b.marked)


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order.  Markup may be broken: unclosed elements are closed where the HTML rules close them."""
    out: list[Block] = []
    stack: list[tuple[str, int, tuple[int, ...]]] = [("", 0, ())]  # name, element number, elements with marks
    marks: dict[int, Mark] = {}
    number, at, text, linked, links = 0, 0, [], 0, 0

    def close_block() -> None:
        nonlocal text, linked
        words = unescape("".join(text)).split()
        if words:
            at_owner = len(stack) - 1
            while at_owner and stack[at_owner][0] in INLINE:
                at_owner -= 1
            parent = stack[at_owner - 1][1] if at_owner else 0
            joined = " ".join(words)
            heading = stack[at_owner][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
            out.append(Block(joined, parent, 0, 0, min(linked, len(joined)), heading, marked=stack[-1][2]))
        text, linked = [], 0

    def pop_to(k: int) -> None:
        nonlocal links
        for s in stack[k:]:
            links -= s[0] == "a"
            is_open[s[0]] -= 1
        del stack[k:]

    # No tag ends behind the last ">": what begins there is text, and is not searched again and again.
    size, last, is_open = len(html), html.rfind(">") + 1, Counter[str]()
    while at < size:
        m = _PIECE.search(html, at, last) if at < last else None
        if m is None:
            text.append(html[at:].split("<!--", 1)[0])
            break
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if links > 0:
                linked += len(piece.strip())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):  # a comment without an end
                break
            continue
        if name == "br" or name == "hr":
            close_block()
            continue
        if not m[1]:
            if name in RAW:
                if not m[3].endswith("/"):
                    end = _RAW_END[name].search(html, at)
                    at = size if end is None else html.find(">", end.end()) + 1 or size
                continue
            if name in VOID:
                continue
            if name not in INLINE:
                close_block()
                if name in ENDS_P and is_open["p"]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            pop_to(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
                if name in SAME and any(is_open[other] for other in SAME[name]):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in SAME[name]:
                            pop_to(k)
                            break
                        if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                            break
            if m[3].endswith("/"):
                continue
            boiler, content, talk = _attr_marks(m[3])
            if boiler and name in ("html", "body"):
                boiler = 0
            _, _, marked = stack[-1]
            in_article = any(marks[k].article for k in marked)
            mark = Mark(boiler, int(name in BOILER_TAGS or name == "header" and not in_article), min(content, 1) + 2 * (name in CONTENT_TAGS), name in CONTENT_TAGS, name in AROUND_TAGS, talk, bool(_HIDDEN.search(m[3])))
            number += 1
            if mark.words or mark.tag or mark.content or mark.hidden:
                marks[number] = mark
                marked = (*marked, number)
            stack.append((name, number, marked))
            links += name == "a"
            is_open[name] += 1
        elif is_open[name]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name not in INLINE:
                        close_block()
                    pop_to(k)
                    break
    close_block()
    weigh_marks(out, marks)
    return out


#: Weights of the shape classifier before it has seen a page: bias, link density, short block, length, heading.
PRIOR = (0.8, -2.5, -0.6, 1.0, 0.4)
#: Range of its log-odds: that of the prior, so that markup keeps its weight.
LOWEST, HIGHEST = -2.3, 3.2


def shape(share: float, size: int, heading: bool) -> tuple[float, float, float, float, float]:
    """Features of a block: its link density, number of characters, and whether it is a heading."""
    return 1.0, share, float(size < 25 and not heading), min(size, 400) / 200 * (1 - share), float(heading)


def costs(b: Block, weights: Sequence[float] = PRIOR) -> tuple[float, float]:
    """Cost of calling the block content, and of calling it boilerplate."""
    z = sum(w * f for w, f in zip(weights, shape(b.linked / len(b.text), len(b.text), b.heading)))
    z = min(max(z, LOWEST), HIGHEST)
    return 4.0 * min(b.boiler, 2) + 8.0 * b.below + 4.0 * b.outside + max(-z, 0.0), 1.5 * min(b.content, 2) + max(z, 0.0)


def min_cut(n: int, source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (level-graph maximum flow; no recursion)."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):  # what both terminals would carry through the node is carried at once
        through = min(source[i], sink[i])
        if source[i] > through:
            edge(s, i, source[i] - through, 0.0)
        elif sink[i] > through:
            edge(i, t, sink[i] - through, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def content_flags(found: list[Block], weights: Sequence[float] = PRIOR, near: float = 0.3, parent: float = 0.7) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    cost = [costs(b, weights) for b in found]
    apart = [b.boiler > 0 or b.outside for b in found]
    # Blocks next to each other on the page, loosely where one of them alone stands in boilerplate elements, ...
    ties = [(i, i + 1, near if apart[i] == apart[i + 1] else near / 6) for i in range(len(found) - 1)]
    # ... and blocks next to each other under one parent element.
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        j = last.get(b.parent)
        if j is not None and apart[j] == apart[i]:
            ties.append((j, i, parent))
        last[b.parent] = i
    return min_cut(len(found), [g for _, g in cost], [b for b, _ in cost], ties)


def main_text(html: str | None, weights: Sequence[float] = PRIOR) -> str:
    """Content blocks joined by a space; character references decoded, white space collapsed.  Null or empty: ''."""
    found = blocks(html or "")
    return " ".join(b.text for b, keep in zip(found, content_flags(found, weights)) if keep)


def sure_blocks(html: str) -> Iterator[tuple[int, int, bool, bool]]:
    """Blocks whose markup speaks for one side alone: eighths of link density, size in steps of 25 up to 400, heading, content."""
    for b in blocks(html):
        if (b.boiler > 0) != (b.content > 0):
            yield round(8 * b.linked / len(b.text)), min(len(b.text) // 25, 16), b.heading, b.content > 0


def fit(pages: DataFrame, html: str = "html", most: int = 2_000, pull: float = 20.0) -> tuple[float, ...]:
    """Weights of the shape classifier, learned from about ``most`` different pages, those with the lowest hashes.

    Both classes weigh the same; ``pull`` is the weight of :data:`PRIOR`, which
    stays where no page has sure blocks of both kinds.  Only counts of the at
    most 612 kinds of sure blocks reach the driver.
    """
    filled = pages.select(F.col(html).alias("html")).filter(F.length("html") > 0)
    h = F.pmod(F.xxhash64("html"), F.lit(1 << 40))
    rate = min(1.0, most / max(filled.count(), 1))
    sample = filled.filter(h < int(rate * (1 << 40))).dropDuplicates(["html"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Counter(kind for b in batches for page in b.column(0).to_pylist() for kind in sure_blocks(page))
        columns = [*zip(*[(*kind, n) for kind, n in kinds.items()])] or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()))], ["share", "size", "heading", "content", "n"])

    counts = sample.mapInArrow(run, "share int, size int, heading boolean, content boolean, n long").groupBy("share", "size", "heading", "content").agg(F.sum("n").alias("n"))
    return learn([tuple(r) for r in sorted(counts.collect())], pull)


def learn(kinds: list[tuple[int, int, bool, bool, int]], pull: float) -> tuple[float, ...]:
    """Logistic regression on kinds of sure blocks and their counts, drawn towards :data:`PRIOR`."""
    good, bad = (sum(k[4] for k in kinds if k[3] == side) for side in (True, False))
    if not good or not bad:
        return PRIOR
    x = np.array([shape(share / 8, 25 * size + 12 if size < 16 else 400, heading) for share, size, heading, _, _ in kinds])
    y = np.array([1.0 if k[3] else -1.0 for k in kinds])
    # Both classes together weigh as much as there are blocks, but at most 2,000: the prior is not forgotten.
    weight = np.array([k[4] / (good if k[3] else bad) for k in kinds]) * min(good + bad, 2_000) / 2
    prior = np.array(PRIOR)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = y * (x @ w)
        slope = -weight * y / (1 + np.exp(np.clip(m, -500, 500)))
        return float(weight @ np.logaddexp(0, -m) + pull / 2 * ((w - prior) ** 2).sum()), x.T @ slope + pull * (w - prior)

    return tuple(float(w) for w in minimise(loss, prior, 200))


def extract(pages: DataFrame, html: str = "html", weights: Sequence[float] | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (code points) added; one row per page.  The scoring pass does not shuffle.

    ``weights`` are those of the shape classifier; by default :func:`fit` learns them from ``pages``.
    Null and empty pages give empty text.  Pages of any length are read whole,
    in time that grows with their length; broken markup does not matter.
    Repeated pages give equal texts, an empty table an empty result.  Other
    columns stay; those named ``text`` or ``n_chars`` are replaced.
    """
    learned = tuple(fit(pages, html) if weights is None else weights)
    base = pages.drop(*[c for c in ("text", "n_chars") if c != html])
    names = base.columns
    at = names.index(html)
    schema = extended(T.StructType([f for f in base.schema.fields if f.name != html]), ("text", T.StringType()), ("n_chars", T.LongType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = [main_text(h, learned) for h in b.column(at).to_pylist()]
            kept = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*[n for n in names if n != html], "text", "n_chars"])

    return base.mapInArrow(run, schema)
