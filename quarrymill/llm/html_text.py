"""HTML extraction: minimum-cut labelling of a page's blocks.

A page is cut into blocks at block-level tags. Each block is a node; what a
linear classifier thinks of it (its containers, hints in class and id, link
density, length) becomes the capacities to the two terminals. Neighbours in page
order are tied by smoothness edges; blocks of one container are tied through a
node of the container, which has no opinion of its own and is tied to that of the
container around it. The minimum cut, by Dinic's algorithm, separates content from
boilerplate; a page's graph has edges in proportion to its blocks.

Scripts, styles, comments, titles and form fields hold no text at all. One whose
end tag is missing takes the rest of the page only if its text is raw (a script,
say); of others only the tag is skipped. Pages carry no labels, so the classifier's
weights are set by hand; ties are of their size, so that a short paragraph of links
between paragraphs of text goes with these, and a lone one at their end doesn't.

Names on html, body, main and article describe the page, not a part of it, and say
nothing; nor does a name such as has-sidebar. A header inside an article is its own.

Defined results: null or empty html gives empty text; repeated rows and null ids
are taken row by row; broken and cut-off markup is read as far as it goes; very long
pages are read whole, one at a time; blocks of equal text are blocks of their own; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by their role.
SKIPPED = "annotation annotation-xml audio button canvas datalist embed iframe input noscript object option script select style svg template textarea title video".split()
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
RAW = "script style textarea title".split()
CLOSED_BY = {"p": set(BLOCKS) - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
PLAIN = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th tr dd dt".split())
BAD_TAGS = "aside dialog fieldset footer form header menu nav".split()
GOOD_TAGS = "article main".split()
BAD_HINTS = "ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
GOOD_HINTS = "article body content entry main post story text".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*(?:"|$)|'[^']*(?:'|$))*"""
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Names that tell what a page has or hasn't, not what an element is.
_ABOUT = re.compile(r"(?:has|have|hide|is|no|show|with|without)[-_]", re.I)
UNNAMED = frozenset("html body main article".split())

#: Costs in natural logarithms: the prior of a block, a container's say, and ties.
PRIOR, BAD, GOOD, HINT, LINKS, LONG = 0.4, 6.0, 2.5, 5.0, 3.0, 2.0
TIE_NEXT, TIE_PATH = 0.8, 0.6


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of a skipped tag ends, by where it starts; those without an end tag are left out."""
    out, stack = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s>/])({_ATTRIBUTES})>", page, re.I):
        if m[1] and stack:
            out[stack.pop()] = m.end()
        elif not m[1] and not m[2].rstrip().endswith("/"):
            stack.append(m.start())
    return out


def blocks(page: str) -> list[tuple[str, tuple, int]]:
    """(text, path, link characters) of each block with text, in page order.

    The path is of (tag, number of the element, hints), outermost first.
    """
    out, parts, linked = [], [], 0
    stack: list[tuple[str, int, frozenset]] = []
    at = number = links = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, tuple(x for x in stack if x[0] in BLOCK_SET), linked))
        parts, linked = [], 0

    end = len(page)
    ends: dict[str, dict[int, int]] = {}
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_SET:
                flush()
            if tag == "a":
                links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in SKIPPED_SET and tag not in VOID:
            if not m[3].rstrip().endswith("/"):
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I).search(page, at)
                    at = close.end() if close else end
                else:
                    if tag not in ends:
                        ends[tag] = _ends(page, tag)
                    at = ends[tag].get(m.start(), at)
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK_SET:
            flush()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
        elif tag == "a":
            links = 1
        if tag in BLOCK_SET and tag != "hr":
            number += 1
            names = [x for h in _HINT.findall(m[3]) for x in "".join(h).lower().split()] if m[3] and tag not in UNNAMED else []
            said = [w for x in names if not _ABOUT.match(x) for w in _SPLIT.split(x)]
            stack.append((tag, number, frozenset(said + ["#hidden"] * bool(m[3] and _HIDDEN.search(m[3])))))
    flush()
    return out


BLOCK_SET, SKIPPED_SET = frozenset(BLOCKS), frozenset(SKIPPED)
_BAD_TAGS, _GOOD_TAGS, _BAD_HINTS, _GOOD_HINTS = map(frozenset, (BAD_TAGS, GOOD_TAGS, BAD_HINTS, GOOD_HINTS))


def cost(text: str, path: tuple, linked: int) -> float:
    """The classifier's log odds that a block is content."""
    tags = [x[0] for x in path]
    inside = any(t in _GOOD_TAGS for t in tags)
    out = PRIOR + GOOD * inside
    own = tags.index("article") if "article" in tags else len(tags)
    out -= BAD * sum(t in _BAD_TAGS and not (t == "header" and k > own) for k, t in enumerate(tags))
    for _, _, hints in path:
        if hints & _BAD_HINTS or "#hidden" in hints:
            out -= HINT + GOOD * inside
        elif hints & _GOOD_HINTS:
            out += 0.5
    out -= LINKS * min(1.0, linked / max(1, len(text)))
    return out + LONG * (min(1.0, math.log1p(len(text)) / 6) - 0.5)


def min_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, by blocking flows over shortest paths."""
    n = len(scores)
    s, t = n, n + 1
    # Edge e leads to ends[e] with room[e] left; e ^ 1 is its reverse.
    ends: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            out[x].append(len(ends))
            ends.append(y)
            room.append(c)

    for i, x in enumerate(scores):
        edge(*((s, i) if x > 0 else (i, t)), abs(x), 0.0)
    for i, j, c in ties:
        edge(i, j, c, c)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and ends[e] not in level:
                    level[ends[e]] = level[u] + 1
                    queue.append(ends[e])
        if t not in level:
            return [i in level for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                # Go on from the first edge that is full.
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = ends[path[k] ^ 1]
                del path[k:]
            edges = out[u]
            while at[u] < len(edges) and not (room[edges[at[u]]] > 1e-9 and level.get(ends[edges[at[u]]]) == level[u] + 1):
                at[u] += 1
            if at[u] < len(edges):
                path.append(edges[at[u]])
                u = ends[path[-1]]
            elif path:
                u = ends[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def extract(page: str | None) -> str:
    """The main text of a page: its content blocks, joined by two line ends."""
    found = blocks(page or "")
    scores = [cost(*block) for block in found]
    nodes: dict[tuple, int] = {}
    ties, keys = [], []
    for i, (_, path, _) in enumerate(found):
        # The container of plain blocks: the path without trailing paragraphs and list items.
        k = len(path)
        while k and path[k - 1][0] in PLAIN and not path[k - 1][2]:
            k -= 1
        key = tuple(x[1] for x in path[:k])
        if key not in nodes:
            nodes[key] = len(scores)
            scores.append(0.0)
        ties.append((i, nodes[key], TIE_PATH))
        if keys:
            # Neighbours are tied the less, the farther apart their containers are.
            last = keys[-1]
            common = next((n for n, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
            ties.append((i - 1, i, TIE_NEXT / (1 + len(last) + len(key) - 2 * common)))
        keys.append(key)
    for key, i in nodes.items():
        parent = next((nodes[key[:k]] for k in range(len(key) - 1, 0, -1) if key[:k] in nodes), None)
        if parent is not None:
            ties.append((i, parent, TIE_PATH))
    keep = min_cut(scores, ties)
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=False) if k)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema({"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()})
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            texts = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
