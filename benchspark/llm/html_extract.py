"""Main text of web pages by minimum cut: classifier costs are terminal capacities, adjacency and DOM proximity are smoothness
edges, and a maximum flow separates content from boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, hash_sample, strings, table

#: Pages that the block classifier is fitted on.
TRAIN_PAGES = 2000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# HTML element names and the usual class words of page parts.
RAW = frozenset("script style noscript template title iframe textarea".split())
HIDDEN = frozenset("head svg select object canvas math button datalist".split())
BLOCKS = frozenset("html body article main section div nav header footer aside p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary dialog center".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
STOPS_CLOSING = frozenset("ul ol dl table div section article main aside nav header footer form body".split())
CONTENT_TAGS, OTHER_TAGS = frozenset(["article", "main"]), frozenset(["nav", "header", "footer", "aside", "form", "dialog", "address"])
CONTENT_WORDS = frozenset("article content post entry story main maincontent articlebody body-text".split())
TURNS = frozenset("with without has no".split())
#: Borders that a hidden element with an end tag does not cross.
BORDERS = frozenset("body article main section nav header footer aside form".split())
OTHER_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo menu nav navbar navigation header footer sidebar aside widget related share social breadcrumb breadcrumbs cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login comment comments reply replies disqus copyright complementary contentinfo alert".split())

#: Log-odds of a part that names itself, and the most that the classifier may add.
NAMED, LEARNED = 4.0, 3.0
#: Smoothness between neighbouring blocks of one part, of two parts, and of one parent element.
SAME_PART, OTHER_PART, SAME_PARENT = 1.0, 0.15, 0.6

_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Block:
    __slots__ = ("text", "tag", "parent", "part", "named", "linked")

    def __init__(self, text, tag, parent, part, named, linked):
        self.text, self.tag, self.parent, self.part, self.named, self.linked = text, tag, parent, part, named, linked


def _named(tag: str, attributes: str) -> int:
    """1: names itself content, -1: names itself something else, 0: neither.

    Whole class values come first, then their parts: the last part that says something decides, what follows "with" or "no"
    says nothing, and a content word after another one leaves it open.
    """
    if tag in OTHER_TAGS:
        return -1
    values = [v.lower() for m in ATTRIBUTE.finditer(attributes) for v in m.group(1).strip("\"'").split()] if "=" in attributes else []
    found = {-1 if v in OTHER_WORDS else 1 for v in values if v in OTHER_WORDS or v in CONTENT_WORDS}
    if not found:
        for v in values:
            parts = [w for w in re.split(r"[^a-z]+", v) if w]
            parts = parts[: next((i for i, w in enumerate(parts) if w in TURNS), len(parts))]
            said = [-1 if w in OTHER_WORDS else 1 for w in parts if w in OTHER_WORDS or w in CONTENT_WORDS]
            if said:
                found.add(0 if said[-1] == 1 and -1 in said else said[-1])
    if -1 in found:
        return -1
    return 1 if tag in CONTENT_TAGS or 1 in found else 0


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of what is no text; the tag is empty for comments and for raw and hidden elements.

    A raw element without an end tag reaches to the page's end. A hidden one that closes itself, or has no end tag before a
    border of the page's parts, hides nothing.
    """
    out: list[tuple[int, int, str, bool, str]] = []
    open_: dict[str, list[int]] = {}
    hides: dict[int, int] = {}
    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        closing = "/" in (m.group(1) or m.group(4) or "")
        if tag in RAW and not closing:  # its text is no markup: go on at its end tag
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            tag = ""
        elif tag in HIDDEN and not closing and not m.group(0).endswith("/>"):
            open_.setdefault(tag, []).append(len(out))
        elif tag in HIDDEN and closing and tag in open_:
            hides[open_[tag].pop()] = len(out)
            if not open_[tag]:
                del open_[tag]
        elif tag in BLOCKS:
            if "head" in open_:  # its end tag may be left out
                hides[open_.pop("head")[0]] = len(out) - 1
            if tag in BORDERS:
                open_.clear()
        out.append((m.start(), at, tag, closing, m.group(3) or m.group(6) or ""))
    seen: list[tuple[int, int, str, bool, str]] = []
    i = 0
    while i < len(out):
        start, end, tag, closing, attributes = out[i]
        if i in hides:
            i = max(i, hides[i])
            # what is left out of a head without an end tag ends where the next part begins
            end, tag = (out[i][1] if out[i][2] == tag and out[i][3] else out[i + 1][0]), ""
        seen.append((start, end, "" if tag in HIDDEN else tag, closing, attributes))
        i += 1
    return seen


def blocks(page: str) -> list[Block]:
    """The visible runs of text between borders of block elements, in page order."""
    out: list[Block] = []
    # (tag, element number, part number, named)
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    text: list[str] = []
    linked = depth_a = number = 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                tag, parent, part, named = stack[-1]
                out.append(Block(joined, tag, stack[-2][1] if len(stack) > 1 else 0, part, named, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    at = 0
    for start, end, tag, closing, attributes in _tokens(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if depth_a:
                linked += len(piece)
        at = end
        if tag == "a":
            depth_a = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        for i in range(len(stack) - 1, 0, -1):  # implied end tags
            if tag in CLOSED_BY.get(stack[i][0], ()):
                del stack[i:]
            elif stack[i][0] in STOPS_CLOSING:
                break
        number += 1
        own = _named(tag, attributes)
        _, _, part, named = stack[-1]
        if own:
            # what names itself something else stays so, unless an article lies inside it
            part, named = number, own if named >= 0 or tag in CONTENT_TAGS else named
        stack.append((tag, number, part, named))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def features(b: Block) -> list[str]:
    size = len(b.text)
    kind = "h" if b.tag[:1] == "h" and b.tag[1:].isdigit() else b.tag if b.tag in ("p", "li", "td") else ""
    return ([f"tag-{kind}"] if kind else []) + [f"size{min(9, int(math.log2(size + 1)))}", f"link{int(b.linked * 3.999)}", f"end-{b.text[-1] in '.!?\"”»'}", f"comma{min(3, b.text.count(','))}"]


def _max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (Dinic's algorithm)."""
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def arc(a, b, c, back):
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i] > 0:
            arc(s, i, source[i], 0.0)
        if sink[i] > 0:
            arc(i, t, sink[i], 0.0)
    for a, b, c in edges:
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                keep = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(out[a]):
                path.append(out[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1
            else:
                break


def content(page: str, odds: dict[str, float]) -> str:
    """The blocks on the content side of the page's minimum cut, one a line."""
    found = blocks(page)
    if not found:
        return ""
    score = []
    for b in found:
        learned = sum(odds.get(f, 0.0) for f in features(b)) + odds.get("", 0.0)
        score.append(NAMED * b.named + max(-LEARNED, min(LEARNED, learned)))
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SAME_PART if b.part == found[i - 1].part else OTHER_PART))
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    side = _max_flow_side(len(found), [max(0.0, x) for x in score], [max(0.0, -x) for x in score], edges)
    return "\n".join(b.text for b, keep in zip(found, side) if keep)


def fit_blocks(pages: DataFrame, html_column: str = "html", train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Naive Bayes log-odds of block features, from the blocks of about ``train_pages`` pages (a documented bound, chosen by a
    hash of the page) whose part names itself. Only counts by feature reach the driver; their number is fixed."""
    named = pages.filter(F.col(html_column).isNotNull()).select(F.col(html_column).alias("h"))
    chosen = hash_sample(named, train_pages, "h", named.count())

    def count(batches):
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            for page in batch.column("h").to_pylist():
                for b in blocks(page):
                    if b.named:
                        for f in ["", *features(b)]:
                            seen[f, b.named] = seen.get((f, b.named), 0) + 1
        yield pa.RecordBatch.from_pydict({"f": pa.array([k[0] for k in seen], pa.string()), "y": pa.array([k[1] for k in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    n = {(r["f"], r["y"]): r["n"] for r in chosen.mapInArrow(count, "f string, y int, n long").groupBy("f", "y").agg(F.sum("n").alias("n")).collect()}
    yes, no = n.get(("", 1), 0), n.get(("", -1), 0)
    odds = {f: math.log((n.get((f, 1), 0) + 1) / (yes + 2)) - math.log((n.get((f, -1), 0) + 1) / (no + 2)) for f, _ in n if f}
    return odds | {"": math.log((yes + 1) / (no + 1))}


def extract_text(pages: DataFrame, odds: dict[str, float], html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``main_text``.

    Defined results: NULL or empty html, and pages of boilerplate only, give the empty text; tags cut off by the page's end are
    dropped; equal pages give equal texts; other columns are carried on, one of the name ``main_text`` is replaced.
    """

    def extract(column):
        return (pa.array([content(p, odds) for p in strings(column)], pa.string()),)

    return append_arrow(pages, [html_column], {"main_text": "string"}, extract, keep)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    texts = extract_text(pages, fit_blocks(pages), keep=["page_id", "url"])
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
