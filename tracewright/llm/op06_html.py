"""Main text of web pages by a minimum cut: classifier costs against smoothness between near blocks."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>[^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>|</?[A-Za-z][^>]*>",
    re.S,
)
_UNFINISHED = re.compile(r"<(?=[A-Za-z!?]|/[A-Za-z])")
_ATTR = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video select button".split())
#: Those of them that swallow the rest of the page if they aren't closed, as in browsers.
_SWALLOWS = frozenset("script style iframe textarea title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "cookie cookies consent notice notification alert popup modal overlay comment comments disqus respond reply share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login search pagination pager toolbar widget copyright legal disclaimer complementary contentinfo".split()
)
_MAIN_NAMES = frozenset("article content post entry story main".split())

_ASIDE_NAMES = frozenset("comment comments reply ad ads advert promo sponsored related".split())

#: Costs of the classifier, as log odds of content. Of a block, by its text:
BIAS, PER_CHAR, MOST_FOR_CHARS, PER_MARK, MOST_FOR_MARKS, LINKS = -0.9, 1 / 150, 1.4, 0.15, 0.5, -4.5
TAGS = {"p": 0.3, "h1": 0.8, "h2": 0.4, "h3": 0.4, "blockquote": 0.4, "pre": 0.6, "li": 0.2, "td": 0.2}
#: By the nearest element that tells what it holds, in the range of what a block's neighbours weigh; "" is the page itself beside a main part.
ELEMENTS = {"main": 0.5, "main name": 0.5, "noise": -2.2, "noise name": -1.9, "": -1.3}
#: Smoothness of neighbours by the steps between their elements in the tree (the last holds for more); of the blocks before with the same parent and
#: in the same telling element, where these aren't neighbours; and what is left of it between two telling elements.
BY_STEPS, SIBLINGS, SECTION, ACROSS = (1.2, 1.2, 1.2, 0.8, 0.5, 0.2), 0.7, 0.8, 0.05


@dataclass
class Block:
    text: str
    tag: str
    element: int
    parent: int
    teller: int
    linked: int


@dataclass
class Teller:
    """An element that tells by its tag or name what it holds; ``within`` is the next one around it."""

    kind: str
    within: int
    doubtful: bool = False


@dataclass
class Page:
    blocks: list[Block]
    tellers: list[Teller]
    above: list[int]  # of each element the one around it
    depth: list[int]

    def steps(self, a: int, b: int) -> int:
        """Steps in the tree from one element to another, as far as they differ in smoothness."""
        n = 0
        while a != b and n < len(BY_STEPS) - 1:
            if self.depth[a] >= self.depth[b]:
                a = self.above[a]
            else:
                b = self.above[b]
            n += 1
        return n


def _names(attrs: str) -> set[str]:
    """Parts of class names, ids and roles; what an element has or lacks isn't what it is."""
    found = set()
    for m in _ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = _NAME_PARTS.findall(_CAMEL.sub("-", name).lower())
            if parts and parts[0] not in ("has", "with", "without", "no"):
                found.update(parts)
    return found


def blocks_of(page: str) -> Page:
    """The page's text blocks in order, and the elements that tell of them. Any input is read; wrong nesting is repaired as browsers do."""
    out: list[Block] = []
    tellers, above, depth = [Teller("", -1)], [0], [0]
    stack: list[tuple[str, int, int, str, bool]] = [("", 0, 0, "", False)]  # tag, number, teller, noise around, main around
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked, in_link, number = 0, 0, 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked, text
        if text:
            body = " ".join("".join(text).split())
            if body:
                tag, me, teller, _, _ = stack[-1]
                near = stack[-2][1] if tag in TAGS and len(stack) > 1 else me
                out.append(Block(body, tag, me, near, teller, min(linked, len(body))))
        text, linked = [], 0

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            open_tags[stack.pop()[0]] -= 1
        open_tags[stack.pop()[0]] -= 1

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    at, last = 0, page.rfind(">") + 1  # nothing after the last > can be a tag
    while at < last:
        m = _TOKEN.search(page, at)
        if not m:
            break
        add(page[at : m.start()])
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag not in _INLINE and open_tags[tag]:
                flush()
                close(tag)
            continue
        if tag in _RAW:
            if not m["attrs"].endswith("/") or tag in _SWALLOWS:
                gone = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if gone:
                    at = gone.end()
                elif tag in _SWALLOWS:
                    at = len(page)
                else:  # browsers read on
                    unclosed.add(tag)
            if tag not in ("script", "style"):
                add(" ")
            continue
        if tag == "a":
            in_link += 1
            continue
        if tag in _INLINE:
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        flush()
        if tag in _ENDS_P and open_tags["p"]:
            close("p")
        if tag in _CLOSES and stack[-1][0] in _CLOSES[tag]:
            close(stack[-1][0])
            if tag == "tr" and stack[-1][0] == "tr":
                close("tr")
        _, _, teller, noise, main = stack[-1]
        names = _names(m["attrs"]) if m["attrs"].strip() else set()
        kind = ""
        if tag in ("article", "main"):
            kind = "noise name" if tag == "article" and names & _ASIDE_NAMES else "main" if noise != "noise" else ""
        elif tag not in ("html", "body"):
            if tag in _NOISE_TAGS or (tag == "header" and not main):
                kind = "noise"
            elif names & _NOISE_NAMES:
                kind = "noise name"
            elif names & _MAIN_NAMES and not noise:
                kind = "main name"
        if kind:
            tellers.append(Teller(kind, teller, kind == "main" and bool(noise)))
            teller = len(tellers) - 1
            noise, main = (kind, main) if kind.startswith("noise") and noise != "noise" else (noise, True) if kind.startswith("main") else (noise, main)
        above.append(stack[-1][1])
        depth.append(depth[stack[-1][1]] + 1)
        number += 1
        stack.append((tag, number, teller, noise, main))
        open_tags[tag] += 1
        in_link = 0
    add(_UNFINISHED.split(page[at:], maxsplit=1)[0])
    flush()
    return Page(out, tellers, above, depth)


def _score(b: Block) -> float:
    size = len(b.text)
    marks = sum(b.text.count(c) for c in ".,;:!?")
    score = BIAS + min(size * PER_CHAR, MOST_FOR_CHARS) + min(marks * PER_MARK, MOST_FOR_MARKS) + TAGS.get(b.tag, 0.0)
    return score + LINKS * b.linked / size


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut.

    A node's positive score is its capacity from the source, a negative one its
    capacity to the sink. A node whose score outweighs all its edges has its
    side in every minimum cut; such nodes go first, their edges becoming
    terminal capacities of their neighbours. Augmenting paths do the rest.
    """
    near: list[dict[int, float]] = [{} for _ in scores]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    scores, side = list(scores), [None] * len(scores)
    todo = deque(range(len(scores)))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(scores[i]) >= sum(near[i].values()):
            side[i] = scores[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                scores[j] += w if side[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        for i in _reached(rest, scores, near):
            side[i] = True
    return [bool(s) for s in side]


def _reached(nodes: list[int], scores: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes still reached from the source once no augmenting path is left: blocking flows by distance (Dinic)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if scores[i]:
            a, b = (source, i) if scores[i] > 0 else (i, sink)
            room[a][b] = abs(scores[i])
            room[b].setdefault(a, 0.0)
    while True:
        far, todo = {source: 0}, deque([source])
        while todo:
            i = todo.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and j not in far:
                    far[j] = far[i] + 1
                    todo.append(j)
        if sink not in far:
            return set(far) - {source}
        left = {i: iter(room[i]) for i in far}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in pairwise(path))
                for a, b in pairwise(path):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                # On from the first edge that is full now; its start tries the edge once more and finds it so.
                cut = next(k for k, (a, b) in enumerate(pairwise(path)) if room[a][b] <= 1e-9)
                path = path[: cut + 1]
                continue
            step = next((j for j in left[i] if far.get(j) == far[i] + 1 and room[i][j] > 1e-9), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def costs_of(page: Page) -> list[float]:
    """Each block's own cost: by its text, and by the nearest element that tells what it holds.

    An article within an element of a noisy name is the main part only if the
    page has no other.
    """
    tellers = page.tellers
    sure = {i for i, t in enumerate(tellers) if t.kind.startswith("main") and not t.doubtful}
    under = [i in sure for i in range(len(tellers))]
    for i in range(1, len(tellers)):
        under[i] = under[i] or under[tellers[i].within]
    has_main = any(under[b.teller] for b in page.blocks)
    kinds = ["" if t.doubtful and has_main else t.kind for t in tellers]
    own = [0] * len(tellers)
    for i in range(1, len(tellers)):
        own[i] = i if kinds[i] else own[tellers[i].within]
    return [_score(b) + (ELEMENTS[kinds[own[b.teller]]] if kinds[own[b.teller]] or has_main else 0.0) for b in page.blocks]


def smoothness(page: Page) -> dict[tuple[int, int], float]:
    """Edges between blocks that stand near each other, in the text and in the tree."""
    edges: dict[tuple[int, int], float] = {}
    last_child: dict[int, int] = {}
    last_told: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if i:
            before = page.blocks[i - 1]
            edges[i - 1, i] = BY_STEPS[page.steps(before.element, b.element)] * (1.0 if before.teller == b.teller else ACROSS)
        for last, at, weight in ((last_child, b.parent, SIBLINGS), (last_told, b.teller, SECTION)):
            j = last.get(at)
            if j is not None and j < i - 1:
                edges[j, i] = edges.get((j, i), 0.0) + weight * (1.0 if page.blocks[j].teller == b.teller else ACROSS)
            last[at] = i
    return edges


def labelled(page: Page) -> tuple[list[float], list[bool]]:
    """Each block's own cost and its label by the minimum cut of costs against smoothness."""
    costs = costs_of(page)
    return costs, minimum_cut(costs, smoothness(page))


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by blank lines."""
    read = blocks_of(page or "")
    _, kept = labelled(read)
    return "\n\n".join(b.text for b, k in zip(read.blocks, kept, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every page; text is empty if a page has no content.

    Blocks have costs by their text and by the tag or name of the nearest
    element that tells what it holds; a minimum cut of these against the
    smoothness of near blocks labels them, and a block that it leaves undecided
    is no content. No word and no element decides alone: what it weighs is in
    the range of what a block's neighbours weigh. Null pages count as empty,
    null ids and urls stay null, repeated rows give repeated rows, an empty
    table none. Nothing is cut off, whatever its length or number of blocks;
    only the named columns are read, so others may have any name.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    return rows.mapInPandas(read, "page_id long, url string, text string, n_chars long")


def op6_minimum_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
