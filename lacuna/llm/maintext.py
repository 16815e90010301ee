"""Main text of web pages by a minimum cut between content and boilerplate.

Every text block of a page is a node. Its evidence for being content is the sum of two parts: what the names of
the elements around it say, and the log-odds of a logistic classifier over the block's own form (length, share of
links, punctuation, kind, place). The classifier is learned here from pages that name their parts: blocks marked as
article against blocks marked as another part, a sample of bounded size, regularised towards fixed weights that hold
alone where nothing can be learned. Evidence for content is the capacity from the source, evidence against it the
capacity to the sink; neighbouring blocks are joined by edges that grow with their nearness in the tree,
and siblings by a small edge of their own. The minimum cut is the labelling of least cost.

A block whose evidence outweighs all its edges keeps its label in every minimum cut; such blocks are settled first
and become part of the terminals, a maximum flow decides the rest.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import slices
from lacuna.llm.html_blocks import BOILERPLATE, CONTENT, LIKELY, NESTED, NONE, WEAK, TextBlock, blocks_of

#: Pages whose blocks the classifier learns from, and blocks taken from them, at most.
SAMPLE_PAGES = 2000
SAMPLE_BLOCKS = 40_000
#: Evidence of the marks, in log-odds; and of no mark on a page that marks its article, or what may be one.
EVIDENCE = {BOILERPLATE: -9.0, WEAK: -5.0, NONE: 0.0, LIKELY: 3.0, CONTENT: 8.0}
UNMARKED_BESIDE = {CONTENT: -5.0, LIKELY: -2.0}
#: What the block's own form may add or take.
FORM = 3.0
#: Weight of an edge between neighbours, divided by one more than their distance in the tree, and between siblings.
ADJACENT, SIBLING = 1.5, 0.5
_UNIT = 1000
#: Weights before anything is learned, in the order of ``form_of``, and how strongly they hold.
PRIOR = np.array([-1.5, 1.6, -4.0, 0.8, 0.5, -0.8, 1.2, -2.5, 0.0])
HOLD = 4.0
_SENTENCE_ENDS = tuple(".!?…:;。！？\"”»')")
_LEGAL = ("©", "copyright", "all rights reserved", "cookie")


def form_of(block: TextBlock, place: float) -> list[float]:
    """What a block looks like, without what the markup calls it. ``place`` is 0 at the page's start and 1 at its end."""
    text = block.text
    words = text.count(" ") + 1
    low = text[:200].lower()
    return [
        1.0,
        float(np.log1p(words)) / 3,
        block.linked,
        1.0 if text.endswith(_SENTENCE_ENDS) else 0.0,
        min(1.0, 5 * (text.count(",") + text.count(".")) / words),
        1.0 if block.kind == "entry" else 0.0,
        1.0 if block.kind == "heading" else 0.0,
        1.0 if any(x in low for x in _LEGAL) else 0.0,
        abs(2 * place - 1),
    ]


def forms(blocks: list[TextBlock]) -> np.ndarray:
    last = max(1, len(blocks) - 1)
    return np.array([form_of(b, k / last) for k, b in enumerate(blocks)]).reshape(-1, len(PRIOR))


def settled_marks(blocks: list[TextBlock]) -> list[int]:
    """Marks once the page is known: an article inside another part is content only where there is no other article."""
    marks = [b.mark for b in blocks]
    nested = BOILERPLATE if CONTENT in marks else CONTENT
    return [nested if m == NESTED else m for m in marks]


def evidence(blocks: list[TextBlock], weights: np.ndarray) -> np.ndarray:
    marks = settled_marks(blocks)
    beside = UNMARKED_BESIDE[CONTENT] if CONTENT in marks else UNMARKED_BESIDE[LIKELY] if LIKELY in marks else 0.0
    said = np.array([beside if m == NONE else EVIDENCE[m] for m in marks])
    return said + np.clip(forms(blocks) @ weights, -FORM, FORM)


def edges_of(blocks: list[TextBlock]) -> list[tuple[int, int, int]]:
    """(a, b, capacity) of neighbours and of siblings with other blocks between them."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            out.append((k - 1, k, round(_UNIT * ADJACENT / (1 + b.distance))))
        if last.get(b.family, k - 1) < k - 1:
            out.append((last[b.family], k, round(_UNIT * SIBLING)))
        last[b.family] = k
    return out


def minimum_cut(score: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a node against the sign of its score costs the score, an edge between labels its capacity.

    Among labellings of equal cost the one with the fewest true nodes.
    """
    n = len(score)
    score = list(score)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if label[k] is not None:
            continue
        reach = sum(near[k].values())
        if score[k] > reach or score[k] <= -reach:
            label[k] = score[k] > reach
            for other, c in near[k].items():
                del near[other][k]
                score[other] += c if label[k] else -c
                waiting.append(other)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        number = {k: i for i, k in enumerate(rest)}
        inner = [(number[a], number[b], c) for a in rest for b, c in near[a].items() if a < b]
        for k, side in zip(rest, _source_side([score[k] for k in rest], inner), strict=True):
            label[k] = side
    return [bool(x) for x in label]


def _source_side(score: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes that the source still reaches after a maximum flow, by levels of shortest paths and blocking flows."""
    n = len(score)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: int, back: int) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(there)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, s in enumerate(score):
        if s > 0:
            arc(source, k, s, 0)
        elif s < 0:
            arc(k, sink, -s, 0)
    for a, b, c in edges:
        arc(a, b, c, c)

    def levels() -> list[int]:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[sink] >= 0:
        upcoming = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                full = next(i for i, e in enumerate(path) if room[e] == least)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while upcoming[at] < len(arcs[at]):
                e = arcs[at][upcoming[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    break
                upcoming[at] += 1
            if upcoming[at] < len(arcs[at]):
                path.append(arcs[at][upcoming[at]])
                at = to[path[-1]]
            elif path:
                at = to[path.pop() ^ 1]
                upcoming[at] += 1
            else:
                break
    return [x >= 0 for x in level[:n]]


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    scores = np.round(evidence(blocks, weights) * _UNIT).astype(int).tolist()
    kept = minimum_cut(scores, edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, both classes of equal weight, regularised towards ``PRIOR``; without blocks they are ``PRIOR``."""
    w = PRIOR.copy()
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + HOLD * (w - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def learned(pages: DataFrame, html_col: str = "html", most_pages: int = SAMPLE_PAGES, most_blocks: int = SAMPLE_BLOCKS) -> np.ndarray:
    """Weights from the marked blocks of about ``most_pages`` pages, chosen by a hash of the page."""
    page = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null")
    n = page.count()
    if not n:
        return PRIOR
    key = F.pmod(F.xxhash64("html"), F.lit(1 << 40))
    chosen = page.withColumn("h", key).where(F.col("h") <= int((1 << 40) * min(1.0, most_pages / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hs, places, good, found = [], [], [], []
            for h, html in zip(b.column("h").to_pylist(), b.column("html").to_pylist(), strict=True):
                blocks = blocks_of(html)
                marks = settled_marks(blocks)
                for k, (m, x) in enumerate(zip(marks, forms(blocks).tolist(), strict=True)):
                    if m in (CONTENT, BOILERPLATE):
                        hs.append(h)
                        places.append(k)
                        good.append(m == CONTENT)
                        found.append(x)
            columns = [pa.array(hs, pa.int64()), pa.array(places, pa.int32()), pa.array(good, pa.bool_()), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "place", "good", "x"])

    marked = chosen.mapInArrow(run, "h long, place int, good boolean, x array<double>")
    # blocks of every place of a page are as likely; equal pages give equal rows
    table = marked.orderBy(F.xxhash64("h", "place"), "h", "place").limit(most_blocks).toArrow()
    if not len(table):
        return PRIOR
    return fitted(np.array(table["x"].to_pylist(), float), np.array(table["good"].to_pylist(), bool))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the article of every row's page, its blocks in order joined by one line feed.

    Inside a block white space is one blank and character references are decoded; nothing is cut. Null and empty pages,
    and pages without an article, give an empty text. Repeated rows give one row each; ids and urls are given back as they
    are, null or not. An empty table gives an empty result. Other columns are not read.
    """
    weights = learned(pages, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h, weights) for h in b.column("html").to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
