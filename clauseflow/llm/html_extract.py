"""HTML extraction by minimum cut.

1. A page is scanned once into text blocks: what stands between tags that break lines. Scripts, styles, comments and the head's
   other parts don't count; a head ends at the first text or tag that it can't have. A block has its text, its links' share, its path of tags.
2. A logistic classifier gives each block a probability of being content, from its words, links, punctuation, place and neighbours.  It is
   trained here on a bounded sample of pages, whose landmark tags (article and main against nav, footer, aside, header and
   advertisement classes) label blocks at a distance; the tags are no features. Without such pages fixed weights serve.
3. The two log costs of each block are the capacities of its edges to the terminals; edges between blocks that follow each other, and between
   those whose paths part late, are smoothness: cutting them costs more the closer the blocks are. The minimum cut separates
   content from boilerplate.  A block whose own cost outweighs all its edges is settled beforehand, which is exact and leaves
   little for the maximum flow (Dinic's, without recursion).

One pass over the pages, without a shuffle.

Defined results: a null, empty or tagless page has no block or one; pages without content have an empty text; broken markup is read as far as it goes (an
unclosed tag ends with the page, an unclosed script or style hides the rest, nothing else does); repeated rows and null ids are carried; pages of any
length are read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, pieces

SAMPLE, FOLLOWING, PROXIMITY, NEAR = 2000, 0.6, 0.8, 8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTES = r"(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
#: What a head may have, from its start tag on; anything else ends it, whether or not its closing tag is there.
_HEAD = re.compile(
    r"(?:\s++|<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(noscript|template)\b[^>]*>.*?</\2\s*>"
    r"|<title\b[^>]*>(?:(?:(?!</?(?:head|body|title)\b).)*+</title\s*>|[^<]*)|</?(?:meta|link|base|basefont|bgsound)\b" + _ATTRIBUTES + r")*+(?:</head\s*>)?",
    re.S | re.I,
)
_HIDDEN = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("noscript", "template", "svg")}  # up to their closing tags, if they have any
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GOOD, _POOR = frozenset(["article", "main"]), frozenset(["nav", "footer", "aside", "header", "menu", "form"])
_ADS = re.compile(r"(?i)(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|sidebar|breadcrumbs?|navigation|menu|share|social)\b")
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]  # numbers of the elements around it, outermost first
    linked: int  # characters within links
    landmark: int  # 1 within content, 0 within boilerplate, -1 unknown
    words: int = field(default=0)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, number, landmark
    parts: list[str] = []
    linked, in_link, serial, at = 0, 0, 0, 0
    unclosed: set[str] = set()

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if in_link:
                linked += len(piece)

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if not text.isspace():
                text = _SPACES.sub(" ", entities.unescape(text) if "&" in text else text).strip()
                if text:
                    out.append(Block(text, stack[-1][0] if stack else "", tuple(n for _, n, _ in stack), min(linked, len(text)), stack[-1][2] if stack else -1, len(_WORDS.findall(text))))
            parts.clear()
        linked = 0

    while m := _TAG.search(page, at):
        text_to(m.start())
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(m.group(2))
        if tag == "head" and not closing:
            at = _HEAD.match(page, at).end()
            continue
        if tag in _HIDDEN and not closing:
            if tag not in unclosed and not (tag == "svg" and m.group(4).endswith("/")):
                if end := _HIDDEN[tag].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in _INLINE:
            continue
        close_block()
        if tag in _VOID:
            continue
        if closing:
            in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            serial += 1
            mark = stack[-1][2] if stack else -1
            if tag in _GOOD:
                mark = 1
            elif tag in _POOR or (m.group(4) and _ADS.search(m.group(4))):
                mark = 0
            stack.append((tag, serial, mark))
    text_to(len(page))
    close_block()
    return out


FEATURES = 14
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, FEATURES))
    if not n:
        return x
    words = np.array([b.words for b in blocks], np.float64)
    size = np.array([len(b.text) for b in blocks], np.float64)
    links = np.array([b.linked for b in blocks], np.float64) / size
    lw = np.log1p(words)
    x[:, 0] = lw
    x[:, 1] = np.minimum(links, 1)
    x[:, 2] = np.log1p([b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?") for b in blocks])
    x[:, 3] = [b.text[-1] in ".!?:\"”" for b in blocks]
    x[:, 4] = [b.tag == "p" for b in blocks]
    x[:, 5] = [b.tag in _HEADINGS for b in blocks]
    x[:, 6] = [b.tag in ("li", "td", "dd", "option") for b in blocks]
    x[:, 7] = [b.tag == "div" for b in blocks]
    x[1:, 8], x[:-1, 9] = lw[:-1], lw[1:]
    x[1:, 10], x[:-1, 11] = links[:-1], links[1:]
    place = (np.arange(n) + 0.5) / n
    x[:, 12] = 4 * place * (1 - place)
    x[:, 13] = ["©" in b.text or "·" in b.text or "|" in b.text for b in blocks]
    return x


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -6, 6)


#: For corpora without landmark tags: long, punctuated, unlinked blocks in paragraphs are content.
PRIOR = Classifier(np.zeros(FEATURES), np.ones(FEATURES), np.array([0.8, -4, 0.5, 0.8, 0.8, 0.5, -0.8, -0.2, 0.1, 0.1, -0.8, -0.8, 0.3, -1.5]), -2.5)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 12) -> Classifier | None:
    """Newton's method on the log loss, both classes weighing the same."""
    if len(y) < 20 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    cost = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (cost * (p - y)) + ridge * w
        h = (z * (cost * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, and up to NEAR blocks on, those that share an element beyond the neighbours' own."""
    out = []
    for i in range(len(blocks) - 1):
        a = blocks[i].path
        for j in range(i + 1, min(len(blocks), i + 1 + NEAR)):
            b = blocks[j].path
            common = 0
            for u, v in zip(a, b):
                if u != v:
                    break
                common += 1
            apart = len(a) + len(b) - 2 * common
            w = PROXIMITY * 0.5 ** max(0, apart - 2) / (j - i) if apart <= 4 else 0.0
            if j == i + 1:
                w += FOLLOWING / (1 + apart / 2)
            if w > 0.01:
                out.append((i, j, w))
    return out


class Flow:
    """Maximum flow by Dinic's algorithm; the capacities of an edge may be given for both ways."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, forth: float, back: float) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forth)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def run(self, s: int, t: int) -> list[bool]:
        """Which nodes stay on the side of s."""
        to, cap, out = self.to, self.cap, self.out
        while True:
            level = [-1] * len(out)
            level[s] = 0
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in out[u]:
                    if cap[e] > 1e-12 and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if level[t] < 0:
                return [k >= 0 for k in level]
            turn = [0] * len(out)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    least = min(cap[e] for e in path)
                    cut = 0
                    for k, e in enumerate(path):
                        cap[e] -= least
                        cap[e ^ 1] += least
                        if cap[e] <= 1e-12 and not cut:
                            cut = k + 1
                    u = to[path[cut - 1] ^ 1]
                    del path[cut - 1 :]
                while turn[u] < len(out[u]):
                    e = out[u][turn[u]]
                    if cap[e] > 1e-12 and level[to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(out[u]):
                    path.append(out[u][turn[u]])
                    u = to[path[-1]]
                elif u == s:
                    break
                else:
                    level[u] = -2
                    u = to[path.pop() ^ 1]


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels that minimise the sum of lost gains (a positive gain is lost by label 0, a negative one by label 1) and cut edges."""
    n = len(gain)
    label = np.full(n, -1)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    own = gain.astype(float).tolist()
    tied = [sum(w for _, w in x) for x in near]
    # a block whose own cost outweighs its open edges takes the label it prefers in some minimum
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] < 0 and abs(own[i]) >= tied[i] and (own[i] or not tied[i]):
            label[i] = int(own[i] > 0)
            for j, w in near[i]:
                if label[j] < 0:
                    own[j] += w if label[i] else -w
                    tied[j] -= w
                    queue.append(j)
    open_ = [i for i in range(n) if label[i] < 0]
    if open_:
        at = {i: k + 2 for k, i in enumerate(open_)}
        flow = Flow(len(open_) + 2)
        for i in open_:
            if own[i] > 0:
                flow.add(0, at[i], own[i], 0.0)
            elif own[i] < 0:
                flow.add(at[i], 1, -own[i], 0.0)
            for j, w in near[i]:
                if i < j and j in at:
                    flow.add(at[i], at[j], w, w)
        side = flow.run(0, 1)
        for i in open_:
            label[i] = int(side[at[i]])
    return label


def extract(page: str | None, model: Classifier) -> tuple[int, int, str]:
    """(blocks, blocks of content, text of content)."""
    blocks = blocks_of(page or "")
    if not blocks:
        return 0, 0, ""
    label = minimum_cut(model.logit(features(blocks)), edges_of(blocks))
    kept = [b.text for b, k in zip(blocks, label.tolist()) if k]
    return len(blocks), len(kept), "\n".join(kept)


def train(pages: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits on the blocks of at most `sample` pages, the first in order of the hash of their ids, whose landmarks say what they are."""
    chosen = narrowed(pages, page_id="long", html="string").where("html is not null")
    ids = chosen.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html", 4 << 20):
            for page_id, page in zip(piece.column("page_id").to_pylist(), piece.column("html").to_pylist()):
                blocks = blocks_of(page)
                x, y = features(blocks), np.array([b.landmark for b in blocks])
                if len(x) and (y >= 0).any():
                    yield pa.record_batch({"page_id": pa.array([page_id], pa.int64()), "x": pa.array([x[y >= 0].tobytes()], pa.binary()), "y": pa.array([y[y >= 0].astype(np.int8).tobytes()], pa.binary())})

    rows = chosen.join(F.broadcast(ids), "page_id").select("page_id", "html").mapInArrow(labelled, "page_id long, x binary, y binary").collect()
    if not rows:
        return PRIOR
    rows.sort(key=lambda r: (r.page_id, bytes(r.x)))
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, FEATURES) for r in rows])
    return fit(x, np.concatenate([np.frombuffer(r.y, np.int8) for r in rows]).astype(float)) or PRIOR


def extract_content(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, n_blocks, n_content, text) for every row of pages."""
    model = train(pages, sample)
    pages = narrowed(pages, page_id="long", html="string")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html", 4 << 20):
            out = [extract(page, model) for page in piece.column("html").to_pylist()]
            yield pa.record_batch(
                {"page_id": piece.column("page_id"), "n_blocks": pa.array([a for a, _, _ in out], pa.int32()), "n_content": pa.array([b for _, b, _ in out], pa.int32()), "text": pa.array([t for _, _, t in out], pa.string())}
            )

    return pages.mapInArrow(extracted, "page_id long, n_blocks int, n_content int, text string")
