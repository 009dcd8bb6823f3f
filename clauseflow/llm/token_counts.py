"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each of its nodes has a failure link, to the node for what is left of its string once the longest-match
pieces that must come off its front have come off, and the number of those pieces.  Reading a word takes one step a
byte; a failure adds its popped count and goes on at its link, and at the word's end a precomputed count drains the node.  That gives
the number of greedy longest-match pieces in time linear in the text, without building or comparing a piece.

All words of a batch go through the automaton side by side, a byte at a time, in numpy; a very long word goes through it by itself.

A word is a run of letters, digits and underscores, or a run of other signs, with the space before it where there is one; any
other white space has no tokens.  A word that the vocabulary can't spell counts as one token.

Defined results: a null, empty or blank text has 0 words and 0 tokens; repeated rows and null ids are counted and carried;
a text of any length is read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytescan as bs
from .common import narrowed, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE, LONG_WORD = 4 << 20, 96


def load_vocabulary(path: str) -> list[bytes]:
    """Pieces of a .tiktoken file (base64 and rank on each line) or of a sentencepiece .model, whose word marks become spaces."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        out = []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                out.append(bytes([int(re.fullmatch(r"<0x(..)>", piece)[1], 16)]))
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                out.append(piece.replace("▁", " ").encode())
        return out
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """Node 0 is the root; a node's children follow each other in the order of their bytes."""

    parent: np.ndarray
    byte: np.ndarray
    link: np.ndarray  # failure link, -1: none
    popped: np.ndarray  # pieces that come off on failure
    drain: np.ndarray  # pieces left at a word's end, -1: can't be spelled

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each node in the table, or that of no children; child by row and byte, or -1)."""
        inner = np.unique(self.parent[1:])
        row = np.zeros(len(self.parent), np.int32)
        row[inner] = np.arange(1, len(inner) + 1)
        child = np.full((len(inner) + 1, 256), -1, np.int32)
        child[row[self.parent[1:]], self.byte[1:]] = np.arange(1, len(self.parent))
        return row, child


def build(vocabulary: Iterable[bytes]) -> Automaton:
    children: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    for piece in vocabulary:
        u = 0
        for c in piece:
            v = children[u].get(c)
            if v is None:
                v = children[u][c] = len(children)
                children.append({})
                final.append(False)
            u = v
        if u:
            final[u] = True
    # breadth first, so that a link always leads to a node that is done
    n = len(children)
    parent, byte, link, popped, drain = (np.zeros(n, np.int32) for _ in range(5))
    link[0], new, order, depth_first = -1, [0] * n, [0], 0
    for u in order:
        for c, v in sorted(children[u].items()):
            depth_first += 1
            new[v] = depth_first
            parent[depth_first], byte[depth_first] = new[u], c
            order.append(v)
    old = order  # old[k]: node k's number before
    links, pops, drains = [-1] * n, [0] * n, [0] * n
    for k in range(1, n):
        v, u, c = old[k], int(parent[k]), int(byte[k])
        if final[v]:
            links[k], pops[k] = 0, 1
        else:
            z, count = links[u], pops[u]
            while z >= 0 and c not in children[old[z]]:
                count += pops[z]
                z = links[z]
            if z >= 0:
                links[k], pops[k] = new[children[old[z]][c]], count
        if links[k] < 0:
            links[k], drains[k] = -1, -1
        else:
            rest = drains[links[k]]
            drains[k] = -1 if rest < 0 else pops[k] + rest
    link[:], popped[:], drain[:] = links, pops, drains
    return Automaton(parent, byte, link, popped, drain)


class Counter:
    def __init__(self, a: Automaton):
        self.a = a
        self.row, self.child = a.table()

    def one(self, word: bytes) -> int:
        a, u, count = self.a, 0, 0
        row, child, link, popped = self.row, self.child, a.link, a.popped
        for c in word:
            v = child[row[u], c]
            while v < 0:
                if link[u] < 0:
                    return 1
                count += popped[u]
                u = link[u]
                v = child[row[u], c]
            u = v
        return 1 if a.drain[u] < 0 else int(count + a.drain[u])

    def many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each span of data."""
        out = np.zeros(len(start), np.int64)
        length = end - start
        for k in np.flatnonzero(length > LONG_WORD):
            out[k] = self.one(data[start[k] : end[k]].tobytes())
        short = np.flatnonzero(length <= LONG_WORD)
        who = short[np.argsort(-length[short].astype(np.int8), kind="stable")]  # longest first: those still open lead
        at, todo = start[who], length[who]
        node, count = np.zeros(len(who), np.int32), np.zeros(len(who), np.int32)
        bad = np.zeros(len(who), bool)
        a, row, child = self.a, self.row, self.child
        ends = np.searchsorted(-todo, -np.arange(0, LONG_WORD + 1), "left")  # ends[k]: words longer than k
        for k in range(LONG_WORD):
            n = int(ends[k])
            if not n:
                break
            c = data[at[:n] + k]
            u = node[:n]
            v = child[row[u], c]
            stuck = np.flatnonzero(v < 0)
            while len(stuck):
                w = u[stuck]
                nowhere = a.link[w] < 0
                if nowhere.any():
                    bad[stuck[nowhere]] = True
                    v[stuck[nowhere]] = 0
                    stuck, w = stuck[~nowhere], w[~nowhere]
                count[stuck] += a.popped[w]
                w = a.link[w]
                u[stuck] = w
                t = child[row[w], c[stuck]]
                v[stuck] = t
                stuck = stuck[t < 0]
            node[:n] = v
        rest = a.drain[node]
        out[who] = np.where(bad | (rest < 0), 1, count + rest)
        return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, words of each row)."""
    data, offsets = bs.buffer_of(texts)
    runs = bs.Runs(data, offsets, words_only=False)
    start = runs.start
    if len(runs):
        before = np.maximum(start - 1, 0)
        spaced = (start > offsets[:-1][runs.row]) & (data[before] == 32)
        start = start - spaced
    return data, start, runs.end, runs.counts


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of docs."""
    docs = narrowed(docs, doc_id="long", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(build(load_vocabulary(vocabulary)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for piece in pieces(batches, "text", PIECE):
            data, start, end, words = words_of(piece.column("text"))
            total = np.append(0, np.cumsum(counter.many(data, start, end)))
            last = np.cumsum(words)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(total[last] - total[last - words], pa.int64())})

    return docs.mapInArrow(counted, "doc_id long, n_words long, n_tokens long")
