"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

1. Words and runs of punctuation are counted over the whole corpus. Each of the WORDS most frequent has a vector of its own; the table
   of vectors goes to every task, so its size is bounded, and all rarer words fall by hash into TAIL further vectors, which
   they share. Each has a fixed sparse ternary index vector made of its hash, and its context vector sums the index vectors of its
   neighbours, two to each side, over all documents.  A task adds up its own sums, and the sums of tasks are added by ranges of words.
2. A document is the mean and the spread of its words' context vectors.
3. A two-layer network is fitted on a bounded sample of labelled documents; the temperature that minimises the log loss of
   held-out ones divides its logits.

Defined results: a null or wordless text has features of zero, is scored like any other and is kept only if its
probability says so; without labels of both kinds every document has probability null and is kept; a null doc_id is
scored and carried; repeated rows get equal scores; labels that repeat or contradict each count; of words whose frequencies are too close to tell at the end of the vocabulary
none has a vector of its own; a text of any length is read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import discard, narrowed, pieces, scratch
from .decontamination import Lookup

WORDS, TAIL, DIMS, NONZERO, WINDOW = 1 << 16, 1 << 12, 64, 4, 2
CHUNK = 1024  # words in a row of the partial table
PIECE = 1 << 20
SPAN, RUN, SLAB = 1 << 18, 16, 1 << 10  # words whose contexts are held at once; words added up before they go to the text's sum, such runs held at once
MOST = 127 // (2 * WINDOW * NONZERO)  # contexts whose sum fits a byte, whatever they are
UNIT = 2.0**32  # sums of runs are added as integers: in any order, beside any other texts, to the same bits


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and run of punctuation, case kept; first of each row."""
    data, offsets = bs.buffer_of(texts)
    runs = bs.Runs(data, offsets, words_only=False)
    return runs.hashes(), runs.first


def vocabulary(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes, in order, of the most frequent words of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for piece in pieces(batches, "text", 4 << 20):
            own, n = np.unique(tokens(piece.column("text"))[0], return_counts=True)
            names, at = np.unique(np.concatenate([names, own]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n]), minlength=len(names)).astype(np.int64)
            if len(names) > 2_000_000:  # what a task holds is bounded: Spark adds up the rest
                yield pa.record_batch({"word": pa.array(names.view(np.int64)), "n": pa.array(times)})
                names, times = names[:0], times[:0]
        yield pa.record_batch({"word": pa.array(names.view(np.int64)), "n": pa.array(times)})

    counts = scratch(docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # a histogram of frequencies gives the least one whose words all fit, so that no more than they come to the driver
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("n")).collect()
    least, held = math.inf, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        held += r.n
        if held > words:
            break
        least = r.bin
    rows = counts.where(F.floor(F.log2("n") * 64) >= F.lit(float(least))).select("word").toPandas()
    discard(counts)
    return np.sort(rows["word"].to_numpy(np.int64).view(np.uint64))


class Coder:
    """Number of each word's vector: its own, or that of its bucket behind them."""

    def __init__(self, words: np.ndarray):
        self.words, self.lookup = words, Lookup(words)
        self.size = len(words) + TAIL

    def __call__(self, h: np.ndarray) -> np.ndarray:
        code = self.lookup(h)
        rare = code < 0
        code[rare] = len(self.words) + (h[rare] & np.uint64(TAIL - 1)).astype(np.int32)
        return code

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and signs of the nonzero entries of each index vector."""
        h = np.concatenate([self.words, bs.mix(np.arange(TAIL, dtype=np.uint64))])
        x = np.stack([bs.mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k in range(NONZERO)], axis=1)
        return (x >> np.uint64(32)).astype(np.int64) % DIMS, 1.0 - 2.0 * (x & np.uint64(1)).astype(np.float64)

    def index_table(self) -> np.ndarray:
        """The index vectors, and one of zeros behind them."""
        at, sign = self.index_vectors()
        table = np.zeros((self.size + 1, DIMS), np.int8)
        np.add.at(table, (np.arange(self.size)[:, None], at), sign.astype(np.int8))
        return table


def in_step(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """(the runs, longest first; places that are first in their run, then those that are second, and so on, in that order of runs): `sums[: len(places)] += values[places]`.

    Adds up whole rows side by side; a reduceat along them would go through each column by itself, a row's width from one number to the next."""
    order = np.argsort(-length, kind="stable")
    first = start[order]
    live = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
    return order, (first[:n] + k for k, n in enumerate(live))


def runs_of(first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first run of each group, start, length): groups of places cut into runs of at most so many."""
    cuts = np.append(0, np.cumsum(-(-np.diff(first) // most)))
    n = np.diff(cuts)
    start = np.repeat(first[:-1] - cuts[:-1] * most, n) + np.arange(cuts[-1]) * most
    return cuts, start, np.minimum(np.repeat(first[1:], n) - start, most)


def contexts(code: np.ndarray, first: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, sums of their neighbours' index vectors) of each SPAN of a batch's words; index: the vectors, and one of zeros behind them."""
    rows, none = len(first) - 1, len(index) - 1
    spaced = np.full(len(code) + WINDOW * (rows + 1), none, np.int32)  # the end of a text is no neighbour of the next one's beginning
    spaced[np.arange(len(code)) + WINDOW * (1 + np.repeat(np.arange(rows), np.diff(first)))] = code
    for lo in range(0, len(spaced) - 2 * WINDOW, SPAN):
        part = spaced[lo : lo + SPAN + 2 * WINDOW]
        v, size = index.take(part, axis=0), len(part) - 2 * WINDOW
        near = np.zeros((size, DIMS), np.int8)
        for step in range(2 * WINDOW + 1):
            if step != WINDOW:
                near += v[step : step + size]
        words = part[WINDOW : WINDOW + size]
        at = np.flatnonzero(words != none)
        own, local = distinct(words[at], none)
        at = at[np.argsort(local, kind="stable")]
        yield own, sums_by_group(near, at, np.append(0, np.cumsum(np.bincount(local, minlength=len(own)))))


def distinct(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, which of them each is), for codes under `size`: np.unique without a sort."""
    seen = np.zeros(size, bool)
    seen[code] = True
    own = np.flatnonzero(seen)
    number = np.empty(size, np.uint16 if len(own) <= 1 << 16 else np.int32)  # numpy sorts 16 bits by counting
    number[own] = np.arange(len(own))
    return own, number[code]


def sums_by_group(near: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of near[at], by group; no group is empty. Runs of MOST fit a byte, their sums are added as wider numbers, again by runs."""
    values, most = near, MOST
    while True:
        cuts, start, length = runs_of(first, most)
        sums = np.zeros((len(start), DIMS), values.dtype)
        order, steps = in_step(start, length)
        for places in steps:
            sums[: len(places)] += values.take(at[places] if values is near else places, axis=0)
        values = np.empty((len(start), DIMS), np.int32)
        values[order] = sums
        if len(values) == len(first) - 1:
            return values
        first, most = cuts, RUN


def context_table(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Unit context vector of each word, over all documents. Of bounded size, so it may go to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    size = len(words) + TAIL

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        index = coder.index_table()
        total, seen = np.zeros((size, DIMS), np.int32), np.zeros(size, bool)
        for piece in pieces(batches, "text", PIECE):
            h, first = tokens(piece.column("text"))
            for own, sums in contexts(coder(h), first, index):
                total[own] += sums
                seen[own] = True
        codes = np.flatnonzero(seen)
        small = np.abs(total[codes]).max(axis=1) < 128 if len(codes) else np.zeros(0, bool)
        for group, kind in ((codes[small], np.int8), (codes[~small], np.int32)):  # most words are rare: a byte holds their sums
            for part in np.split(group, np.searchsorted(group, np.arange(CHUNK, size, CHUNK))):
                if len(part):
                    yield pa.record_batch({"chunk": pa.array([int(part[0]) // CHUNK], pa.int32()), "codes": pa.array([(part % CHUNK).astype(np.int16).tobytes()], pa.binary()), "part": pa.array([total[part].astype(kind).tobytes()], pa.binary())})

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros((CHUNK, DIMS), np.int64)
        for codes, part in zip(t.column("codes"), t.column("part")):
            at = np.frombuffer(codes.as_buffer(), np.int16)
            total[at] += np.frombuffer(part.as_buffer(), np.int8 if len(part.as_buffer()) == len(at) * DIMS else np.int32).reshape(-1, DIMS)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "unit": pa.array([(total / np.maximum(norm, 1)).astype(np.float32).tobytes()], pa.binary())})

    rows = (
        docs.select("text")
        .mapInArrow(partial, "chunk int, codes binary, part binary")
        .groupBy("chunk")
        .applyInArrow(summed, "chunk int, unit binary")
        .collect()
    )
    table = np.zeros((math.ceil(size / CHUNK) * CHUNK, DIMS), np.float32)
    for r in rows:
        table[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.unit, np.float32).reshape(-1, DIMS)
    return table[:size]


def features(texts: pa.Array, coder: Coder, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the context vectors of each text's words."""
    h, first = tokens(texts)
    counts, code = np.diff(first), coder(h)
    total = np.zeros((2, len(counts), DIMS), np.int64)
    cuts, start, length = runs_of(first, RUN)
    text = np.repeat(np.arange(len(counts)), np.diff(cuts))
    for lo in range(0, len(start), SLAB):
        own = text[lo : lo + SLAB]
        sums = np.zeros((2, len(own), DIMS), np.float32)
        order, steps = in_step(start[lo : lo + SLAB], length[lo : lo + SLAB])
        for places in steps:
            v = table.take(code[places], axis=0)
            sums[0, : len(v)] += v
            sums[1, : len(v)] += np.square(v, out=v)
        sums[:, order] = sums.copy()
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        total[:, own[heads]] += np.add.reduceat(np.rint(sums * UNIT).astype(np.int64), heads, axis=1)
    mean, square = total / UNIT / np.maximum(counts, 1)[:, None]
    return np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0))]).astype(np.float32)


@dataclass
class Network:
    """x -> relu(xA + a)B + b, on standardised features, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    A: np.ndarray
    a: np.ndarray
    B: np.ndarray
    b: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.A + self.a, 0)
        return h @ self.B + self.b

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 11, held: float = 0.2) -> Network | None:
    """Adam on the log loss; the temperature comes from a held-out part. None without both classes."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(y) < 4 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, int(len(y) * held)) if len(y) >= 20 else 0
    test, train = order[:cut], order[cut:]
    if y[train].min() == y[train].max():
        test, train = order[:0], order
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z = (x - mean) / scale
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            step += 1
            zb, yb = z[part], y[part]
            pre = zb @ p[0] + p[1]
            h = np.maximum(pre, 0)
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            d = (out - yb) / len(yb)
            back = np.outer(d, p[2]) * (pre > 0)
            grads = [zb.T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(test):
        raw = net.logits(x[test])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, raw / t) - y[test] * raw / t))

        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, words: np.ndarray, table: np.ndarray, sample: int) -> Network | None:
    """Fits on at most `sample` labelled documents, the first in order of the hash of their id."""
    chosen = (
        narrowed(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    shared = docs.sparkSession.sparkContext.broadcast((words, table))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value[0])
        for piece in pieces(batches, "text", PIECE):
            x = features(piece.column("text"), coder, shared.value[1])
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "y": piece.column("quality"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(featured, "doc_id long, y int, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "y", "x"])  # the order tasks end in must not matter
    return fit_network(np.stack([np.frombuffer(b, np.float32) for b in rows.x]), rows.y.to_numpy())


def model(docs: DataFrame, labels: DataFrame, sample: int = 10000) -> tuple[np.ndarray, np.ndarray, Network | None]:
    words = vocabulary(docs)
    table = context_table(docs, words)
    return words, table, train(docs, labels, words, table, sample)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 10000, threshold: float = 0.4) -> DataFrame:
    """(doc_id, p_good, keep) for every row of docs."""
    docs = narrowed(docs, doc_id="long", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, labels, sample))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, net = shared.value
        coder = Coder(words)
        for piece in pieces(batches, "text", PIECE):
            p = None if net is None else net.probability(features(piece.column("text"), coder, table))
            n = piece.num_rows
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "p_good": pa.nulls(n, pa.float64()) if p is None else pa.array(p, pa.float64()), "keep": pa.array(np.ones(n, bool) if p is None else p >= threshold)})

    return docs.mapInArrow(scored, "doc_id long, p_good double, keep boolean")


def filter_quality(docs: DataFrame, labels: DataFrame, sample: int = 10000, threshold: float = 0.4) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns as they were. No shuffle of the documents."""
    plain = narrowed(docs, doc_id="long", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(model(plain, labels, sample))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, net = shared.value
        coder = Coder(words)
        for batch in batches:
            if net is None:
                yield batch
                continue
            texts = pa.record_batch({"text": batch.column(at).cast(pa.string())})
            keep = [net.probability(features(p.column("text"), coder, table)) >= threshold for p in pieces([texts], "text", PIECE)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(kept, docs.schema)
