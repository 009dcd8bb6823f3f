"""Benchmark decontamination: training passages against a BM25 inverted index of the test items.

Every document is cut into overlapping passages, and every passage is a query.  An item is sought in passages of a width that
depends on its own length alone: items are put into classes by length (up to 64 words, 128, 256 and so on), each class has passages of twice
that many words, half of which overlap, so that an item lies whole in one of them. The index holds, for each term, the items that have it with their BM25 impact, in blocks of items, and the largest
impact of each block.  Impacts are divided by the item's score against itself, so a score is the share of the item that the
passage explains, at most 1, and one threshold serves all items.  Retrieval is block-max WAND over a batch of passages at a
time: passages whose summed term maxima stay below the threshold are skipped, then blocks of items whose summed block
maxima do, and only what is left is scored in full.  All items at or above the threshold are retrieved; there is no top k.

A retrieved item counts as leaked if the passage repeats enough of the n-grams of its question and of its answer, apart.
An item's question ends with its last question mark that something follows; without one its last sentence is the answer,
and of a single sentence the last third.

Indexes are built by Spark, a task for each shard of a class, of bounded size; document frequencies and the mean length are counted over all
items.  A pass over the documents takes as many shards as fit a bounded broadcast: one pass, unless the benchmark is very large.  How
items fall into shards changes no result.

Defined results: null or wordless texts and items match nothing; of an item with fewer words than an n-gram, all words count
as one; a null doc_id is matched like any other and carried as null; a null item_id is reported as -1; repeated documents give repeated rows, of repeated
items (equal item_id) each row is an item; of passages with equal scores the first is reported; texts and items of any length are read whole; an empty benchmark or corpus gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import narrowed, pieces, scratch

K1, B, THRESHOLD, OVERLAP, GRAM, BLOCK = 1.2, 0.75, 0.7, 0.6, 3, 16
STRIDE = 64
SHARD_BYTES, PASS_BYTES = 8 << 20, 64 << 20


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    text = text.strip()
    at = text.rfind("?")
    while at >= 0 and not re.search(r"\w", text[at + 1 :]):
        at = text.rfind("?", 0, at)
    if at >= 0:
        return text[: at + 1], text[at + 1 :]
    ends = [m.end() for m in re.finditer(r"[.!?\n]+(?=\s|$)", text) if re.search(r"\w", text[m.end() :]) and re.search(r"\w", text[: m.end()])]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Index:
    """Terms in order of hash; postings and block maxima of each term, item by item."""

    items: np.ndarray  # ids
    terms: np.ndarray  # hashes
    most: np.ndarray  # largest impact of each term
    first: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_most: np.ndarray
    question: list[np.ndarray]  # hashes of n-grams, distinct
    answer: list[np.ndarray]
    stride: int  # passages are of twice as many words


def _grams(text: str) -> np.ndarray:
    runs, h = bs.words(pa.array([text]))
    return np.unique(bs.ngrams(h, runs.first, max(1, min(GRAM, len(h))))[0])


def strides(n: np.ndarray) -> np.ndarray:
    """Class of length of items of n words: the least power of two from STRIDE that isn't below."""
    return (STRIDE * 2.0 ** np.ceil(np.log2(np.maximum(n, 1) / STRIDE)).clip(0)).astype(np.int64)


def build_index(ids: list[int], texts: list[str], seen: dict[int, int], n_items: int, mean_words: float) -> Index:
    """seen: in how many of all items each term is."""
    runs, h = bs.words(pa.array(texts, pa.string()))
    n = np.diff(runs.first)
    o = np.lexsort((runs.row, h))
    at = np.flatnonzero(np.append(True, (h[o][1:] != h[o][:-1]) | (runs.row[o][1:] != runs.row[o][:-1]))) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.append(at, len(h))).astype(np.float64)
    term, item = h[o][at], runs.row[o][at]
    terms, code = np.unique(term, return_inverse=True)
    df = np.array([seen[int(t)] for t in terms], np.float64)
    idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
    impact = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / max(mean_words, 1e-9)))
    own = np.bincount(item, impact, minlength=len(ids))
    impact = impact / np.where(own > 0, own, 1)[item]
    first = np.searchsorted(code, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(impact, first[:-1]) if len(terms) else np.zeros(0)
    block = item // BLOCK
    cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))) if len(code) else np.zeros(0, np.int64)
    block_most = np.maximum.reduceat(impact, cut) if len(cut) else np.zeros(0)
    parts = [split_item(t) for t in texts]
    return Index(np.array(ids, np.int64), terms, most, first, item, impact, np.searchsorted(code[cut], np.arange(len(terms) + 1)), block[cut], block_most, [_grams(q) for q, _ in parts], [_grams(a) for _, a in parts], int(strides(n).max()) if len(n) else STRIDE)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that have words, with their number and class of length."""
    for piece in pieces(batches, "text"):
        runs, _ = bs.words(piece.column("text"))
        n = np.diff(runs.first)
        out = piece.append_column("n", pa.array(n, pa.int64())).append_column("stride", pa.array(strides(n), pa.int64()))
        yield out.filter(pa.array(n > 0))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        runs, h = bs.words(piece.column("text"))
        h, row = bs.distinct_by_row(h, runs.row)
        yield pa.record_batch({"shard": piece.column("shard").take(pa.array(row)), "term": pa.array(h.view(np.int64))})


def _built(n_items: int, mean_words: float):
    def build(key: tuple, items: pa.Table, terms: pa.Table) -> pa.Table:
        seen = dict(zip(terms.column("term").to_numpy().view(np.uint64).tolist(), terms.column("df").to_pylist()))
        rows = sorted(zip((-1 if i is None else i for i in items.column("item_id").to_pylist()), items.column("text").to_pylist()))
        index = build_index([i for i, _ in rows], [t for _, t in rows], seen, n_items, mean_words)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.string()), "index": pa.array([pickle.dumps(index)], pa.binary())})

    return build


def shards_of(benchmark: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(shard, index: pickled, n: its bytes), of about `limit` bytes of text and one class of length each."""
    items = narrowed(benchmark, item_id="long", text="string").where("text is not null").mapInArrow(_measured, "item_id long, text string, n long, stride long")
    items = scratch(items, "items")
    n_items, words = items.agg(F.count("*"), F.sum("n")).first()
    sizes = items.groupBy("stride").agg(F.ceil(F.sum(F.octet_length("text")) / limit).alias("shards"))
    items = items.join(F.broadcast(sizes), "stride")  # a row for each power of two
    items = items.select(F.concat_ws("/", "stride", F.pmod(F.xxhash64("item_id", "text"), F.col("shards"))).alias("shard"), "item_id", "text")
    terms = items.mapInArrow(_terms, "shard string, term long")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.distinct().join(df, "term")
    built = items.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_built(n_items, (words or 0) / max(1, n_items)), "shard string, index binary")
    return scratch(built.withColumn("n", F.length("index").cast("long")), "indexes")


def passes_of(benchmark: DataFrame, limit: int = SHARD_BYTES, most: int = PASS_BYTES) -> Iterator[list[Index]]:
    """The indexes, as many at a time as come to `most` bytes, or one."""
    shards = shards_of(benchmark, limit)
    groups: list[list[str]] = []
    size = most
    for r in shards.select("shard", "n").orderBy("shard").toLocalIterator():
        if size + r.n > most:
            groups.append([])
            size = 0
        groups[-1].append(r.shard)
        size += r.n
    for names in groups:
        yield [pickle.loads(r["index"]) for r in shards.where(F.col("shard").isin(names)).orderBy("shard").collect()]


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of `terms` each belongs to, position) of everything that the terms' slices hold."""
    n = first[terms + 1] - first[terms]
    base = np.cumsum(n) - n
    of = np.repeat(np.arange(len(terms)), n)
    return of, first[terms][of] + np.arange(len(of)) - base[of]


class Lookup:
    """Index of a hash among the terms, or -1, by one look into an open table."""

    def __init__(self, terms: np.ndarray):
        self.bits = np.uint64(64 - max(10, int(np.ceil(np.log2(max(1, len(terms)) * 8)))))
        self.terms = terms
        slots = 1 << (64 - int(self.bits))
        self.first = np.searchsorted(terms >> self.bits, np.arange(slots + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(terms) else 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        slot = (h >> self.bits).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        for _ in range(self.deepest):
            hit = self.terms[at] == h[live]
            out[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            if not more.any():
                break
            live, at, end = live[more], at[more], end[more]
        return out


def windows(first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of passages of 2 * stride words, a stride apart; every word is in one."""
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(1, -(-counts // stride) - 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = first[:-1][row] + k * stride
    return row, lo, np.minimum(lo + 2 * stride, first[1:][row])


def retrieve(index: Index, lookup: Lookup, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all that score at least t; code: term of each word, or -1."""
    eps = 1e-9
    known = code >= 0
    bound = np.append(0, np.cumsum(np.where(known, index.most[code] if len(index.most) else 0, 0)))
    alive = np.flatnonzero(bound[hi] - bound[lo] >= t - eps)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    blocks, items = int(index.block.max()) + 1, len(index.items)
    for part in np.array_split(alive, max(1, len(alive) // 2000)):
        if not len(part):
            continue
        n = hi[part] - lo[part]
        of = np.repeat(np.arange(len(part)), n)
        term = code[lo[part][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
        ok = term >= 0
        both = np.unique(of[ok].astype(np.int64) * len(index.terms) + term[ok])
        of, term = both // len(index.terms), both % len(index.terms)
        # distinct terms only: the bound by term maxima again
        top = np.bincount(of, index.most[term], minlength=len(part))
        ok = top[of] >= t - eps
        of, term = of[ok], term[ok]
        if not len(of):
            continue
        # block maxima
        src, at = _expand(index.block_first, term)
        cell = of[src] * blocks + index.block[at]
        most = np.bincount(cell, index.block_most[at], minlength=len(part) * blocks)
        open_ = most >= t - eps
        if not open_.any():
            continue
        ok = np.isin(of, np.flatnonzero(open_.reshape(len(part), blocks).any(axis=1)))
        of, term = of[ok], term[ok]
        src, at = _expand(index.first, term)
        item = index.item[at]
        ok = open_[of[src] * blocks + item // BLOCK]
        cell, which = np.unique(of[src][ok] * items + item[ok], return_inverse=True)
        score = np.bincount(which, index.impact[at][ok], minlength=len(cell))
        ok = score >= t - eps
        out.append((part[cell[ok] // items], cell[ok] % items, score[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _covered(wanted: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(wanted, have).mean()) if len(wanted) else 1.0


def leaks_in(texts: pa.Array, indexes: list[tuple[Index, Lookup]], t: float, overlap: float) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, item id, first word of the passage, score, overlap with the question, with the answer), the best passage of each item."""
    runs, h = bs.words(texts)
    for index, lookup in indexes:
        row, lo, hi = windows(runs.first, index.stride)
        if not len(row):
            continue
        passage, item, score = retrieve(index, lookup, lookup(h), lo, hi, t)
        best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
        for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist()):
            own = h[lo[p] : hi[p]]
            have = np.concatenate([bs.ngrams(own, np.array([0, len(own)]), GRAM)[0], *(bs.ngrams(own, np.array([0, len(own)]), k)[0] for k in range(1, GRAM))])
            q, a = _covered(index.question[i], have), _covered(index.answer[i], have)
            if q >= overlap and a >= overlap:
                key, found = (int(row[p]), i), (s, -int(lo[p] - runs.first[row[p]]), q, a)
                best[key] = max(best.get(key, found), found)
        for (r, i), (s, at, q, a) in sorted(best.items()):
            yield r, int(index.items[i]), -at, s, q, a


_SCHEMA = "doc_id long, item_id long, passage_start int, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row for each document and item of the benchmark that it repeats."""
    spark = docs.sparkSession
    docs = narrowed(docs, doc_id="long", text="string")
    out = None
    for indexes in passes_of(benchmark):
        shared = spark.sparkContext.broadcast(indexes)

        def leaks(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pairs = [(index, Lookup(index.terms)) for index in shared.value]
            for piece in pieces(batches, "text", 4 << 20):
                found = list(leaks_in(piece.column("text"), pairs, threshold, overlap))
                if found:
                    rows, *rest = (list(x) for x in zip(*found))
                    ids = piece.column("doc_id").take(pa.array(rows))
                    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.record_batch([ids, *(pa.array(x, k) for x, k in zip(rest, kinds))], names=["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"])

        df = docs.mapInArrow(leaks, _SCHEMA)
        out = df if out is None else out.union(df)
    return spark.createDataFrame([], _SCHEMA) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without the rows that repeat an item, each row judged by its own text whatever its id; no shuffle."""
    at = docs.columns.index("text")
    for indexes in passes_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pairs = [(index, Lookup(index.terms)) for index in shared.value]
            for batch in batches:
                keep, done = np.ones(batch.num_rows, bool), 0
                texts = pa.record_batch({"text": batch.column(at).cast(pa.string())})
                for piece in pieces([texts], "text", 4 << 20):
                    for row, *_ in leaks_in(piece.column("text"), pairs, threshold, overlap):
                        keep[done + row] = False
                    done += piece.num_rows
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
