"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by vertical partitioning.

The n-grams of the corpus have a global order, that of their 64-bit hashes, which is cut into fragments of a few million
n-grams; a document's set falls apart into one segment a fragment, and every fragment is counted separately.

1. In each fragment, n-grams that occur in one set only are struck out; the rest is summed per document.  A document
   with fewer than t * size shared n-grams can't reach the threshold t with any other, and leaves (exact).  N-grams of
   widespread passages (in HOT of all documents or more) are known beforehand to be shared: they stay with their documents
   and never meet in one task.
2. What remains is ordered by document frequency.  Two sets that reach t share an n-gram within the first
   size - ceil(t * size) + 1 of each, so pairs that don't, such as those that only share a widespread passage, are never
   formed (exact); sizes and positions bound the overlap further.
3. Every set chooses a centre among the sets it shares such n-grams with.  Overlaps with the centre are counted in vertical
   fragments and summed.  |A & B| >= |A & C| + |B & C| - |C| (of C's shared n-grams): where that alone makes two sets of one centre reach t, their link is
   certain and counted by a prefix sum over the centre's sets; such pairs are never formed, so the work on a group of
   thousands of near copies follows its uncertain pairs.
4. Other candidates are split into blocks that no pair crosses (components of the candidate graph).  Every block is cut into
   CUTS or more vertical fragments of the n-grams' order; each counts the partial overlaps of the block's pairs, and these are
   summed per pair.

Documents with equal sets are one set during the join, so a thousand copies cost what one does. There is no cap on partners. A
set is known by a 64-bit signature, an n-gram by 40 bits of hash within its fragment.

Defined results: texts are compared in lower case, by runs of letters, digits and underscores; a text of fewer words
than n has one n-gram, of all its words; a null or wordless text has none and is alone in its class; rows without id are left out
of the join (drop_near_copies has them too, under a key made of their text). Rows that repeat an id and text count once; an id
with several texts has a row for each. Ties of centres go to the set with the most followers, then the least unshared, then the least
signature, and change no result. Whole texts are read. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import col_of, discard, narrowed, pieces, scratch, small_side, trim, without
from .components import components

N, THRESHOLD = 3, 0.5
FRAGMENT = 2_000_000  # postings in a fragment, by intent
PAIRS = 2_000_000  # candidate pairs counted at once, by intent
CUTS = 4  # vertical fragments of a block, at least
HOT = 1 / 1024  # share of documents from which an n-gram counts as widespread; there are at most a document's mean n-grams / HOT of them
TILE = 50_000  # documents that meet over one n-gram, by intent
MAX_FRAGMENTS = (1 << 24) - 1
SCALE = 1024


def packed(h: np.ndarray) -> bytes:
    """Five bytes of each value."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(raw: bytes | pa.Buffer) -> np.ndarray:
    five = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


def signatures(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, size) of each row's set, whatever its order."""
    size = np.bincount(row, minlength=rows)
    sig = np.zeros(rows, np.uint64)
    have = size > 0
    if have.any():
        first = np.cumsum(size) - size
        sig[have] = np.add.reduceat(bs.mix(grams), first[have])
    return bs.mix(sig + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), size


def sets_of(texts: pa.Array, n: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row) of each text's set, by row; only so many bytes of text are cut into words at once."""
    grams, row, begin = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in pieces([pa.record_batch({"text": texts})], "text", limit):
        runs, h = bs.words(piece.column("text"))
        v, r = bs.distinct_by_row(*bs.ngrams(h, runs.first, n))
        grams.append(v)
        row.append(r + begin)
        begin += piece.num_rows
    return np.concatenate(grams), np.concatenate(row)


def by_fragment(fragment: np.ndarray) -> np.ndarray:
    return np.argsort(fragment.astype(np.uint16) if len(fragment) and fragment.max() < 1 << 16 else fragment, kind="stable")


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys starts."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_POSTINGS = "fragment int, sigs binary, sizes binary, counts binary, grams binary"
_SHARED = "doc_id long, sig long, size int, shared int, fragment int, grams binary, classes binary"


def _local_hot(n: int, share: float):
    """N-grams that so many of a batch's rows have; one with that share of all rows has it in some batch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 6 << 20):
            grams, row = sets_of(piece.column("text"), n)
            rows = len(np.unique(row))
            names, times = np.unique(grams, return_counts=True)
            many = times >= max(2, share * rows)
            yield pa.record_batch({"gram": pa.array(names[many].view(np.int64)), "n": pa.array(times[many].astype(np.int64))})

    return found


def hot_grams(docs: DataFrame, n: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class of frequency, number of documents at least) of widespread n-grams, in order of hash."""
    rows = docs.where(F.octet_length("text") > 0).count()
    counted = docs.select("text").mapInArrow(_local_hot(n, share), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # their number is bounded by the share; counts are of those batches where the n-gram is frequent
    found = counted.where(F.col("n") >= max(2.0, share * rows)).toPandas()
    gram, times = found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    o = np.argsort(gram)
    octave = np.log2(np.maximum(times[o], 1) / max(1.0, share * rows)) if len(o) else np.zeros(0)
    return gram[o], (24 + np.clip(octave, 0, 7)).astype(np.uint8), times[o]


def _key(classes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of an n-gram in the order by frequency: class first, then 59 bits of hash."""
    return (classes.astype(np.uint64) << np.uint64(59)) | (bs.mix(h) >> np.uint64(5))


def _emit_postings(n: int, fragments: int, hot: Broadcast):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_gram, hot_class, _ = hot.value
        for piece in pieces(batches, "text", 6 << 20):
            grams, row = sets_of(piece.column("text"), n)
            sig, size = signatures(grams, row, piece.num_rows)
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            sig = np.where(size > 0, sig, bs.mix(ids.view(np.uint64) + np.uint64(0x5bd1e995)).view(np.int64))
            # who has which set: these rows pass the fragments by, as do widespread n-grams
            by = -1 - int(bs.mix(ids[:1].view(np.uint64))[0] % np.uint64(fragments))
            cols: list[list] = [[by], [sig.tobytes()], [size.astype(np.int32).tobytes()], [ids.tobytes()], [b""]]
            first = np.zeros(piece.num_rows, bool)  # of equal sets one is enough
            first[np.unique(sig, return_index=True)[1]] = True
            mine = first[row]
            grams, row = grams[mine], row[mine]
            if len(hot_gram) and len(grams):
                at = np.minimum(np.searchsorted(hot_gram, grams), len(hot_gram) - 1)
                is_hot = hot_gram[at] == grams
                if is_hot.any():
                    who = row[is_hot]
                    cut = runs_of(who)
                    for c, x in zip(cols, (by, sig[who[cut]].tobytes(), b"", np.diff(np.append(cut, len(who))).astype(np.int32).tobytes(), _key(hot_class[at[is_hot]], grams[is_hot]).tobytes())):
                        c.append(x)
                    grams, row = grams[~is_hot], row[~is_hot]
            fragment = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            o = by_fragment(fragment)
            fragment, row, grams = fragment[o], row[o], grams[o]
            at = runs_of(fragment, row)
            counts = np.diff(np.append(at, len(row)))
            who, f = row[at], fragment[at]
            cut = runs_of(f)
            for lo, hi in zip(cut, np.append(cut[1:], len(f))):
                g0, g1 = at[lo], at[hi] if hi < len(at) else len(grams)
                cols[0].append(int(f[lo]))
                cols[1].append(sig[who[lo:hi]].tobytes())
                cols[2].append(b"")
                mine = counts[lo:hi]
                cols[3].append(mine.astype(np.uint16 if mine.max() < 1 << 16 else np.int32).tobytes())
                cols[4].append(packed(grams[g0:g1]))
            yield pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["fragment", "sigs", "sizes", "counts", "grams"])

    return postings


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros(0, kind)


def _counts(t: pa.Table) -> np.ndarray:
    """Lengths of the segments, two bytes each where all of a row's fit."""
    parts = [np.frombuffer(c.as_buffer(), np.uint16 if len(c.as_buffer()) * 4 == len(s.as_buffer()) else np.int32).astype(np.int64) for s, c in zip(t.column("sigs"), t.column("counts"))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _grams(t: pa.Table) -> np.ndarray:
    """The segments' n-grams, unpacked row by row into one array."""
    rows = [x.as_buffer() for x in t.column("grams")]
    end = np.cumsum([len(x) // 5 for x in rows], dtype=np.int64)
    out = np.empty(int(end[-1]) if len(rows) else 0, np.uint64)
    for x, e in zip(rows, end):
        out[e - len(x) // 5 : e] = unpacked(x)
    return out


def _blobs(values: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """A binary column of slices of values' bytes, width a value, that start at `at`."""
    offsets = np.append(at, len(values) // width).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _sliced(columns: dict[str, pa.Array], rows: int = 50_000) -> pa.Table:
    """A table that travels in batches of so many rows: the JVM holds one of them at a time."""
    whole = pa.record_batch(columns)
    return pa.Table.from_batches([whole.slice(k, rows) for k in range(0, whole.num_rows, rows)], whole.schema)


def _passed(t: pa.Table) -> pa.Table:
    """Rows of who has which set, and of the sets' widespread n-grams, as rows of _SHARED."""
    is_who = np.array([len(x.as_buffer()) > 0 for x in t.column("sizes")], bool)
    who, hot = t.filter(pa.array(is_who)), t.filter(pa.array(~is_who))
    sig, size, ids = _joined(who.column("sigs"), np.int64), _joined(who.column("sizes"), np.int32), _joined(who.column("counts"), np.int64)
    own, shared, keys = _joined(hot.column("sigs"), np.int64), _joined(hot.column("counts"), np.int32), _joined(hot.column("grams"), np.uint64)
    a, b = len(sig), len(own)
    at = np.cumsum(shared, dtype=np.int64) - shared
    return pa.table({
        "doc_id": pa.concat_arrays([pa.array(ids), pa.nulls(b, pa.int64())]), "sig": pa.array(np.append(sig, own)), "size": pa.concat_arrays([pa.array(size), pa.nulls(b, pa.int32())]),
        "shared": pa.concat_arrays([pa.nulls(a, pa.int32()), pa.array(shared)]), "fragment": pa.concat_arrays([pa.nulls(a, pa.int32()), pa.array(np.full(b, -1, np.int32))]),
        "grams": pa.concat_arrays([pa.nulls(a, pa.binary()), _blobs(np.frombuffer(keys.tobytes(), np.uint8), at, 8)]), "classes": pa.nulls(a + b, pa.binary()),
    })


def _share(key: tuple, t: pa.Table) -> pa.Table:
    """One fragment: its n-grams that are in two or more sets, by set."""
    if key[0].as_py() < 0:
        return _passed(t)
    sig = _joined(t.column("sigs"), np.int64)
    none = pa.nulls
    # equal sets have equal segments: the first stands for all
    once = np.unique(sig, return_index=True)[1]
    keep = np.zeros(len(sig), bool)
    keep[once] = True
    counts = _counts(t)
    grams = _grams(t)
    if len(once) < len(sig):
        grams = grams[np.repeat(keep, counts)]
    who = np.repeat(np.flatnonzero(keep).astype(np.int32), counts[keep])
    del once, keep, counts
    o = np.argsort(grams)
    at = runs_of(grams[o])
    frequency = np.diff(np.append(at, len(grams)))
    # class 0 is of those in one set
    octave = np.minimum(np.log2(np.maximum(frequency, 1)), 23).astype(np.uint8)
    classes = np.empty(len(grams), np.uint8)
    classes[o] = np.repeat(octave, frequency)
    del o, at, frequency, octave
    many = classes > 0
    grams, who, classes = grams[many], who[many], classes[many]
    cut = runs_of(who)
    n = len(cut)
    mine = who[cut]
    five = np.frombuffer(packed(grams), np.uint8)
    del grams, many
    trim()
    return _sliced({"doc_id": none(n, pa.int64()), "sig": pa.array(sig[mine]), "size": none(n, pa.int32()), "shared": pa.array(np.diff(np.append(cut, len(who))).astype(np.int32)), "fragment": pa.array(np.full(n, key[0].as_py(), np.int32)), "grams": _blobs(five, cut, 5), "classes": _blobs(classes, cut, 1)})


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each value) of a binary column; null counts as empty."""
    data, offsets = bs.bytes_of(column, pa.large_binary())
    return data, np.diff(offsets)


def _keys(segments: pa.ListArray) -> pa.Array:
    """Each set's shared n-grams in the order of (class of frequency, hash).  No object is made per segment, of which a set has as many
    as there are fragments or n-grams in it."""
    offsets = segments.offsets.to_numpy()
    owner = np.repeat(np.arange(len(segments)), np.diff(offsets))
    fragment, grams, classes = segments.flatten().flatten()
    fragment = fragment.to_numpy()
    spread = fragment < 0
    ready, n = _bytes_of(grams.filter(pa.array(spread)))
    own = np.repeat(owner[spread], n // 8)
    five, _ = _bytes_of(grams.filter(pa.array(~spread)))
    octave, n = _bytes_of(classes.filter(pa.array(~spread)))
    place = np.repeat(fragment[~spread].astype(np.uint64) << np.uint64(40), n)
    keys = np.append(np.frombuffer(ready.tobytes(), np.uint64), _key(octave, place | unpacked(five)))
    own = np.append(own, np.repeat(owner[~spread], n))
    keys = keys[np.lexsort((keys, own))]
    count = np.bincount(own, minlength=len(segments))
    return _blobs(keys.view(np.uint8), np.cumsum(count) - count, 8)


def _sort_sets(batches: Iterator[pa.RecordBatch], limit: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Each set's keys, so many segments and n-grams at a time."""
    for batch in batches:
        segments = batch.column("segments")
        offsets = segments.offsets.to_numpy()
        _, n = _bytes_of(segments.flatten().field("grams"))
        total = np.append(0, np.cumsum(n // 5 + 1))[offsets - offsets[0]]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
            mine = batch.slice(lo, hi - lo)
            yield pa.record_batch({"sig": mine.column("sig"), "size": mine.column("size"), "keys": _keys(mine.column("segments"))})
            lo = hi
        trim()


def needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The least overlap at which sets of these sizes reach t (rounding in favour of the pair)."""
    return np.ceil(t / (1 + t) * (a.astype(np.float64) + b) - 1e-6)


_PREFIXES = "part int, sigs binary, sizes binary, places binary, rares binary, lists binary, sides binary, stars binary, nears binary, centres binary"
_KINDS = (np.int64, np.int32, np.int32, np.int32, np.uint64, np.uint8, np.int64, np.int64, np.int64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _slices(total: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose running total grows by `limit` at most; a row of more is a range of its own."""
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def _small(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes: the JVM holds every batch that it gets from a worker whole, outside its heap."""
    step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def _emit_prefixes(t: float, parts: int, hot: Broadcast, tile: int, paired: bool, limit: int = 200_000):
    """Each set's prefix, an entry a list of sets that share an n-gram.  The list of a widespread n-gram is split, for pairs into
    tiles in which each two of its parts meet once; an entry is repeated for each tile, so that entries are made `limit` at a time."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_gram, hot_class, times = hot.value
        hot_key = _key(hot_class, hot_gram)
        o = np.argsort(hot_key)
        hot_key, split = hot_key[o], np.maximum(1, -(-times[o] // tile))
        for batch in batches:
            sig, size = batch.column("sig").to_numpy(), batch.column("size").to_numpy()
            star, near, centre = (batch.column(c).to_numpy() for c in ("star", "near", "centre")) if paired else (np.zeros(len(sig), np.int64),) * 3
            key, who, place = [], [], []
            for k, raw in enumerate(batch.column("keys")):
                keys = np.frombuffer(raw.as_buffer(), np.uint64)
                rare = size[k] - len(keys)
                take = max(0, int(size[k]) - math.ceil(t * size[k] - 1e-9) + 1 - rare)
                key.append(keys[:take])
                who.append(np.full(len(key[-1]), k, np.int32))
                place.append(rare + np.arange(len(key[-1]), dtype=np.int32))
            if not key:
                continue
            key, who, place = map(np.concatenate, (key, who, place))
            rares = np.array([z - len(raw.as_buffer()) // 8 for z, raw in zip(size, batch.column("keys"))], np.int32)
            g = np.ones(len(key), np.int64)
            if len(hot_key) and len(key):
                at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                g = np.where(hot_key[at] == key, split[at], 1)
            for lo, hi in _slices(np.cumsum(g if paired else np.ones(len(g), np.int64)), limit):
                yield from _small(entries(key[lo:hi], who[lo:hi], place[lo:hi], g[lo:hi], sig, size, rares, star, near, centre))

    def entries(key: np.ndarray, who: np.ndarray, place: np.ndarray, g: np.ndarray, sig: np.ndarray, size: np.ndarray, rares: np.ndarray, *of_star: np.ndarray) -> pa.RecordBatch:
        side, lists = np.zeros(len(key), np.uint8), key
        if (g > 1).any():
            own = (bs.mix(sig[who].view(np.uint64) ^ key) % g.astype(np.uint64)).astype(np.int64)
            other = own
            if paired:
                i = np.repeat(np.arange(len(key)), g)
                other = np.arange(len(i)) - np.repeat(np.cumsum(g) - g, g)
                key, who, place, own, g = key[i], who[i], place[i], own[i], g[i]
            lo, hi = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
            side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)
            lists = np.where(g > 1, bs.mix(key + (lo * np.uint64(1 << 20) + hi + np.uint64(1)) * ODD), key)
        part = (bs.mix(lists) % np.uint64(parts)).astype(np.int64)
        o = by_fragment(part)
        cut = runs_of(part[o])
        columns = (sig, size.astype(np.int32), place, rares, lists, side, *of_star)
        rows = [(int(part[i[0]]), *((c[i] if k in (2, 4, 5) else c[who[i]]).tobytes() if k < 6 or paired else b"" for k, c in enumerate(columns))) for i in np.split(o, cut[1:]) if len(i)]
        names = [x.split()[0] for x in _PREFIXES.split(", ")]
        return pa.record_batch([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(len(names))], names=names)

    return prefixes


def _prefixes(t: pa.Table) -> list[np.ndarray]:
    return [_joined(t.column(k + 1), kind) for k, kind in enumerate(_KINDS)]


def _by_list(lists: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Entries of whole lists, about `limit` at a time; the entries of a longer list are together."""
    o = np.argsort(lists, kind="stable")
    end = np.append(runs_of(lists[o])[1:], len(o))
    for lo, hi in _slices(end, limit):
        yield o[end[lo - 1] if lo else 0 : end[hi - 1]]


def _elect(t: float, limit: int = 200_000):
    """For each set, the sets that are first in one of its lists, with the number of these lists: rows only in proportion to the lists."""

    def heads(sig: np.ndarray, size: np.ndarray, rare: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.lexsort((sig, rare / np.maximum(size, 1), lists))
        sig, size, rare, lists = sig[o], size[o], rare[o], lists[o]
        at = runs_of(lists)
        many = np.diff(np.append(at, len(lists)))
        head = np.repeat(at, many)
        ok = (sig != sig[head]) & (np.minimum(size, size[head]) >= t * np.maximum(size, size[head]) - 1e-6)
        return sig[ok], sig[head][ok], (rare / np.maximum(size, 1))[head][ok]

    def elect(key: tuple, tab: pa.Table) -> pa.Table:
        sig, size, rare, lists = (_joined(tab.column(k + 1), _KINDS[k]) for k in (0, 1, 3, 4))
        found = [heads(sig[i], size[i], rare[i], lists[i]) for i in _by_list(lists, limit)]
        del sig, size, rare, lists
        a, b, r = (np.concatenate([x[k] for x in found]) for k in range(3)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        del found
        o = np.lexsort((b, a))
        a, b, r = a[o], b[o], r[o]
        cut = runs_of(a, b)
        trim()
        return pa.table({"sig": pa.array(a[cut]), "centre": pa.array(b[cut]), "rare": pa.array(r[cut]), "votes": pa.array(np.diff(np.append(cut, len(a))).astype(np.int64))})

    return elect


def _find_candidates(t: float, budget: int = 500_000, most: int = 1_000_000, limit: int = 200_000):
    """Pairs that share a list and whose link isn't certain by their common centre.  Lists are worked through about `limit` entries at a time.
    About `most` different pairs are held; where a part has more they leave at once, and one may leave again: repeats are taken out by whoever reads them."""

    def uncertain(code: np.ndarray, size: np.ndarray, place: np.ndarray, lists: np.ndarray, side: np.ndarray, star: np.ndarray, near: np.ndarray, centre: np.ndarray, sets: int) -> Iterator[np.ndarray]:
        """Pairs of these entries, as products of the sets' numbers; of the lists all entries are here."""
        o = np.lexsort((code, near, star, lists))
        code, size, place, lists, side, star, near, centre = (x[o] for x in (code, size, place, lists, side, star, near, centre))
        at = runs_of(lists)
        begin = np.repeat(at, np.diff(np.append(at, len(lists))))
        block_at = runs_of(lists, star)
        block = np.repeat(block_at, np.diff(np.append(block_at, len(lists))))
        # a set's partners are all before its centre's sets, and of these the first, whose sums stay below the centre's size
        here = np.arange(len(lists))
        rank = np.unique(near, return_inverse=True)[1] if len(near) else here
        which = np.cumsum(np.isin(here, block_at)) - 1
        levels = np.unique(near)
        width = len(levels) + 1
        at_most = np.searchsorted(levels, centre - near, "left")  # levels below leave the pair uncertain
        unsure = np.searchsorted(which * width + rank, which * width + at_most, "left")
        n = np.maximum(np.minimum(unsure, here), block) - begin
        del o, at, lists, star, near, centre, block, which, rank, at_most, unsure
        for lo, hi in _slices(np.cumsum(n), budget):
            i = np.repeat(here[lo:hi], n[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + begin[i]
            ok = (side[i] == 0) | (side[i] != side[j])
            ok &= np.minimum(size[i] - place[i], size[j] - place[j]) >= needed(size[i], size[j], t)
            ok &= np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - 1e-6
            i, j = code[i[ok]].astype(np.int64), code[j[ok]].astype(np.int64)
            yield np.unique(np.minimum(i, j) * sets + np.maximum(i, j))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, size, place, _, lists, side, star, near, centre = _prefixes(pa.Table.from_batches(list(batches)))
        names, code = np.unique(sig, return_inverse=True)
        code = code.astype(np.int32)
        del sig, _
        trim()
        found = np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def leave(found: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(found), 100_000):
                a, b = np.divmod(found[k : k + 100_000], len(names))
                apart = a != b
                yield pa.record_batch({"a": pa.array(names[a[apart]]), "b": pa.array(names[b[apart]])})

        for e in _by_list(lists, limit):
            for pairs in uncertain(*(x[e] for x in (code, size, place, lists, side, star, near, centre)), len(names)):
                held.append(pairs)
                if sum(map(len, held)) > most:
                    found, held = np.unique(np.concatenate([found, *held])), []
                    if len(found) > most:
                        yield from leave(found)
                        found = found[:0]
        yield from leave(np.unique(np.concatenate([found, *held])))
        del found, held, code, size, place, lists, side, star, near, centre
        trim()

    return candidates


def _cut_of(keys: np.ndarray, cuts: int) -> np.ndarray:
    """Vertical fragment of each n-gram: equal ranges of the order of their hashes."""
    h = (keys << np.uint64(5)) >> np.uint64(32)
    return (h * np.uint64(cuts) >> np.uint64(32)).astype(np.int64)


def _emit_cuts(cuts: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set's segment in each vertical fragment."""
        for batch in batches:
            sig, size, shared, cut, out = [], [], [], [], []
            for s, z, raw in zip(batch.column("sig").to_pylist(), batch.column("size").to_pylist(), batch.column("keys")):
                keys = np.frombuffer(raw.as_buffer(), np.uint64)
                part = _cut_of(keys, cuts)
                for v in range(cuts):
                    for c, x in zip((sig, size, shared, cut, out), (s, z, len(keys), v, keys[part == v].tobytes())):
                        c.append(x)
            yield pa.record_batch({"sig": pa.array(sig, pa.int64()), "size": pa.array(size, pa.int32()), "shared": pa.array(shared, pa.int32()), "cut": pa.array(cut, pa.int32()), "keys": pa.array(out, pa.binary())})

    return emit


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True)) for a, b in zip(batch.column("keys"), batch.column("other"))]
        yield pa.record_batch({"sig": batch.column("sig"), "star": batch.column("star"), "size": batch.column("size"), "of": batch.column("of"), "centre": batch.column("centre"), "n": pa.array(n, pa.int64())})


def with_stars(sets: DataFrame, t: float, parts: int, hot: Broadcast, tile: int, cuts: int) -> DataFrame:
    """sets with star: the set each is near to, or itself; near: its overlap with the star less t / (1 + t) of its size, scaled; centre:
    what two sets' `near` of one star must come to for their link to be certain."""
    prefixes = sets.mapInArrow(_emit_prefixes(t, parts, hot, tile, False), _PREFIXES)
    votes = scratch(prefixes.groupBy("part").applyInArrow(_elect(t), "sig long, centre long, rare double, votes long").groupBy("sig", "centre").agg(F.sum("votes").alias("votes"), F.first("rare").alias("rare")), "votes")
    followers = votes.groupBy("centre").agg(F.count("*").alias("followers"))
    best = votes.join(followers, "centre").groupBy("sig").agg(F.max_by("centre", F.struct("followers", -F.col("rare"), "votes", F.bitwise_not("centre"))).alias("star"))
    best = scratch(best, "stars")
    # one that others are near to is near to itself alone
    best = best.join(best.select(F.col("star").alias("sig")).distinct(), "sig", "left_anti")
    segments = scratch(sets.mapInArrow(_emit_cuts(cuts), "sig long, size int, shared int, cut int, keys binary"), "segments")
    centres = segments.select(F.col("sig").alias("star"), "cut", F.col("size").alias("of"), F.col("shared").alias("centre"), F.col("keys").alias("other"))
    met = segments.join(best, "sig").join(centres, ["star", "cut"]).select("sig", "star", "size", "of", "centre", "keys", "other")
    summed = met.mapInArrow(_partial, "sig long, star long, size int, of int, centre int, n long").groupBy("sig", "star").agg(F.sum("n").alias("overlap"), *[F.first(c).alias(c) for c in ("size", "of", "centre")])
    c = t / (1 + t)

    def near(overlap: Column, size: Column) -> Column:
        return F.floor((overlap - F.lit(c) * size) * SCALE).cast("long")

    summed = summed.select("sig", "star", near(F.col("overlap"), F.col("size")).alias("near"), (F.col("centre").cast("long") * SCALE + 1).alias("sum"), near(F.col("centre"), F.col("of")).alias("top"))
    summed = scratch(summed.where(F.col("near") + F.col("top") >= F.col("sum")).select("sig", "star", "near", F.col("sum").alias("centre")), "near")
    shared = F.floor(F.octet_length("keys") / 8)
    out = sets.join(small_side(summed, 40), "sig", "left").select("sig", "size", "keys", F.coalesce("star", "sig").alias("star"), F.coalesce("near", near(shared, F.col("size"))).alias("near"), F.coalesce("centre", shared.cast("long") * SCALE + 1).alias("centre"))
    out = scratch(out, "starred")
    for done in (votes, segments):
        discard(done)
    return out


def certain_links(sets: DataFrame) -> DataFrame:
    """(sig, links): partners of the same star whose link is certain.  Sets of one star are counted by levels of `near`, of which
    there are no more than a text has n-grams, however many sets there are."""
    levels = sets.groupBy("star", "centre", "near").agg(F.count("*").alias("n"))
    points = levels.select("star", F.col("near").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("n"), F.lit(None).cast("long").alias("near"), "centre")
    asked = levels.select("star", (F.col("centre") - F.col("near")).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), "near", "centre")
    w = Window.partitionBy("star").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    counted = points.union(asked).withColumn("links", F.sum("n").over(w)).where("kind = 0")
    counted = counted.select("star", "near", (F.col("links") - F.when(2 * F.col("near") >= F.col("centre"), 1).otherwise(0)).alias("links")).where("links > 0")
    return sets.select("sig", "star", "near").join(counted, ["star", "near"]).select("sig", "links")


def _emit_segments(batches: Iterator[pa.RecordBatch], rows: int = 20_000, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Each set's segment in each of its block's vertical fragments, for each share of the block's pairs: so many rows and bytes at a time,
    since a set of a large block has one for each fragment and share."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    out: list[list] = [[] for _ in kinds]
    held = 0

    def gone() -> pa.RecordBatch:
        nonlocal held
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["unit", "sig", "size", "keys"])
        for c in out:
            c.clear()
        held = 0
        return batch

    for batch in batches:
        for block, cuts, shares, sig, size, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "cuts", "shares", "sig", "size")), batch.column("keys")):
            keys = np.frombuffer(raw.as_buffer(), np.uint64)
            part = _cut_of(keys, cuts)
            o = by_fragment(part)
            keys, end = keys[o], np.searchsorted(part[o], np.arange(cuts), "right")
            for v in range(cuts):
                mine = keys[end[v - 1] if v else 0 : end[v]].tobytes()
                for k in range(shares):
                    for c, x in zip(out, (f"{block}/{v}/{k}", sig, size, mine)):
                        c.append(x)
                    held += len(mine)
                    if len(out[0]) >= rows or held >= limit:
                        yield gone()
    yield gone()


_OVERLAPS = "a long, b long, size_a int, size_b int, overlap long"


def _count_overlaps(key: tuple, segments: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of a block's candidate pairs within one vertical fragment."""
    sig, size = segments.column("sig").to_numpy(), segments.column("size").to_numpy()
    blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in segments.column("keys")]
    lengths = np.array([len(x) for x in blobs], np.int64)
    local = np.unique(np.concatenate(blobs), return_inverse=True)[1].astype(np.int32) if blobs else np.zeros(0, np.int32)
    order = np.argsort(sig)
    a = order[np.searchsorted(sig[order], pairs.column("a").to_numpy())] if pairs.num_rows else np.zeros(0, np.int64)
    b = order[np.searchsorted(sig[order], pairs.column("b").to_numpy())] if pairs.num_rows else np.zeros(0, np.int64)
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    start = np.cumsum(lengths) - lengths
    overlap = np.zeros(len(a), np.int64)
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, np.uint8)
    cut = np.append(runs_of(a), len(a))
    for lo, hi in zip(cut[:-1], cut[1:]):
        x = a[lo]
        own = local[start[x] : start[x] + lengths[x]]
        mark[own] = 1
        k = lo
        while k < hi:  # a million n-grams at a time
            total = np.cumsum(lengths[b[k:hi]])
            j = k + max(1, int(np.searchsorted(total, 1_000_000, "right")))
            ys = b[k:j]
            n = lengths[ys]
            at = np.repeat(start[ys] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            hit = np.append(0, np.cumsum(mark[local[at]], dtype=np.int64))
            end = np.cumsum(n)
            overlap[k:j] = hit[end] - hit[end - n]
            k = j
        mark[own] = 0
    some = overlap > 0
    a, b, overlap = a[some], b[some], overlap[some]
    del local, blobs, mark
    trim()
    return pa.table({"a": pa.array(sig[a]), "b": pa.array(sig[b]), "size_a": pa.array(size[a]), "size_b": pa.array(size[b]), "overlap": pa.array(overlap)})


def similar_sets(docs: DataFrame, n: int = N, t: float = THRESHOLD, fragment: int = FRAGMENT, cuts: int = CUTS, hot: float = HOT, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(who has which set: doc_id, sig, size; sets that may be similar to others: sig, star, near, centre; pairs of different sets that
    reach t and aren't certain by their star: a, b, overlap)."""
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    docs = narrowed(docs, doc_id="long", text="string").where("doc_id is not null")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = min(MAX_FRAGMENTS, max(1, math.ceil(chars / 6.5 / fragment)))
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot_grams(docs, n, hot))
    shared = scratch(docs.mapInArrow(_emit_postings(n, fragments, shared_hot), _POSTINGS).groupBy("fragment").applyInArrow(_share, _SHARED), "shared")
    who = scratch(shared.where("doc_id is not null").select("doc_id", "sig", "size").distinct(), "who")

    segments = shared.where("doc_id is null").drop("doc_id", "size")
    spread = segments.where("fragment < 0").groupBy("sig").agg(*[F.first(c).alias(c) for c in segments.columns[1:]])
    # counts travel first, and the n-grams of those sets alone that can still reach the threshold
    # a task adds up several fragments, so that a set has few rows to shuffle
    totals = segments.where("fragment >= 0").select("sig", "shared").coalesce(max(1, math.ceil(fragments / 16))).union(spread.select("sig", "shared")).groupBy("sig").agg(F.sum("shared").alias("total"))
    alive = totals.join(who.select("sig", "size").distinct(), "sig").where(F.col("total") >= t * F.col("size") - 1e-6).select("sig", "size")
    alive = small_side(scratch(alive, "alive"), 24)
    parts = segments.where("fragment >= 0").union(spread).join(alive, "sig").select("sig", "size", F.struct("fragment", "grams", "classes").alias("part"))
    sets = parts.groupBy("sig").agg(F.first("size").alias("size"), F.collect_list("part").alias("segments"))
    sets = scratch(sets.mapInArrow(_sort_sets, "sig long, size int, keys binary"), "sets")
    discard(shared)

    grams = sets.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    pieces_ = max(1, math.ceil(grams / fragment))
    starred = with_stars(sets, t, pieces_, shared_hot, tile, cuts)
    discard(sets)
    candidates = starred.mapInArrow(_emit_prefixes(t, pieces_, shared_hot, tile, True), _PREFIXES).groupBy("part").applyInArrow(_find_candidates(t), "a long, b long")
    candidates = candidates.distinct().sortWithinPartitions("a", "b")  # in order they compress, here and in the next shuffle
    candidates = scratch(candidates, "candidates")
    # blocks that no candidate pair crosses, several components in each
    member = components(candidates).select(F.col("node").alias("sig"), F.col("component"))
    placed = starred.select("sig", "size", "keys").join(small_side(scratch(member, "member"), 32), "sig").withColumn("block", F.pmod(F.xxhash64("component"), F.lit(pieces_)))
    placed = scratch(placed, "placed")
    sized = placed.groupBy("block").agg(F.greatest(F.lit(cuts), F.ceil(F.sum(F.octet_length("keys") / 8) / fragment)).cast("int").alias("cuts"))
    in_block = small_side(scratch(placed.select(F.col("sig").alias("a"), "block"), "in_block"), 24)
    # the pairs of a group of thousands are shared out, each part with the block's sets
    shares = candidates.join(in_block, "a").groupBy("block").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("shares"))
    sized = small_side(scratch(sized.join(shares, "block"), "cuts"), 24)
    segments = placed.join(sized, "block").select("block", "cuts", "shares", "sig", "size", "keys")
    segments = segments.mapInArrow(_emit_segments, "unit string, sig long, size int, keys binary")
    pairs = candidates.join(in_block, "a").join(sized, "block").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pairs = pairs.select(F.concat_ws("/", "block", "cut", F.pmod(F.xxhash64("a"), F.col("shares"))).alias("unit"), "a", "b")
    overlaps = segments.groupBy("unit").cogroup(pairs.groupBy("unit")).applyInArrow(_count_overlaps, _OVERLAPS)
    found = overlaps.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    found = found.where(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")) >= t).select("a", "b", "overlap")
    found = scratch(found, "found")
    stars = scratch(starred.drop("keys", "size"), "stars")
    for done in (candidates, placed, starred):
        discard(done)
    return who, stars, found


def groups(stars: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, component) of all sets with a link."""
    edges = stars.where("sig <> star").select(F.col("sig").alias("a"), F.col("star").alias("b")).union(found.select("a", "b"))
    return components(edges).select(F.col("node").alias("sig"), "component")


def ngram_jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD, fragment: int = FRAGMENT, cuts: int = CUTS, hot: float = HOT, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links), a row a document.  Documents are in one class if a chain of pairs that reach t leads from one
    to the other; class_id is the least id of the class. n_copies: documents with the same set, itself among them. n_links: different
    sets whose similarity with this one reaches t."""
    who, stars, found = similar_sets(docs, n, t, fragment, cuts, hot, tile)
    links = found.select(F.col("a").alias("sig")).union(found.select("b")).groupBy("sig").agg(F.count("*").alias("links"))
    links = links.union(certain_links(stars)).groupBy("sig").agg(F.sum("links").alias("n_links"))
    of_set = who.groupBy("sig").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first")).join(groups(stars, found), "sig", "left").join(links, "sig", "left")
    of_set = scratch(of_set.withColumn("component", F.coalesce("component", "sig")), "of-set")
    least = of_set.groupBy("component").agg(F.min("first").alias("class_id"), F.count("*").alias("sets")).where("sets > 1").select("component", "class_id")
    of_set = of_set.join(least, "component", "left").select("sig", F.coalesce("class_id", "first").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return who.join(of_set, "sig").select("doc_id", "class_id", "n_copies", "n_links")


def copies_to_drop(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """Ids of documents in a group of near copies, but for the least id of each group."""
    who, stars, found = similar_sets(docs, n, t)
    who = who.where("size > 0")
    ids = who.join(groups(stars, found), "sig", "left").select("doc_id", F.coalesce("component", "sig").alias("component"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return ids.join(least, "component").where("doc_id <> least").select("doc_id").distinct()


def drop_near_copies(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies, that of the least id.  Rows with the same id stay or go together.

    Rows without id take part under a key above all usual ids, made of their text; of such rows with one text one is left at most, and
    those without words all stay."""
    key = F.coalesce(col_of(docs, "doc_id", "long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(col_of(docs, "text", "string")), 2))
    keyed = without(docs, "_key").withColumn("_key", key)
    drop = small_side(scratch(copies_to_drop(keyed.select(F.col("_key").alias("doc_id"), "text"), n, t), "drop"), 16)
    kept = keyed.join(drop.withColumnRenamed("doc_id", "_key"), "_key", "left_anti")
    named, wordy = F.col("_key") < (1 << 62), F.coalesce(F.col("text").rlike(r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"), F.lit(False))
    out = kept.where(named | ~wordy).unionByName(kept.where(~named & wordy).dropDuplicates(["_key"]))
    return out.select(*docs.columns)


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS gram FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b, x.size = y.size AND x.size = overlap AS same FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
      WHERE CAST(overlap AS DOUBLE) / (x.size + y.size - overlap) >= {THRESHOLD}),
first AS (SELECT d.doc_id, coalesce(least(min(p.b), d.doc_id), d.doc_id) AS first, count(p.b) + 1 AS n_copies FROM documents d LEFT JOIN p ON p.a = d.doc_id AND p.same WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id),
links AS (SELECT p.a AS doc_id, count(DISTINCT f.first) AS n_links FROM p JOIN first f ON f.doc_id = p.b WHERE NOT p.same GROUP BY p.a),
reach AS (SELECT doc_id AS d, doc_id AS m FROM documents WHERE doc_id IS NOT NULL UNION SELECT p.b, r.m FROM reach r JOIN p ON p.a = r.d WHERE r.m < p.b),
class AS (SELECT d AS doc_id, min(m) AS class_id FROM reach GROUP BY d)
SELECT f.doc_id, c.class_id, f.n_copies, coalesce(l.n_links, 0) AS n_links
FROM first f JOIN class c ON c.doc_id = f.doc_id LEFT JOIN links l ON l.doc_id = f.doc_id"""
