"""Vectorised scanning of Arrow string columns.

A batch of texts is one UTF-8 byte buffer with offsets.  Everything here works
on that buffer with numpy: no Python object is made per character or per word.
Null texts count as empty; a text of any length is scanned whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, WORD, PUNCT = 0, 1, 2

_CLASS = np.full(256, PUNCT, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[0, *range(28, 32)]] = SPACE
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = WORD
_CLASS[95] = WORD

_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets with one entry more than there are rows)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    return bytes_of(texts, pa.large_string())


def bytes_of(texts: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """buffer_of one array, of strings or of binary values, whose large type is given."""
    texts = texts.cast(kind)
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar("" if pa.types.is_large_string(kind) else b"", kind))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Runs:
    """Runs of one character class: start, end, kind and row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words_only: bool, space_only: bool = False):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        kind = _CLASS[data]
        if space_only:
            kind = (kind != SPACE).astype(np.uint8)
        elif words_only:
            kind = (kind == WORD).astype(np.uint8)
        if len(data):
            cut = np.empty(len(data), bool)
            cut[0] = True
            np.not_equal(kind[1:], kind[:-1], out=cut[1:])
            inner = offsets[1:-1]
            cut[inner[inner < len(data)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data))
            k = kind[starts]
            keep = k != 0
            self.start, self.end, self.kind = starts[keep], ends[keep], k[keep]
        else:
            self.start = self.end = np.zeros(0, np.int64)
            self.kind = np.zeros(0, np.uint8)
        # runs are in text order: the first run of each row
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each run's bytes, the same wherever it stands."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order of start."""
    out = np.empty(len(start), np.uint64)
    step = 1 << 20  # bytes of prefix sums held at once; a longer span widens its piece
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(start, lo + step, "left")))
        hi = int(end[i:j].max())
        up, down = _powers(hi - int(lo) + 1)
        pre = np.zeros(hi - int(lo) + 1, np.uint64)
        np.cumsum(_VALUES[data[lo:hi]] * up[:-1], dtype=np.uint64, out=pre[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (pre[e] - pre[s]) * down[s]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def words(texts: pa.Array, lower: bool = True) -> tuple[Runs, np.ndarray]:
    """Word runs of each text and their hashes."""
    data, offsets = buffer_of(lowered(texts) if lower else texts)
    runs = Runs(data, offsets, words_only=True)
    return runs, runs.hashes()


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's n-grams of n hashes; a shorter row that isn't empty gives one, of all it has."""
    rows = len(first) - 1
    counts = np.diff(first)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    have = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    row = np.repeat(np.arange(rows), have)
    base = np.cumsum(have) - have
    pos = first[:-1][row] + (np.arange(len(row)) - base[row])
    last = first[1:][row]
    acc = np.zeros(len(row), np.uint64)
    for k in range(n):
        at = pos + k
        inside = at < last
        if inside.all():
            part = hashes[at]
        else:
            part = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
        acc = acc * _BASE + part
    return mix(acc), row


def distinct_by_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, by row and value."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    if not len(v):
        return v, r
    new = np.empty(len(v), bool)
    new[0] = True
    np.not_equal(v[1:], v[:-1], out=new[1:])
    new[1:] |= r[1:] != r[:-1]
    return v[new], r[new]
