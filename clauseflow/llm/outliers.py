"""Quality rules: robust multivariate outliers by minimum covariance determinant.

1. Eight statistics of each document, transformed towards normality: logarithms of counts and lengths, arcsine roots of shares. A share
   is first drawn towards its usual value by a prior of some words or characters, so that short texts don't jump.
2. For each language and source the location and scatter of the half-and-more (three quarters) of its documents whose covariance has the least
   determinant.  The search starts from a bounded sample of the group (random subsets, concentrated); then concentration steps go over
   all documents: rows are binned by distance under the present estimate, sums of each bin are added up over tasks, and the nearest
   three quarters give the next estimate, until it stands still.  No group is ever brought together, so a hot
   source costs no more than its rows.  The scatter is regularised by a floor for each statistic, for shares that are
   zero in most documents.
3. The squared Mahalanobis distance is scaled so that its median is that of a chi-square variable; a document whose distance is
   beyond a fixed limit is rejected.

A group of fewer than MIN_ROWS documents is judged by its language's estimate, a language of fewer by that of all documents,
and where all are fewer than that nothing is rejected.  Estimates are broadcast; where more than MAX_GROUPS groups have one,
the groups are worked through in passes of about that many.

Defined results: null and empty texts are texts of no words and are judged like others; null languages and sources are groups of
their own; repeated rows get equal results; of equal determinants the first start stands, and a distance equal to the limit is kept; a null doc_id is judged and carried; texts of any length are read whole; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import narrowed, pieces, scratch

NAMES = ["words", "word_length", "punctuation", "symbols", "upper", "digits", "repeated_lines", "variety"]
D = len(NAMES)
FLOOR = np.array([0.35, 0.06, 0.05, 0.05, 0.06, 0.05, 0.12, 0.12])  # least standard deviation of each statistic
KEPT, START, MIN_ROWS, MAX_GROUPS = 0.75, 400, 200, 50_000
LIMIT = 12.0  # robust distances; the statistics' tails are heavier than a normal's, whose distance stays below 7 but once in 10 million times
BINS_PER_OCTAVE = 16

_PLAIN = np.zeros(256, bool)  # punctuation of ordinary prose
_PLAIN[list(b".,;:!?'\"()-")] = True
_UPPER, _DIGIT, _SPACE, _WORD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_WORD[95] = True
_SYMBOL = ~(_PLAIN | _SPACE | _WORD)


def chi_square_cdf(x: float, d: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(q: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, d) < q else (lo, mid)
    return hi


MEDIAN = chi_square_quantile(0.5, D)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    data, offsets = bs.buffer_of(texts)
    n = len(offsets) - 1
    out = np.zeros((n, D))
    if not n:
        return out
    size = np.diff(offsets).astype(np.float64)
    runs = bs.Runs(data, offsets, words_only=True)
    words = runs.counts.astype(np.float64)
    letters = _sums(_WORD[data], offsets).astype(np.float64)

    def share(k: np.ndarray, of: np.ndarray, usual: float, weight: float) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip((k + usual * weight) / (of + weight), 0, 1)))

    out[:, 0] = np.log(words + 20)
    out[:, 1] = np.log((letters + 6 * 20) / (words + 20))
    out[:, 2] = share(_sums(_PLAIN[data], offsets), words, 0.12, 40)
    out[:, 3] = share(_sums(_SYMBOL[data], offsets), words, 0.002, 40)
    out[:, 4] = share(_sums(_UPPER[data], offsets), letters, 0.03, 120)
    out[:, 5] = share(_sums(_DIGIT[data], offsets), size, 0.005, 120)
    # bytes in lines that came before in the same text
    newline = data == 10
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1]))
    cut = cut[cut < len(data)]
    end = np.append(cut[1:], len(data))
    end = end - newline[end - 1] if len(cut) else end
    full = end > cut
    cut, end = cut[full], end[full]
    if len(cut):
        h, row = bs.span_hashes(data, cut, end), np.searchsorted(offsets, cut, "right") - 1
        o = np.lexsort((cut, h, row))
        again = np.zeros(len(cut), bool)
        again[o[1:]] = (h[o][1:] == h[o][:-1]) & (row[o][1:] == row[o][:-1])
        out[:, 6] = np.bincount(row, (end - cut) * again, minlength=n)
    out[:, 6] = share(out[:, 6], size, 0.005, 200)
    # distinct words against what a text of as many words usually has
    h = runs.hashes()
    o = np.lexsort((h, runs.row))
    first = np.ones(len(h), bool)
    first[1:] = (h[o][1:] != h[o][:-1]) | (runs.row[o][1:] != runs.row[o][:-1])
    distinct = np.bincount(runs.row[o][first], minlength=n)
    out[:, 7] = np.log((distinct + 20) / (words + 20) ** 0.8)
    return out


_STATS = "doc_id long, lang string, source string, n_words long, x binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", 2 << 20):
        texts = piece.column("text")
        x = statistics(texts)
        raw = np.ascontiguousarray(x, np.float32)
        yield pa.record_batch(
            {"doc_id": piece.column("doc_id"), "lang": piece.column("lang"), "source": piece.column("source"), "n_words": pa.array(np.rint(np.exp(x[:, 0]) - 20).astype(np.int64)), "x": pa.array([r.tobytes() for r in raw], pa.binary())}
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, D).astype(np.float64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and regularised covariance."""
    mean = x.mean(0)
    c = x - mean
    return mean, c.T @ c / max(1, len(x)) + np.diag(FLOOR**2)


def squared(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    c = x - mean
    return np.einsum("ij,jk,ik->i", c, inverse, c)


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, steps: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps until the determinant stands still: (its logarithm, mean, covariance)."""
    last = math.inf
    for _ in range(steps):
        near = np.argpartition(squared(x, mean, np.linalg.inv(cov)), h - 1)[:h]
        mean, cov = scatter(x[near])
        det = float(np.linalg.slogdet(cov)[1])
        if det >= last - 1e-10:
            break
        last = det
    return last, mean, cov


def fast_mcd(x: np.ndarray, starts: int = 20, seed: int = 3, kept: float = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the `kept` share of rows with the least determinant, by random starts."""
    h = max(1, math.ceil(kept * len(x)))
    rng = np.random.default_rng(seed)
    tries = [concentrate(x, *scatter(x), h, 2)]
    for _ in range(starts):
        few = rng.choice(len(x), min(len(x), D + 1), replace=False)
        tries.append(concentrate(x, *scatter(x[few]), h, 2))
    tries.sort(key=lambda t: t[0])
    return min((concentrate(x, m, c, h) for _, m, c in tries[:4]), key=lambda t: t[0])[1:]


UPPER = np.triu_indices(D)


def _group_keys(lang: list, source: list, own: dict) -> list:
    """The estimate that each row is judged by: of its language and source, its language, or all."""
    out = []
    for a, b in zip(lang, source):
        key = (a, b)
        out.append(key if key in own else (a, None, 1) if (a, None, 1) in own else "all")
    return out


def _codes(batch: pa.RecordBatch, own: dict[object, int]) -> np.ndarray:
    """Number of the estimate for each row."""
    lang, source = pc.fill_null(batch.column("lang"), "\u0001null"), pc.fill_null(batch.column("source"), "\u0001null")
    both = pc.binary_join_element_wise(lang, source, "\u0000").dictionary_encode()
    names = [tuple(None if v == "\u0001null" else v for v in s.split("\u0000", 1)) for s in both.dictionary.to_pylist()]
    code = np.array([own[k] for k in _group_keys([a for a, _ in names], [b for _, b in names], own)], np.int64)
    return code[both.indices.to_numpy(zero_copy_only=False)]


def _by_group(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its rows in order) of a batch, whatever the number of groups in one sort."""
    o = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.append(True, code[o][1:] != code[o][:-1])) if len(code) else np.zeros(0, np.int64)
    for rows in np.split(o, at[1:]):
        if len(rows):
            yield int(code[rows[0]]), rows


def _sample(stats: DataFrame, own: dict[object, int]) -> dict[int, np.ndarray]:
    """A bounded sample of each group: the rows of least hash, all tasks' samples joined."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code, x, h = _codes(batch, own), _matrix(batch.column("x")), batch.column("h").to_numpy()
            for g, mine in _by_group(code):
                ha, xa = held.get(g, (np.zeros(0, np.int64), np.zeros((0, D))))
                ha, xa = np.append(ha, h[mine]), np.vstack([xa, x[mine]])
                o = np.lexsort((*xa.T, ha))[:START]
                held[g] = ha[o], xa[o]
        for g, (h, x) in held.items():
            yield pa.record_batch({"g": pa.array([g], pa.int64()), "h": pa.array([h.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    def start(key: tuple, t: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in t.column("h")])
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.float64).reshape(-1, D) for b in t.column("x")])
        x = x[np.lexsort((*x.T, h))[:START]]
        mean, cov = fast_mcd(x)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([np.append(mean, cov.ravel()).tobytes()], pa.binary())})

    hashed = stats.select("lang", "source", "x", F.xxhash64("doc_id", "x").alias("h"))
    rows = hashed.mapInArrow(partial, "g long, h binary, x binary").groupBy("g").applyInArrow(start, "g long, m binary").collect()
    return {r.g: np.frombuffer(r.m, np.float64) for r in rows}


def _step(stats: DataFrame, own: dict[object, int], now: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One concentration step over all rows: (next estimate, median of squared distances under the present one) of each group."""
    shared = stats.sparkSession.sparkContext.broadcast((own, {g: (m[:D], np.linalg.inv(m[D:].reshape(D, D))) for g, m in now.items()}))
    width = 1 + D + len(UPPER[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = shared.value
        total: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code, x = _codes(batch, names), _matrix(batch.column("x"))
            for g, rows in _by_group(code):
                if g not in known:
                    continue
                mean, inverse = known[g]
                mine = x[rows]
                own = total.setdefault(g, {})
                b = np.floor(BINS_PER_OCTAVE * np.log2(np.maximum(squared(mine, mean, inverse), 2.0**-20))).astype(np.int64)
                c = mine - mean
                v = np.hstack([np.ones((len(c), 1)), c, (c[:, :, None] * c[:, None, :])[:, UPPER[0], UPPER[1]]])
                o = np.argsort(b, kind="stable")
                at = np.flatnonzero(np.append(True, b[o][1:] != b[o][:-1]))
                for k, s in zip(b[o][at].tolist(), np.add.reduceat(v[o], at)):
                    own[k] = own[k] + s if k in own else s
        for g, own in sorted(total.items()):
            bins = sorted(own)
            yield pa.record_batch({"g": pa.array([g], pa.int64()), "b": pa.array([np.array(bins, np.int64).tobytes()], pa.binary()), "v": pa.array([np.array([own[k] for k in bins]).tobytes()], pa.binary())})

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        g = key[0].as_py()
        bins = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in t.column("b")])
        v = np.concatenate([np.frombuffer(b.as_buffer(), np.float64).reshape(-1, width) for b in t.column("v")])
        o = np.lexsort((*v.T, bins))  # a fixed order of addition
        at = np.flatnonzero(np.append(True, bins[o][1:] != bins[o][:-1]))
        bins, v = bins[o][at], np.add.reduceat(v[o], at)
        count = np.cumsum(v[:, 0])
        half = int(np.searchsorted(count, count[-1] / 2))
        before = count[half - 1] if half else 0
        median = 2 ** ((bins[half] + (count[-1] / 2 - before) / v[half, 0]) / BINS_PER_OCTAVE)
        h = KEPT * count[-1]
        last = int(np.searchsorted(count, h))
        before = count[last - 1] if last else 0
        s = v[:last].sum(0) + v[last] * ((h - before) / v[last, 0])
        mean = s[1 : D + 1] / s[0]
        second = np.zeros((D, D))
        second[UPPER] = s[D + 1 :] / s[0]
        second = second + np.triu(second, 1).T
        cov = second - np.outer(mean, mean) + np.diag(FLOOR**2)
        m = np.concatenate([mean + shared.value[1][g][0], cov.ravel(), [median]])
        return pa.table({"g": pa.array([g], pa.int64()), "m": pa.array([m.tobytes()], pa.binary())})

    rows = stats.select("lang", "source", "x").mapInArrow(partial, "g long, b binary, v binary").groupBy("g").applyInArrow(merged, "g long, m binary").collect()
    out = {}
    for r in rows:
        m = np.frombuffer(r.m, np.float64)
        out[r.g] = m[:-1], float(m[-1])
    return out


def estimate_groups(stats: DataFrame, rows: list, langs: list, orphans: set) -> tuple[dict[object, int], dict[int, tuple[np.ndarray, np.ndarray, float]]]:
    """(number of each group that has an estimate, (mean, inverse covariance, scale of distances) by number), for groups `rows`
    with estimates of their own and for the languages of rows that have none."""
    own: dict[object, int] = {"all": 0}
    for r in langs:
        own[(r.lang, None, 1)] = len(own)
    for r in rows:
        own[(r.lang, r.source)] = len(own)

    # a language's estimate and that of all are made from the rows of its small groups and of all its others too
    levels = [{k: v for k, v in own.items() if isinstance(k, str)}, {k: v for k, v in own.items() if len(k) == 3 and not isinstance(k, str)} | {"all": 0}, own]
    used = [
        levels[0] if any((lang, None, 1) not in own for lang in orphans) else None,
        levels[1] if any((lang, None, 1) in own for lang in orphans) else None,
        own if rows else None,
    ]
    found: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for level, names in enumerate(used):
        if names is None:
            continue
        # the least of rows that an estimate stands on
        now = _sample(stats, names)
        wanted = {v for k, v in names.items() if (k == "all") == (level == 0) and (level == 2) == (len(k) == 2 and not isinstance(k, str))}
        now = {g: m for g, m in now.items() if g in wanted}
        before: dict[int, float] = {}
        moving = now
        while moving:  # a group stands still once its determinant doesn't fall any more
            step = _step(stats, names, moving)
            det = {g: float(np.linalg.slogdet(m[D:].reshape(D, D))[1]) for g, (m, _) in step.items()}
            now |= {g: m for g, (m, _) in step.items()}
            moving = {g: now[g] for g in step if det[g] < before.get(g, math.inf) - 1e-3}
            before = det
        for g, (_, median) in _step(stats, names, now).items():
            found[g] = now[g][:D], np.linalg.inv(now[g][D:].reshape(D, D)), max(median, 1e-6) / MEDIAN
    if 0 in found and stats.limit(MIN_ROWS).count() < MIN_ROWS:
        del found[0]
    return own, found


def flag_outliers(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(doc_id, n_words, distance: robust and scaled, keep) for every row of docs."""
    docs = narrowed(docs, doc_id="long", text="string", lang="string", source="string")
    stats = scratch(docs.mapInArrow(_measure, _STATS), "statistics")
    groups = stats.groupBy("lang", "source").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS)
    rows = groups.orderBy(F.desc("n"), "lang", "source").limit(MAX_GROUPS + 1).collect()
    langs = stats.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS).orderBy("lang").collect()

    def orphans(small: DataFrame) -> set:
        return {r.lang for r in small.select("lang").distinct().collect()}

    def same(of: DataFrame) -> Column:
        return F.col("lang").eqNullSafe(of["l"]) & F.col("source").eqNullSafe(of["s"])

    if len(rows) <= MAX_GROUPS:
        small = stats
        if rows:
            named = stats.sparkSession.createDataFrame([(r.lang, r.source) for r in rows], "l string, s string")
            small = stats.join(F.broadcast(named), same(named), "left_anti")
        return _judge(stats, estimate_groups(stats, rows, langs, orphans(small)), limit)

    groups = scratch(groups, "groups")
    passes = -(-groups.count() // MAX_GROUPS)
    named = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.expr(f"pmod(xxhash64(lang, source), {passes})").alias("pass"))
    tagged = scratch(stats.join(named, same(named), "left").select(*stats.columns, "pass"), "passes")
    small = tagged.where("pass is null").select(stats.columns)
    out = scratch(_judge(small, estimate_groups(stats, [], langs, orphans(small)), limit), "judged")
    for k in range(passes):
        mine, names = tagged.where(F.col("pass") == k).select(stats.columns), groups.where(F.expr(f"pmod(xxhash64(lang, source), {passes})") == k).orderBy("lang", "source").collect()
        if names:
            out = out.unionByName(scratch(_judge(mine, estimate_groups(mine, names, langs, set()), limit), "judged"))
    return out


def _judge(stats: DataFrame, estimates: tuple, limit: float) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(estimates)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            code, x = _codes(batch, own), _matrix(batch.column("x"))
            distance = np.full(len(code), np.nan)
            for g, mine in _by_group(code):
                if g in found:
                    mean, inverse, scale = found[g]
                    distance[mine] = squared(x[mine], mean, inverse) / scale
            known = ~np.isnan(distance)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "distance": pa.array(np.sqrt(np.maximum(distance, 0)), mask=~known), "keep": pa.array(~known | (np.nan_to_num(distance) <= limit**2))})

    return stats.mapInArrow(judged, "doc_id long, n_words long, distance double, keep boolean")
