"""Toxicity: a sentence classifier regularised by counterfactuals.

A document is as toxic as its worst sentence.  A sentence's logit is a bias plus the weights of its distinct words and of their
beginnings of 5, 6 and 7 bytes (so that a stem counts whatever its ending; identity terms have none); it is fitted on a bounded sample of labelled documents by the log loss of each document's worst sentence, both classes weighing the same.  In every labelled sentence that mentions a group, the identity term is swapped for each other term of its kind
(one faith for another, one gender for another), and the squared change of the logit is penalised: the weights of a kind's
terms are drawn together, so that naming a group doesn't move the score.  A term that has no labelled sentence of its own keeps
weight zero.  The threshold is the one of best F1 on held-out documents.

Words are known by 64-bit hashes, so words outside the vocabulary never share a weight with one inside it.  The model's size is
bounded by the sample; scoring is one pass without a shuffle.

Defined results: a null or wordless text has no sentence and the probability of the bias alone, below any threshold; without
labels of both kinds probabilities are null and nothing is toxic; a null doc_id is scored and carried; repeated rows get equal
scores; of sentences with equal scores the first is the worst; labels that repeat or contradict each count; a text of any length is read whole, sentences of over 64 words in
parts of 64; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import discard, narrowed, pieces, scratch
from .decontamination import Lookup

SAMPLE, LONGEST = 6000, 64
#: Of the sample's words those enter the model that are in so many toxic documents, and whose smoothed log ratio of shares starts that far from zero.
MIN_DOCUMENTS, MIN_WEIGHT = 3, 0.3
PIECE = 4 << 20

#: Terms that name groups, by kind; a term is swapped for others of its kind.
IDENTITY: dict[str, list[str]] = {
    "faith": "muslim muslims christian christians jewish jew jews hindu hindus buddhist buddhists sikh sikhs catholic catholics protestant atheist atheists".split(),
    "gender": "woman women man men girl girls boy boys female male nonbinary transgender trans cisgender".split(),
    "origin": "african american asian arab arabs mexican mexicans chinese indian european immigrant immigrants migrant refugee refugees black white latino latina hispanic roma turkish polish".split(),
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer lgbt".split(),
    "ability": "disabled deaf blind autistic handicapped paralyzed".split(),
    "age": "old young elderly teenage senior".split(),
    # the same kinds in German, French and Spanish; a term is swapped within its language
    "faith de": "muslim muslime muslimin muslimische christ christen christin christliche jude juden jüdin jüdische hindu hindus buddhist buddhisten katholik katholiken protestant protestanten atheist atheisten".split(),
    "gender de": "frau frauen mann männer mädchen junge jungen weiblich männlich nichtbinär trans".split(),
    "origin de": "afrikaner araber türke türken türkisch pole polen chinese chinesen inder europäer einwanderer migrant migranten flüchtling flüchtlinge geflüchtete roma sinti".split(),
    "orientation de": "schwul schwule lesbisch lesben bisexuell heterosexuell homosexuell queer".split(),
    "ability de": "behindert behinderte taub blind autistisch gelähmt".split(),
    "faith fr": "musulman musulmans musulmane chrétien chrétiens chrétienne juif juifs juive hindou hindous bouddhiste bouddhistes catholique catholiques protestant protestants athée athées".split(),
    "gender fr": "femme femmes homme hommes fille filles garçon garçons masculin féminin trans".split(),
    "origin fr": "africain africains arabe arabes asiatique asiatiques chinois indien européen immigré immigrés migrant migrants réfugié réfugiés noir noirs blanc blancs turc turcs polonais".split(),
    "orientation fr": "gay lesbienne lesbiennes bisexuel hétérosexuel homosexuel homosexuels queer".split(),
    "ability fr": "handicapé handicapés sourd sourds aveugle aveugles autiste autistes".split(),
    "faith es": "musulmán musulmanes musulmana cristiano cristianos cristiana judío judíos judía hindú hindúes budista budistas católico católicos protestante protestantes ateo ateos".split(),
    "gender es": "mujer mujeres hombre hombres niña niñas niño niños femenino masculino trans".split(),
    "origin es": "africano africanos árabe árabes asiático asiáticos chino chinos indio europeo inmigrante inmigrantes migrante migrantes refugiado refugiados negro negros blanco blancos turco turcos polaco gitano gitanos".split(),
    "orientation es": "gay lesbiana lesbianas bisexual heterosexual homosexual homosexuales queer".split(),
    "ability es": "discapacitado discapacitados sordo sordos ciego ciegos autista autistas".split(),
}


def hash_of(words: list[str]) -> np.ndarray:
    return bs.words(pa.array(words, pa.string()))[1]


PREFIXES = (5, 6, 7)
_TERMS = np.zeros(0, np.uint64)


def identity_hashes() -> np.ndarray:
    global _TERMS
    if not len(_TERMS):
        _TERMS = np.unique(np.concatenate([hash_of(t) for t in IDENTITY.values()]))
    return _TERMS


def sentence_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence, row of each sentence) of the words of each sentence and their beginnings; sentences count on over the batch."""
    data, offsets = bs.buffer_of(bs.lowered(texts))
    runs = bs.Runs(data, offsets, words_only=True)
    if not len(runs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10), dtype=np.int32)
    at = ends[runs.start]
    new = np.empty(len(runs), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (runs.row[1:] != runs.row[:-1])
    begin = np.flatnonzero(new)
    place = np.arange(len(runs)) - begin[np.cumsum(new) - 1]
    new |= place % LONGEST == 0
    sentence = np.cumsum(new) - 1
    rows = runs.row[new]
    h = runs.hashes()
    terms = identity_hashes()
    plain = terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] != h
    length = runs.end - runs.start
    hashes, where = [h], [sentence]
    for k in PREFIXES:
        long = np.flatnonzero((length > k) & plain)
        hashes.append(bs.mix(bs.span_hashes(data, runs.start[long], runs.start[long] + k) + np.uint64(k)))
        where.append(sentence[long])
    return np.concatenate(hashes), np.concatenate(where), rows


@dataclass
class Model:
    words: np.ndarray  # hashes in order
    weight: np.ndarray
    bias: float
    threshold: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lookup = model, Lookup(model.words)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each row, its worst sentence or -1)."""
        h, sentence, rows = sentence_words(texts)
        n = len(texts)
        p = np.full(n, min(self.model.bias, -1.0))
        worst = np.full(n, -1, np.int32)
        if len(rows):
            code = self.lookup(h)
            known = np.flatnonzero(code >= 0)
            # distinct words of a sentence: order by sentence is there, so sort by word within
            key = sentence[known] * np.int64(len(self.model.words)) + code[known]
            key = np.unique(key)
            total = np.bincount(key // len(self.model.words), self.model.weight[key % len(self.model.words)], minlength=len(rows)) + self.model.bias
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            top = np.maximum.reduceat(total, first)
            have = rows[first]
            p[have] = top
            count = np.diff(np.append(first, len(rows)))
            is_top = np.flatnonzero(total >= np.repeat(top, count))
            k = np.searchsorted(is_top, first)
            worst[have] = is_top[k] - first
        return 1 / (1 + np.exp(-np.clip(p, -30, 30))), worst


def swaps(vocabulary: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term there, term in its place), as indexes of the vocabulary, for every identity mention and other term of its kind."""
    there, instead = [], []
    for terms in IDENTITY.values():
        kind = np.searchsorted(vocabulary, np.sort(hash_of(terms)))
        seen = code[np.isin(code, kind)]
        there.append(np.repeat(seen, len(kind)))
        instead.append(np.tile(kind, len(seen)))
    a, b = np.concatenate(there), np.concatenate(instead)
    return a[a != b], b[a != b]


def parts(y: np.ndarray, have: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(which documents train, which are held out), among those that have words."""
    order = np.random.default_rng(seed).permutation(have)
    held = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    mask = np.zeros(len(y), bool)
    mask[have] = True
    mask[held] = False
    if len(set(y[mask].tolist())) < 2:
        mask[held], held = True, held[:0]
    return mask, held


def vocabulary(y: np.ndarray, words_of: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of what speaks for or against toxicity, and of the identity terms; weights to start from: smoothed log ratios of document shares)."""
    terms = identity_hashes()
    toxic = [w for w, k, m in zip(words_of, y, mask) if m and k == 1]
    clean = [w for w, k, m in zip(words_of, y, mask) if m and k == 0]
    names, pos = np.unique(np.concatenate([*toxic, np.zeros(0, np.uint64)]), return_counts=True)
    seldom = pos < min(MIN_DOCUMENTS, len(toxic))
    names, pos = names[~seldom], pos[~seldom]
    neg = np.zeros(len(names), np.int64)
    for w in clean:
        at = np.searchsorted(names, w)
        at = at[at < len(names)] if not len(names) else np.minimum(at, len(names) - 1)
        if len(names):
            neg[at[names[at] == w]] += 1
    weight = np.clip(np.log((pos / max(1, len(toxic)) + 0.002) / (neg / max(1, len(clean)) + 0.002)), -1, 3)
    keep = (np.abs(weight) >= MIN_WEIGHT) & ~np.isin(names, terms)
    words = np.concatenate([names[keep], terms])
    o = np.argsort(words)
    return words[o], np.concatenate([weight[keep], np.zeros(len(terms))])[o]


def encoded(h: np.ndarray, sentence: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(code, sentence) of the words inside the vocabulary, each once a sentence; the number of sentences."""
    n = int(sentence.max()) + 1 if len(sentence) else 0
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    inside = words[at] == h
    key = np.unique(sentence[inside].astype(np.int64) * len(words) + at[inside])
    return (key % len(words)).astype(np.int32), (key // len(words)).astype(np.int32), n


def fit_encoded(y: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray, int]], words: np.ndarray, weight: np.ndarray, mask: np.ndarray, held: np.ndarray, counterfactual: float = 4.0, ridge: float = 1.0, steps: int = 300) -> Model:
    step = np.array([d[2] for d in docs], np.int64)
    sizes = np.array([len(d[0]) for d in docs])
    code = np.concatenate([d[0] for d in docs]).astype(np.int64)
    sentence = np.concatenate([d[1] for d in docs]) + np.repeat(np.cumsum(step) - step, sizes)
    s_doc = np.repeat(np.arange(len(docs)), step)
    first = np.searchsorted(sentence, np.arange(len(s_doc) + 1))
    s_first = np.searchsorted(s_doc, np.arange(len(docs) + 1))
    have = np.flatnonzero(step)
    cost = np.where(y == 1, 0.5 / max(1, (y[mask] == 1).sum()), 0.5 / max(1, (y[mask] == 0).sum())) * mask
    bias = -1.0
    a, b = swaps(words, code[mask[s_doc[sentence]]]) if counterfactual else (np.zeros(0, np.int64),) * 2

    def tops(w: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(sentence, w[code], minlength=len(s_doc)) + c
        top = np.maximum.reduceat(total, s_first[:-1][have])
        is_top = np.flatnonzero(total >= np.repeat(top, np.diff(s_first)[have]))
        return top, is_top[np.searchsorted(is_top, s_first[:-1][have])]

    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for k in range(1, steps + 1):
        top, best = tops(weight, bias)
        g = (1 / (1 + np.exp(-np.clip(top, -30, 30))) - y[have]) * cost[have]
        n = first[best + 1] - first[best]
        span = np.repeat(first[best] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        grad = np.bincount(code[span], np.repeat(g, n), minlength=len(words)) + ridge / len(words) * weight
        if len(a):
            change = (weight[a] - weight[b]) * (2 * counterfactual / len(a))
            grad += np.bincount(a, change, minlength=len(words)) - np.bincount(b, change, minlength=len(words))
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-7)
        weight, bias = weight - move[:-1], bias - move[-1]
    top, _ = tops(weight, bias)
    threshold = 0.5
    if len(held):
        out = np.zeros(len(docs), bool)
        out[held] = True
        p, truth = 1 / (1 + np.exp(-np.clip(top[out[have]], -30, 30))), y[have][out[have]] == 1

        def f1(t: float) -> float:
            hit = (p >= t) & truth
            return 2 * hit.sum() / max(1, (p >= t).sum() + truth.sum())

        grid = np.linspace(0.2, 0.9, 71)
        scores = np.array([f1(t) for t in grid])
        if scores.max() > 0:
            best_at = np.flatnonzero(scores >= scores.max() - 1e-12)
            threshold = float(grid[best_at[len(best_at) // 2]])
    return Model(words, weight, float(bias), threshold)


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], counterfactual: float = 4.0) -> Model | None:
    """docs: (label, hashes, sentence numbers) of each labelled document. None without both kinds."""
    y = np.array([d[0] for d in docs], np.float64)
    have = np.array([k for k, d in enumerate(docs) if len(d[1])], np.int64)
    if not len(have) or y[have].min() == y[have].max():
        return None
    mask, held = parts(y, have)
    words, weight = vocabulary(y, [np.unique(d[1]) for d in docs], mask)
    return fit_encoded(y, [encoded(d[1], d[2], words) for d in docs], words, weight, mask, held, counterfactual)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counterfactual: float = 4.0) -> Model | None:
    """Fits on at most `sample` labelled documents, the first in order of the hash of their id.

    Their distinct words come to the driver, which picks the vocabulary; then their sentences, in that vocabulary alone."""
    chosen = (
        narrowed(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    )
    docs = narrowed(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")
    rows = scratch(docs, "labelled")
    order = lambda r: (r.doc_id, r.toxic, r.h)  # noqa: E731  the order tasks end in must not matter

    def per_document(piece: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h, sentence, row_of = sentence_words(piece.column("text"))
        o = np.argsort(sentence, kind="stable")
        h, sentence = h[o], sentence[o]
        row = row_of[sentence] if len(row_of) else sentence
        cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield h[lo:hi], sentence[lo:hi] - (sentence[lo] if hi > lo else 0)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            out = [np.unique(h).tobytes() for h, _ in per_document(piece)]
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "toxic": piece.column("toxic"), "h": piece.column("h"), "words": pa.array(out, pa.binary())})

    found = sorted(rows.mapInArrow(distinct, "doc_id long, toxic int, h long, words binary").collect(), key=order)
    y = np.array([r.toxic for r in found], np.float64)
    have = np.array([k for k, r in enumerate(found) if len(r.words)], np.int64)
    if not len(have) or y[have].min() == y[have].max():
        discard(rows)
        return None
    mask, held = parts(y, have)
    words, weight = vocabulary(y, [np.frombuffer(r.words, np.uint64) for r in found], mask)
    del found

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            out = [encoded(h, s, words) for h, s in per_document(piece)]
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "toxic": piece.column("toxic"), "h": piece.column("h"), "codes": pa.array([c.tobytes() for c, _, _ in out], pa.binary()), "sentences": pa.array([s.tobytes() for _, s, _ in out], pa.binary()), "n": pa.array([n for _, _, n in out], pa.int32())})

    found = sorted(rows.mapInArrow(codes, "doc_id long, toxic int, h long, codes binary, sentences binary, n int").collect(), key=order)
    discard(rows)
    return fit_encoded(y, [(np.frombuffer(r.codes, np.int32), np.frombuffer(r.sentences, np.int32), r.n) for r in found], words, weight, mask, held, counterfactual)


_SCORED = "doc_id long, p_toxic double, sentence int, toxic boolean"


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, only_toxic: bool = False) -> DataFrame:
    """(doc_id, p_toxic, sentence: its worst one, toxic) for every row of docs, or for the toxic ones only."""
    docs = narrowed(docs, doc_id="long", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = model.scorer() if model else None
        for piece in pieces(batches, "text", PIECE):
            n = piece.num_rows
            if scorer is None:
                p, worst, toxic = pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), np.zeros(n, bool)
            else:
                values, at = scorer(piece.column("text"))
                toxic = (values >= model.threshold) & (at >= 0)
                p, worst = pa.array(values), pa.array(at, pa.int32(), mask=at < 0)
            out = pa.record_batch({"doc_id": piece.column("doc_id"), "p_toxic": p, "sentence": worst, "toxic": pa.array(toxic)})
            yield out.filter(pa.array(toxic)) if only_toxic else out

    return docs.mapInArrow(scored, _SCORED)


def find_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The toxic documents."""
    return score_toxicity(docs, labels, sample, only_toxic=True)
