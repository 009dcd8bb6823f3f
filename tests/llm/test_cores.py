"""The operators' cores against brute force, without Spark."""

import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseflow.llm import bytescan as bs
from clauseflow.llm import html_extract, ngram_join, outliers, quality_classifier, secret_scan, token_counts, toxicity

WORDY = st.text("ab é.ñ\n_1!漢", max_size=40)


def words(text):
    return re.findall(rb"[0-9a-z_\x80-\xff]+", text.lower().encode())


@given(st.lists(st.one_of(st.none(), WORDY), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_a_regular_expression(texts):
    runs, h = bs.words(pa.array(texts, pa.string()))
    mine = [w for t in texts for w in words(t or "")]
    assert [runs.data[a:b].tobytes() for a, b in zip(runs.start, runs.end)] == mine
    assert runs.counts.tolist() == [len(words(t or "")) for t in texts]
    assert len(set(h.tolist())) == len(set(mine))


# --- token counts


def greedy(word, vocabulary):
    n = at = 0
    longest = max(map(len, vocabulary))
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + k] in vocabulary:
                break
        else:
            return 1
        at, n = at + k, n + 1
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=12), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_automaton_counts_greedy_pieces(vocabulary, given_words):
    vocabulary = {v.encode() for v in vocabulary}
    counter = token_counts.Counter(token_counts.build(sorted(vocabulary)))
    raw = [w.encode() for w in given_words]
    data = np.frombuffer(b"".join(raw) or b"x", np.uint8)
    end = np.cumsum([len(w) for w in raw])
    start = end - [len(w) for w in raw]
    want = [greedy(w, vocabulary) for w in raw]
    assert counter.many(data, start, end).tolist() == want
    assert [counter.one(w) for w in raw] == want


@pytest.mark.parametrize("path", [token_counts.VOCABULARY, "/opt/tokenizers/piece_bpe_32k.model"])
def test_automaton_with_public_vocabularies(path):
    vocabulary = token_counts.load_vocabulary(path)
    counter, known = token_counts.Counter(token_counts.build(vocabulary)), set(vocabulary)
    text = "The quick brown fox, jumping over ünïcödé dogs at 12:30!  internationalization" + "x" * 300
    data, start, end, n = token_counts.words_of(pa.array([text]))
    raw = data.tobytes()
    assert counter.many(data, start, end).tolist() == [greedy(raw[a:b], known) for a, b in zip(start, end)]
    assert n.tolist() == [len(start)]


# --- HTML extraction


@given(st.integers(1, 9).flatmap(lambda n: st.tuples(st.lists(st.floats(-3, 3), min_size=n, max_size=n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0.01, 2)), max_size=14))))
@settings(max_examples=300, deadline=None)
def test_minimum_cut_is_the_least_labelling(case):
    gain, edges = case
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges if a != b]

    def cost(label):
        return sum(-g if g < 0 and k else g if g > 0 and not k else 0 for g, k in zip(gain, label)) + sum(w for a, b, w in edges if label[a] != label[b])

    best = min(cost(x) for x in itertools.product((0, 1), repeat=len(gain)))
    found = html_extract.minimum_cut(np.array(gain), edges)
    assert set(found.tolist()) <= {0, 1}
    assert cost(found.tolist()) == pytest.approx(best, abs=1e-6)


def test_blocks_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
    <!-- <p>no</p> --><article><h1>Big &amp; bold</h1><p>One <b>two</b><br>three<p>four</article><script>var x = "<p>";</script><footer>&copy; me</footer>"""
    blocks = html_extract.blocks_of(page)
    assert [b.text for b in blocks] == ["Home", "Big & bold", "One two", "three", "four", "© me"]
    assert [b.landmark for b in blocks] == [0, 1, 1, 1, 1, 0]
    assert [b.linked for b in blocks] == [4, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("page", ["", " ", "plain", "<p", "<script>x", "</p></p>", "<p><p><p>", "<!--", "<a href='>", "&amp;&bogus;"])
def test_broken_markup_is_read(page):
    n, kept, text = html_extract.extract(page, html_extract.PRIOR)
    assert 0 <= kept <= n


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>T</title><body><p>text", ["text"]),
        ("<head><meta charset='u'><title>a <b> c</title><script>'<p>'</script><style>p{}</style><p>one<p>two", ["one", "two"]),
        ("<head><title>T</title>bare text<p>more</p>", ["bare text", "more"]),
        ("<head><title>T<body><p>text", ["text"]),
        ("<head><link rel=x><noscript><p>hidden</p></noscript></head><body><p>text", ["text"]),
        ("<p>one <svg class='x'/> two</p><p>three</p><svg><text>hidden</text></svg><p>four", ["one two", "three", "four"]),
        ("<p>one</p><svg><p>two</p><template><p>three</p><noscript><p>four", ["one", "two", "three", "four"]),
        ("<p>one</p><template><p>hidden</p></template><header>two</header><style>three", ["one", "two"]),
    ],
)
def test_only_what_is_hidden_is_left_out(page, texts):
    assert [b.text for b in html_extract.blocks_of(page)] == texts


# --- secrets


def test_secrets_are_found_and_names_are_not():
    random.seed(1)
    key = "".join(random.choices("0123456789abcdef", k=40))
    other = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
    texts = [
        f'some prose token = "{key}" and more',
        f"AWS_SECRET_ACCESS_KEY={other}",
        f"token: {key}\nagain token: {key}",
        f"checksum of the file is {key}",
        "password = getAuthenticationTokenFromEnvironment",
        'token = "your_api_key_here_placeholder"',
        "secret: xxxxxxxxxxxxxxxxxxxxxxxx",
        None,
        "",
    ]
    found = list(secret_scan.secrets_in(pa.array(texts, pa.string())))
    assert [(r, n) for r, _, n, *_ in found] == [(0, 40), (1, 32), (2, 40), (2, 40)]
    for r, start, n, *_ in found:
        assert texts[r].encode()[start : start + n].decode() in (key, other)


def test_long_names_give_their_context_to_the_value():
    random.seed(2)
    key = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    names = ["aws_secret_access_key", "github_access_token", "client_secret_value", "stripe_secret_key", "database_password", "DJANGO_SECRET_KEY"]
    texts = [form.format(n, key) for n in names for form in ("{} = {}", "{}: {}", '{{"{}": "{}"}}')] + [f"token /some/long/path/name {key}"]
    found = list(secret_scan.secrets_in(pa.array(texts, pa.string())))
    assert [r for r, *_ in found] == list(range(len(texts)))
    assert {texts[r].encode()[start : start + n].decode() for r, start, n, *_ in found} == {key}


def test_names_whose_sensitive_word_is_not_first():
    random.seed(4)
    key = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    names = ["DB_PASSWORD", "OPENAI_API_KEY", "MY_SECRET", "refresh_token", "S3_BUCKET2_SECRET", "https://example.org/cb?access_token", "--env=DB_PASSWORD", "A_NAME_OF_MORE_THAN_FORTY_SIGNS_FOR_THE_DATABASE_PASSWORD"]
    texts = [f"{n}={key}" for n in names] + [f"MY_SECRET={key}=="]
    found = list(secret_scan.secrets_in(pa.array(texts, pa.string())))
    assert [r for r, *_ in found] == list(range(len(texts)))
    assert {texts[r].encode()[start : start + n].decode().rstrip("=") for r, start, n, *_ in found} == {key}
    assert not list(secret_scan.secrets_in(pa.array([f"COLOUR={key}", f"{key}==", "MY_SECRET=getAuthenticationTokenFromEnvironment"])))


def test_a_secret_takes_its_context_with_it():
    random.seed(3)
    key, sum_ = ("".join(random.choices("0123456789abcdef", k=40)) for _ in range(2))
    assert [n for _, _, n, *_ in secret_scan.secrets_in(pa.array([f"token: {key} {sum_}"]))] == [40]


@given(st.lists(st.text("aZ9-_ \n.é", max_size=30), max_size=5), st.integers(2, 6))
@settings(max_examples=100, deadline=None)
def test_candidates_are_maximal_runs(texts, least):
    data, offsets = bs.buffer_of(pa.array(texts, pa.string()))
    row, start, end = secret_scan.candidates(data, offsets, least)
    got = [(r, data[a:b].tobytes()) for r, a, b in zip(row.tolist(), start, end)]
    assert got == [(k, m) for k, t in enumerate(texts) for m in re.findall(rb"[A-Za-z0-9+/=_.~-]{%d,}" % least, t.encode())]


# --- outliers


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert outliers.chi_square_quantile(0.5, 8) == pytest.approx(7.344, abs=1e-3)


def test_fast_mcd_withstands_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, outliers.D))
    x[:80] += 12
    mean, cov = outliers.fast_mcd(x)
    assert np.abs(mean).max() < 0.4
    d = outliers.squared(x, mean, np.linalg.inv(cov))
    assert d[:80].min() > d[80:].max()


def test_statistics_of_odd_texts():
    x = outliers.statistics(pa.array([None, "", " \n", "A" * 100_000, "a line\n" * 50, "1 2 3"], pa.string()))
    assert x.shape == (6, outliers.D) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    assert x[4, 6] > 0.8 > 0.2 > x[5, 6]


# --- toxicity


def sentences(texts):
    out = []
    h, s, rows = toxicity.sentence_words(pa.array(texts, pa.string()))
    row = rows[s] if len(rows) else s
    for k in range(len(texts)):
        mine = row == k
        out.append((h[mine], s[mine] - (s[mine][0] if mine.any() else 0)))
    return out


def labelled(n=400, seed=2):
    """Insults make a sentence toxic; mentions of one faith come with them more often than chance."""
    rng = random.Random(seed)
    plain = [f"w{k}" for k in range(60)]
    texts, y = [], []
    for k in range(n):
        toxic = k % 4 == 0
        group = rng.choice(["muslim", "muslim", "christian"]) if toxic else rng.choice(["christian", "jewish", "hindu"])
        body = [" ".join(rng.choices(plain, k=8)) for _ in range(5)]
        body.append(f"the {group} neighbour is {'an idiot' if toxic else 'at home'} today")
        rng.shuffle(body)
        texts.append(". ".join(body))
        y.append(int(toxic))
    return texts, y


def scores(model, texts):
    return toxicity.Scorer(model)(pa.array(texts, pa.string()))


def test_counterfactuals_lower_the_score_of_neutral_mentions():
    texts, y = labelled()
    docs = [(k, h, s) for k, (h, s) in zip(y, sentences(texts))]
    fair, plain = toxicity.fit(docs), toxicity.fit(docs, counterfactual=0)
    neutral = ["the muslim neighbour is at home today"]
    other = ["the christian neighbour is at home today"]

    def gap(m):
        return abs(scores(m, neutral)[0][0] - scores(m, other)[0][0])

    assert gap(fair) < 0.05 and gap(fair) < gap(plain)
    held, truth = labelled(200, seed=9)
    p, _ = scores(fair, held)
    assert ((p >= fair.threshold) == (np.array(truth) == 1)).mean() > 0.98


def test_the_worst_sentence_counts():
    texts, y = labelled()
    model = toxicity.fit([(k, h, s) for k, (h, s) in zip(y, sentences(texts))])
    p, worst = scores(model, ["w1 w2 w3. " * 2000 + "the neighbour is an idiot", "w1 w2 w3. " * 2000, "", None])
    assert p[0] >= model.threshold and worst[0] == 2000
    assert (p[1:] < model.threshold).all() and worst[2] == worst[3] == -1


def test_labels_of_one_kind_fit_nothing():
    (h, s), = sentences(["a b c"])
    assert toxicity.fit([(1, h, s)]) is None and toxicity.fit([]) is None


# --- n-gram join


def most_memory(work):
    """(result, most MB held while working)."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_sets_in_many_fragments_are_sorted_in_little_memory():
    rng = np.random.default_rng(5)
    kind = pa.list_(pa.struct([("fragment", pa.int32()), ("grams", pa.binary()), ("classes", pa.binary())]))
    few = [[{"fragment": k, "grams": rng.bytes(5 * (1 + k % 3)), "classes": bytes([k % 24] * (1 + k % 3))} for k in range(n)] for n in (1, 300, 461)]
    few[1].append({"fragment": -1, "grams": rng.bytes(8 * 7), "classes": None})

    def keys(segments):
        out = []
        for s in segments:
            if s["fragment"] < 0:
                out += np.frombuffer(s["grams"], np.uint64).tolist()
            for c, k in zip(s["classes"] or b"", range(0, len(s["grams"]), 5)):
                h = (s["fragment"] << 40) | int.from_bytes(s["grams"][k : k + 5], "little")
                out.append(int(ngram_join._key(np.array([c], np.uint8), np.array([h], np.uint64))[0]))
        return sorted(out)

    segments = pa.concat_arrays([pa.array(few, kind)] * 200)
    batch = pa.record_batch({"sig": pa.array(range(600)), "size": pa.array([500] * 600, pa.int32()), "segments": segments})
    out, most = most_memory(lambda: pa.Table.from_batches(list(ngram_join._sort_sets(iter([batch.slice(1)])))))
    assert out.column("sig").to_pylist() == list(range(1, 600))
    want = [keys(x) for x in few]
    for k, raw in enumerate(out.column("keys").to_pylist()[:9]):
        assert np.frombuffer(raw, np.uint64).tolist() == want[(k + 1) % 3]
    assert most < 40


def test_candidates_of_a_dense_part_leave_in_parts():
    n = 3000  # sets that all share one n-gram
    values = (np.arange(n) * 7, np.full(n, 9), np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n), np.arange(n) * 7, np.zeros(n), np.ones(n))
    names = [x.split()[0] for x in ngram_join._PREFIXES.split(", ")]
    rows = {"part": pa.array([0], pa.int32())} | {c: pa.array([v.astype(kind).tobytes()], pa.binary()) for c, v, kind in zip(names[1:], values, ngram_join._KINDS)}

    def work():
        pairs, batches = 0, 0
        for b in ngram_join._find_candidates(0.5)(iter([pa.record_batch(rows)])):
            assert b.num_rows <= 100_000 and (b.column("a").to_numpy() < b.column("b").to_numpy()).all()
            pairs, batches = pairs + b.num_rows, batches + 1
        return pairs, batches

    (pairs, batches), most = most_memory(work)
    assert pairs == n * (n - 1) // 2 and batches > 1 and most < 250


class Held:
    """A broadcast of a test."""

    def __init__(self, *value):
        self.value = tuple(np.array(v, kind) for v, kind in zip(value, (np.uint64, np.uint8, np.int64)))


def entries_of(batches):
    """(list, set, place, side) of each entry of prefix batches, and the most entries in a batch."""
    out, most = [], 0
    for b in batches:
        columns = ngram_join._prefixes(pa.Table.from_batches([b]))
        most = max(most, len(columns[0]))
        out += zip(*(columns[k].tolist() for k in (4, 0, 2, 5)))
    return out, most


def test_prefixes_travel_in_small_batches():
    keys, n = np.arange(1, 401, dtype=np.uint64), 1200
    rows = {"sig": pa.array(range(n)), "size": pa.array([400] * n, pa.int32()), "keys": pa.array([keys.tobytes()] * n, pa.binary())}
    rows |= {c: pa.array([v] * n) for c, v in (("star", 5), ("near", 6), ("centre", 7))}
    sizes = [(b.nbytes, sum(len(x.as_buffer()) for x in b.column("lists")) // 8) for b in ngram_join._emit_prefixes(0.5, 64, Held([], [], []), 1000, True)(iter([pa.record_batch(rows)]))]
    assert sum(k for _, k in sizes) == n * 201 and max(b for b, _ in sizes) < 4 << 20


def test_prefixes_of_widespread_ngrams_leave_in_parts():
    tile, times = 1000, 64_000  # each entry is in 64 tiles
    hot = Held(range(1, 401), [24] * 400, [times] * 400)
    keys = np.sort(ngram_join._key(hot.value[1], hot.value[0]))
    n = 150
    rows = {"sig": pa.array(range(n)), "size": pa.array([400] * n, pa.int32()), "keys": pa.array([keys.tobytes()] * n, pa.binary())}
    rows |= {c: pa.array([v] * n) for c, v in (("star", 5), ("near", 6), ("centre", 7))}
    batch = pa.record_batch(rows)

    def work():
        entries = big = 0
        for b in ngram_join._emit_prefixes(0.5, 16, hot, tile, True)(iter([batch])):
            here = sum(len(x.as_buffer()) for x in b.column("lists")) // 8
            entries, big = entries + here, max(big, here)
        return entries, big

    (entries, big), most = most_memory(work)
    assert entries == n * 201 * 64 and big <= 200_000 and most < 100
    few = batch.slice(0, 20)
    whole, _ = entries_of(ngram_join._emit_prefixes(0.5, 16, hot, tile, True, 10**9)(iter([few])))
    parts, big = entries_of(ngram_join._emit_prefixes(0.5, 16, hot, tile, True, 1000)(iter([few])))
    assert sorted(parts) == sorted(whole) and big <= 1000
    lists = {}
    for name, sig, _, side in whole:
        lists.setdefault(name, []).append((sig, side))
    met = {}  # any two sets meet once over an n-gram, those of one tile or of two
    for members in lists.values():
        for a, x in members:
            for b, y in members:
                if a < b and (x == 0 or x != y):
                    met[a, b] = met.get((a, b), 0) + 1
    assert met == {(a, b): 201 for a in range(20) for b in range(a + 1, 20)}


def test_segments_of_a_large_block_leave_in_parts():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 64, 500, np.uint64) for _ in range(100)]
    cuts, shares = 60, 40
    batch = pa.record_batch({"block": pa.array([7] * 100), "cuts": pa.array([cuts] * 100, pa.int32()), "shares": pa.array([shares] * 100, pa.int32()), "sig": pa.array(range(100)), "size": pa.array([500] * 100, pa.int32()), "keys": pa.array([x.tobytes() for x in sets], pa.binary())})

    def work():
        rows, batches, got = 0, 0, {}
        for b in ngram_join._emit_segments(iter([batch])):
            rows, batches = rows + b.num_rows, batches + 1
            if batches == 1:
                for unit, sig, keys in zip(*(b.column(c).to_pylist()[: cuts * shares] for c in ("unit", "sig", "keys"))):
                    got[unit] = (sig, np.frombuffer(keys, np.uint64))
        return rows, batches, got

    (rows, batches, got), most = most_memory(work)
    assert rows == 100 * cuts * shares and batches > 1 and most < 40
    cut = ngram_join._cut_of(sets[0], cuts)
    for v in range(cuts):
        for k in range(shares):
            sig, keys = got[f"7/{v}/{k}"]
            assert sig == 0 and keys.tolist() == sets[0][cut == v].tolist()


def test_a_fragment_is_shared_in_little_memory():
    def fragment(sets, rows):
        """Rows of as many sets, a segment a set, and the n-grams of each set."""
        rng = np.random.default_rng(11)
        rows_, want = {c: [] for c in ("sigs", "counts", "grams")}, []
        for r in range(rows):
            n = rng.integers(1, 4, sets // rows)
            h = rng.integers(0, sets, int(n.sum()), np.uint64)
            sig = np.arange(len(n)) + r * len(n)
            if r == rows - 1:  # a set again, as another batch has it
                n, h, sig = np.append(n, want[0][1].size), np.append(h, want[0][1]), np.append(sig, want[0][0])
            rows_["sigs"].append(sig.astype(np.int64).tobytes())
            rows_["counts"].append(n.astype(np.uint16).tobytes())
            rows_["grams"].append(ngram_join.packed(h))
            want += zip(sig.tolist(), np.split(h, np.cumsum(n)[:-1]))
        t = pa.table({"fragment": pa.array([3] * rows, pa.int32()), "sigs": pa.array(rows_["sigs"], pa.binary()), "sizes": pa.array([b""] * rows, pa.binary()), "counts": pa.array(rows_["counts"], pa.binary()), "grams": pa.array(rows_["grams"], pa.binary())})
        return t, dict(want)

    t, sets = fragment(3000, 6)
    times = {}
    for grams in sets.values():
        for h in grams.tolist():
            times[h] = times.get(h, 0) + 1
    want = {(s, h, int(np.log2(times[h]))) for s, grams in sets.items() for h in grams.tolist() if times[h] > 1}
    got = ngram_join._share((pa.scalar(3),), t).to_pylist()
    assert {(r["sig"], h, c) for r in got for h, c in zip(ngram_join.unpacked(r["grams"]).tolist(), r["classes"])} == want
    assert all(r["shared"] == len(r["classes"]) for r in got)
    t, _ = fragment(500_000, 200)
    _, most = most_memory(lambda: ngram_join._share((pa.scalar(3),), t))
    assert most < 65


@pytest.mark.parametrize("limit", [1, 50, 10**9])
def test_lists_by_parts_give_what_they_give_at_once(limit):
    rng = np.random.default_rng(8)
    n = 600
    sig = rng.integers(0, 60, n)
    star, near, centre = sig % 5, rng.integers(0, 40, 60)[sig], np.full(n, 50)
    lists = rng.integers(0, 40, n)
    values = (sig, 20 + sig % 7, rng.integers(0, 4, n), sig % 3, lists, np.zeros(n), star, near, centre)
    names = [x.split()[0] for x in ngram_join._PREFIXES.split(", ")]
    t = pa.table({"part": pa.array([0], pa.int32())} | {c: pa.array([v.astype(kind).tobytes()], pa.binary()) for c, v, kind in zip(names[1:], values, ngram_join._KINDS)})
    pairs = set()
    for b in ngram_join._find_candidates(0.5, limit=limit)(iter(t.to_batches())):
        pairs |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    place, size = values[2], values[1]
    want = set()
    for i in range(n):
        for j in range(n):
            if lists[i] == lists[j] and sig[i] < sig[j] and not (star[i] == star[j] and near[i] + near[j] >= centre[i]):
                if min(size[i] - place[i], size[j] - place[j]) >= ngram_join.needed(size[i : i + 1], size[j : j + 1], 0.5)[0]:
                    want.add((int(sig[i]), int(sig[j])))
    assert pairs == want
    got = {(r["sig"], r["centre"]): r["votes"] for r in ngram_join._elect(0.5, limit)(None, t).to_pylist()}
    votes = {}
    for name in set(lists.tolist()):
        members = np.flatnonzero(lists == name)
        first = min(members, key=lambda i: (values[3][i] / size[i], sig[i]))
        for i in members:
            if sig[i] != sig[first]:
                votes[int(sig[i]), int(sig[first])] = votes.get((int(sig[i]), int(sig[first])), 0) + 1
    assert got == votes


def test_a_part_of_many_lists_gives_candidates_in_little_memory():
    n = 600_000
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 60, n)
    values = (sig, np.full(n, 9), np.zeros(n), np.zeros(n), np.arange(n) // 2, np.zeros(n), sig, np.zeros(n), np.ones(n))
    names = [x.split()[0] for x in ngram_join._PREFIXES.split(", ")]
    rows = {"part": pa.array([0], pa.int32())} | {c: pa.array([v.astype(kind).tobytes()], pa.binary()) for c, v, kind in zip(names[1:], values, ngram_join._KINDS)}
    pairs, most = most_memory(lambda: sum(b.num_rows for b in ngram_join._find_candidates(0.5)(iter([pa.record_batch(rows)]))))
    assert pairs == n // 2 and most < 90


def test_context_sums_of_a_batch_take_little_memory():
    class Docs:
        """Takes the function that a plan would run."""

        def __getattr__(self, name):
            return self

        def broadcast(self, words):
            return type("Sent", (), {"value": words})()

        def mapInArrow(self, work, _):
            self.work = work
            return self

        select = groupBy = applyInArrow = lambda self, *_: self

        def collect(self):
            return []

    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 30_000, 700)) for _ in range(900)])
    h = bs.words(texts)[1]
    docs = Docs()
    quality_classifier.context_table(docs, np.unique(h))
    _, most = most_memory(lambda: sum(b.num_rows for b in docs.work(iter([pa.record_batch({"text": texts})]))))
    assert most < 74


def vectors_of(coder):
    rng = np.random.default_rng(6)
    return rng.normal(size=(coder.size, quality_classifier.DIMS)).astype(np.float32)


@given(st.lists(st.one_of(st.none(), st.text("ab !", max_size=60), st.sampled_from(["a " * 500, "a b " * 300])), max_size=6), st.integers(1, 40), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_contexts_and_features_are_those_of_loops_over_the_words(texts, span, slab):
    q = quality_classifier
    h, first = q.tokens(pa.array(texts, pa.string()))
    coder = q.Coder(np.unique(h)[::2])  # the other words share vectors
    code, index, table = coder(h), coder.index_table(), vectors_of(coder)
    wanted, mean_and_spread = np.zeros((coder.size, q.DIMS), int), np.zeros((len(texts), 2 * q.DIMS))
    for k, (lo, hi) in enumerate(itertools.pairwise(first)):
        own = code[lo:hi]
        for i, w in enumerate(own):
            for near in [*own[max(0, i - q.WINDOW) : i], *own[i + 1 : i + 1 + q.WINDOW]]:
                wanted[w] += index[near]
        if len(own):
            v = table[own].astype(float)
            mean_and_spread[k] = np.append(v.mean(0), v.std(0))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(q, "SPAN", span)
        m.setattr(q, "SLAB", slab)
        total = np.zeros_like(wanted)
        for own, sums in q.contexts(code, first, index):
            total[own] += sums
        mine = q.features(pa.array(texts, pa.string()), coder, table)
    alone = [q.features(pa.array([t], pa.string()), coder, table)[0] for t in texts]
    assert (total == wanted).all() and (np.reshape(alone, mine.shape) == mine).all()  # whatever texts are beside it
    np.testing.assert_allclose(mine**2, mean_and_spread**2, atol=1e-5)  # squares: a spread of nothing is a root of rounding


def test_contexts_at_their_largest_still_fit_a_byte():
    q = quality_classifier
    index = np.array([[q.NONZERO] * q.DIMS, [-q.NONZERO] * q.DIMS, [0] * q.DIMS], np.int8)  # all entries of a vector in one place
    for word, sign in ((0, 1), (1, -1)):
        ((own, sums),) = q.contexts(np.full(1000, word, np.int32), np.array([0, 1000]), index)
        assert own.tolist() == [word] and (sums == sign * q.NONZERO * (4 * 1000 - 6)).all()


def test_features_of_a_batch_take_little_memory():
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"w{k}" for k in rng.zipf(1.3, 700) % 30_000) for _ in range(300)] + ["some words " * 50_000])
    coder = quality_classifier.Coder(np.unique(bs.words(texts)[1]))
    table = vectors_of(coder)
    x, most = most_memory(lambda: quality_classifier.features(texts, coder, table))
    assert x.shape == (301, 2 * quality_classifier.DIMS) and most < 60


def test_features_of_a_batch_cost_little_beside_its_words():
    def seconds(work):
        times = []
        for _ in range(5):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        return min(times)

    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"w{k}" for k in rng.zipf(1.3, 600) % 30_000) for _ in range(400)])
    coder = quality_classifier.Coder(np.unique(bs.words(texts)[1]))
    table = vectors_of(coder)
    assert seconds(lambda: quality_classifier.features(texts, coder, table)) < 4 * seconds(lambda: coder(quality_classifier.tokens(texts)[0]))
