"""The operators on awkward rows, against brute force, and against exact round trips."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clauseflow.llm import common, decontamination, html_extract, mixing, ngram_join, outliers, quality_classifier, secret_scan, sharding, token_counts, toxicity
from clauseflow.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture()
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())


# --- n-gram join


def gram_sets(rows, n=3):
    out = defaultdict(set)
    for i, text in rows:
        w = words(text or "")
        if i is not None and w:
            out[i].add(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))))
    return out


def brute_pairs(rows, t=0.5):
    sets, out = gram_sets(rows), set()
    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            j = len(x & y) / len(x | y)
            if j >= t:
                out.add((a, b, len(x & y), round(j, 9)))
    return out


def brute_classes(rows, t=0.5):
    """(doc_id, class_id, n_copies, n_links) by comparing each two sets."""
    sets = gram_sets(rows)
    of = sorted({(i, x) for i, own in sets.items() for x in own} | {(i, (i,)) for i, text in rows if i is not None and not words(text or "")}, key=str)
    names = {x for _, x in of}
    near = {x: {y for y in names if isinstance(x, frozenset) and isinstance(y, frozenset) and x != y and len(x & y) / len(x | y) >= t} for x in names}
    out = []
    for i, x in of:
        reach, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        out.append((i, min(d for d, y in of if y in reach), sum(y == x for _, y in of), len(near[x])))
    return sorted(out)


def found_classes(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "n_copies", "n_links").collect())


@pytest.mark.parametrize("sizes", [{}, {"fragment": 1500, "cuts": 7, "hot": 1.1, "t": 0.3}, {"tile": 3, "fragment": 20_000}])
def test_join_equals_brute_force(docs, sizes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_classes(ngram_join.ngram_jaccard_join(docs, **sizes)) == brute_classes(rows, sizes.get("t", 0.5))


def test_join_of_awkward_rows(awkward, nothing, spark):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()] if len(set(awkward.columns)) == len(awkward.columns) else []
    got = found_classes(ngram_join.ngram_jaccard_join(awkward))
    assert got == brute_classes(rows) and (7, 1, 2, 0) in got
    assert found_classes(ngram_join.ngram_jaccard_join(nothing)) == []
    two = spark.createDataFrame([(1, "a b c d"), (1, "a b c d e"), (2, "a b c d")], "doc_id long, text string")
    assert found_classes(ngram_join.ngram_jaccard_join(two)) == [(1, 1, 1, 1), (1, 1, 2, 1), (2, 1, 2, 1)]


def test_join_of_many_copies(spark):
    base = "one two three four five six seven eight nine ten"
    rng = random.Random(7)
    rows = [(k, base) for k in range(60)] + [(100 + k, base + f" eleven{k}") for k in range(20)] + [(200, "nothing in common with those at all")]
    long = [f"w{k}" for k in range(60)]
    for k in range(80):  # near copies at all distances from their source
        own = list(long)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((300 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(ngram_join.ngram_jaccard_join(df, tile=4)) == brute_classes(rows)
    assert sorted(r.doc_id for r in ngram_join.drop_near_copies(df.where("doc_id <= 200")).collect()) == [0, 200]


def test_certain_links_are_not_formed_as_pairs(spark):
    """Near copies of one text that change one word each: their links follow from those with the text."""
    long = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w if i != k else f"new{k % 7}" for i, w in enumerate(long))) for k in range(150)] + [(999, " ".join(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, stars, found = ngram_join.similar_sets(df)
    assert stars.count() == 151 and stars.select("star").distinct().count() == 1 and found.count() == 0
    assert found_classes(ngram_join.ngram_jaccard_join(df)) == sorted((i, 0, 1, 150) for i, _ in rows)


def test_one_of_each_group_stays(docs, awkward):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, *_ in sorted(brute_pairs(rows)):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in ngram_join.drop_near_copies(docs).collect()) == sorted({root(i) for i, _ in rows})
    kept = ngram_join.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 2, 3, 4, 5, 6, None])
    same = awkward.sparkSession.createDataFrame([(None, "a b c d e", 1), (None, "a b c d e", 2), (None, None, 3), (None, "", 4), (None, None, 5), (None, "x y z w", 6), (9, "x y z w", 7)], "doc_id long, text string, _key int")
    out = [(r.doc_id, r.text) for r in ngram_join.drop_near_copies(same.drop("_key")).collect()]
    assert Counter(out) == Counter([(None, "a b c d e"), (None, None), (None, None), (None, ""), (9, "x y z w")])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(6)
    for few in (0, 2_000_000):
        got = {r.node: r.component for r in components(table, few=few).collect()}
        assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(table.limit(0)).count() == 0


# --- mixing


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 100, 1000):
        for key in (1, 2**63 + 5):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))) == list(range(n))


def test_blocks_hold_every_token_in_order(docs):
    out = mixing.mix_blocks(docs, block=64, slots=32)
    rows = out.collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source] += len((r.text or "").split())
    blocks = {s: math.ceil(n / 64) for s, n in tokens.items() if n}
    assert len(rows) == sum(blocks.values())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    first = defaultdict(set)
    for r in rows:
        assert 0 <= r.block < blocks[r.source] and len(r.text.split()) == r.n_tokens <= 64
        assert (r.turn, r.block) not in first[r.source]
        first[r.source].add((r.turn, r.block))
    share = Counter(r.source for r in rows)
    w = {s: tokens[s] ** mixing.TEMPERATURE for s in blocks}
    for s in blocks:
        p = w[s] / sum(w.values())
        assert abs(share[s] / len(rows) - p) < 5 * math.sqrt(p / len(rows))


def test_equal_weights_rebuild_the_documents(spark):
    rows = [(k, f"doc {k} has  some\nwords {'x ' * k}".strip(), "en", "a", 1) for k in range(20)]
    out = mixing.mix_segments(spark.createDataFrame(rows, DOCS), weights={"a": 1.0}, block=16, slots=8).where("turn = 0").orderBy("at").collect()
    text = defaultdict(str)
    for r in out:
        text[r.doc_id] += r.text
    assert dict(text) == {k: t for k, t, *_ in rows}


def brute_mixture(rows, block, slots, seed):
    """All slots by one loop over the streams: (shard, slot) -> (source, turn, block, tokens). rows: (place, id, text, source)."""
    streams = defaultdict(list)
    for _, _, text, source in sorted(rows, key=lambda r: r[:2]):
        streams[source] += (text or "").split()
    names = sorted(s for s, w in streams.items() if w)
    n = {s: -(-len(streams[s]) // block) for s in names}
    w = np.array([len(streams[s]) ** mixing.TEMPERATURE for s in names])
    total, at, out = sum(n.values()), dict.fromkeys(names, 0), {}
    for shard in range(-(-total // slots)):
        size = min(slots, total - shard * slots)
        counts = np.random.default_rng([seed, shard]).multinomial(size, w / w.sum())
        place = iter(np.random.default_rng([seed, shard, 1]).permutation(size).tolist())
        for s, c in zip(names, counts):
            for _ in range(c):
                turn, k = divmod(at[s], n[s])
                at[s] += 1
                key = np.array([mixing.source_key(s, turn, seed)], np.uint64)
                b = int(mixing.permuted(np.array([k]), np.array([n[s]]), key)[0])
                out[shard, next(place)] = (s, turn, b, streams[s][b * block : (b + 1) * block])
    return out


@pytest.mark.parametrize("group", [1024, 3])
def test_mixture_equals_brute_force(docs, group, monkeypatch):
    monkeypatch.setattr(mixing.slot_table, "__defaults__", (group,))
    buckets = max(1, math.ceil(docs.count() / mixing.ROWS_A_BUCKET))
    rows = [(r.b, r.doc_id, r.text, r.source) for r in docs.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("b")).collect()]
    want = brute_mixture(rows, 64, 16, mixing.SEED)
    got = {(r.shard, r.slot): (r.source, r.turn, r.block, r.text.split()) for r in mixing.mix_blocks(docs, block=64, slots=16).collect()}
    assert got == want


def test_slots_are_not_broadcast(docs, capsys):
    mixing.mix_blocks(docs, block=64, slots=16).explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and not re.search(r"BroadcastHashJoin \[source#\d+, block", plan)


def test_mixing_of_awkward_rows(awkward, nothing):
    out = mixing.mix_blocks(awkward, block=1000)
    assert {r.source for r in out.select("source").distinct().collect()} <= {"a", "b", "c", None} and out.count() > 0
    assert mixing.mix_blocks(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mix_blocks(awkward, weights={"zzz": 1.0}).count() == 0
    assert {r.source for r in mixing.mix_blocks(awkward, weights={"c": 2.0, "zzz": 1.0}).collect()} == {"c"}


# --- sharding


@pytest.mark.parametrize("n,size", [(1, 2), (3, 7), (64, 65537)])
def test_lookup_table_is_even(n, size):
    c = Counter(sharding.lookup_table(sharding.shard_names(n), size).tolist())
    assert len(c) == n and max(c.values()) - min(c.values()) <= 1


def test_few_rows_move_when_a_shard_leaves():
    names = sharding.shard_names(20)
    before, after = sharding.lookup_table(names, 5003), sharding.lookup_table(names[:-1], 5003)
    assert (before[before != 19] != after[before != 19]).mean() < 0.1


def test_sharding_of_awkward_rows(awkward, nothing):
    out = sharding.assign_shards(awkward)
    rows = out.collect()
    assert out.columns == [c for c in awkward.columns if c not in ("slot", "shard")] + ["slot", "shard"] and len(rows) == awkward.count()
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1 and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.assign_shards(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 8)


# --- decontamination


def brute_scores(items, passage):
    """BM25 share of each item that a passage explains."""
    toks = [words(t) for t in items]
    n, mean = len(items), sum(map(len, toks)) / len(items)
    df = Counter(w for t in toks for w in set(t))
    out = []
    for t in toks:
        tf = Counter(t)
        imp = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (decontamination.K1 + 1) / (f + decontamination.K1 * (1 - decontamination.B + decontamination.B * len(t) / mean)) for w, f in tf.items()}
        out.append(sum(v for w, v in imp.items() if w in passage) / sum(imp.values()))
    return out


def test_wand_retrieves_what_full_scoring_does(docs, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.orderBy("item_id", "text").collect()]
    ((index,),) = decontamination.passes_of(bench)
    lookup = decontamination.Lookup(index.terms)
    import pyarrow as pa

    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    runs, h = __import__("clauseflow.llm.bytescan", fromlist=["words"]).words(pa.array(texts))
    row, lo, hi = decontamination.windows(runs.first, index.stride)
    for t in (0.2, 0.7):
        p, i, s = decontamination.retrieve(index, lookup, lookup(h), lo, hi, t)
        got = {(int(a), int(index.items[b])): round(float(c), 6) for a, b, c in zip(p, i, s)}
        want = {}
        for k, (r, a, b) in enumerate(zip(row, lo, hi)):
            own = set(words(texts[r])[a - runs.first[r] : b - runs.first[r]])
            for (item, _), score in zip(items, brute_scores([x for _, x in items], own)):
                if score >= t:
                    want[k, item] = round(score, 6)
        assert {k: v for k, v in got.items() if v > t + 1e-5} == {k: v for k, v in want.items() if v > t + 1e-5}


def test_leaks_are_found_and_clean_documents_stay(spark):
    items = [(1, "What is the tallest mountain of the southern lands? It is Mount Karrabar in the east."), (2, "Name the metal that melts in a hand. Gallium melts in a hand."), (2, "one two"), (3, None), (None, "Which river runs north? The Nubb.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"word{k}" for k in range(500))
    rows = [
        (1, f"{filler} {items[0][1]} {filler}"), (2, f"{filler} what is the tallest mountain of the southern lands? nobody knows. {filler}"), (3, filler), (4, None), (None, items[1][1]), (5, items[1][1].upper()), (5, items[1][1].upper()), (6, ""),
        (7, filler + " Which river runs north? The Nubb. " + filler),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect())
    assert got == Counter({(1, 1): 1, (None, 2): 1, (5, 2): 2, (7, -1): 1})
    kept = decontamination.drop_leaks(df, bench)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter([2, 3, 4, 6])
    assert decontamination.find_leaks(df, bench.limit(0)).count() == 0 and decontamination.drop_leaks(df.limit(0), bench).count() == 0


def test_no_item_changes_another_items_leaks(spark, monkeypatch):
    item = (1, "What is the tallest mountain of the southern lands? It is Mount Karrabar in the east.")
    long = (2, " ".join(f"other{k}" for k in range(700)) + ". The end of it.")
    question, answer = item[1].split("? ")
    far = " ".join(f"word{k}" for k in range(200))
    rows = [(1, f"{question}? {far} {answer}"), (2, item[1]), (3, f"{far} {far} {item[1]} {far}"), (4, long[1]), (5, f"{far} {long[1]}"), (6, " ".join(long[1].split()[:300])), (7, (far + " ") * 3000 + item[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    find = lambda items: {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert find([item]) == {(2, 1), (3, 1), (7, 1)}
    both = {(2, 1), (3, 1), (7, 1), (4, 2), (5, 2)}
    assert find([item, long]) == both
    monkeypatch.setattr(decontamination.shards_of, "__defaults__", (20,))  # a shard for each item, a pass for each shard
    monkeypatch.setattr(decontamination.passes_of, "__defaults__", (20, 20))
    assert find([item, long]) == both
    bench = spark.createDataFrame([item, long, (3, "Who wrote the ninth letter? Nobody knows for sure.")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()) == [1, 6]


# --- classifiers


def test_quality_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = quality_classifier.score_quality(d, lab.where(~held)).join(lab.where(held), "doc_id").toPandas()
    assert ((out.p_good >= 0.4) == (out.quality == 1)).mean() > 0.95
    assert out[out.quality == 1].keep.mean() > 0.97 and out[out.quality == 0].keep.mean() < 0.2


def test_toxicity_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = toxicity.score_toxicity(d, lab.where(~held)).join(lab.where(held).withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert out[out.truth == 1].toxic.mean() > 0.6 and out[out.truth == 0].toxic.mean() < 0.04


@pytest.mark.parametrize("score,column", [(quality_classifier.score_quality, "p_good"), (toxicity.score_toxicity, "p_toxic")])
def test_classifiers_of_awkward_rows(score, column, awkward, nothing, docs, labels, no_labels, spark):
    out = score(awkward, no_labels)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r[column] is None for r in rows)
    assert score(nothing, labels).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (1, 1, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = score(awkward, some).collect()
    assert len(rows) == awkward.count() and all(0 <= r[column] <= 1 for r in rows)
    assert len({r[column] for r in rows if r.doc_id in (1, 7)}) == 1


def test_quality_filter_keeps_columns(awkward, no_labels, docs, labels):
    assert quality_classifier.filter_quality(awkward, no_labels).collect() == awkward.collect()
    keep = {r.doc_id for r in quality_classifier.score_quality(docs, labels).collect() if r.keep}
    assert {r.doc_id for r in quality_classifier.filter_quality(docs, labels).collect()} == keep


def test_find_toxic_are_those_that_score_so(docs, labels):
    every = toxicity.score_toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in toxicity.find_toxic(docs, labels).collect()) == sorted(r.doc_id for r in every if r.toxic)


# --- token counts, secrets, pages, rules


def test_token_counts_of_awkward_rows(awkward, nothing):
    rows = token_counts.count_tokens(awkward).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == awkward.count() and by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 0 and by[1].n_words == 6 and by[5].n_tokens > by[5].n_words > 200_000
    assert token_counts.count_tokens(nothing).count() == 0


def test_secret_scan_of_awkward_rows(awkward, nothing, spark):
    assert secret_scan.scan_secrets(awkward).count() == 0 == secret_scan.scan_secrets(nothing).count()
    key = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a"
    df = spark.createDataFrame([(None, f"token = {key}"), (3, "é " * 1000 + f"api_key: {key} and api_key: {key}")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.start, r.length) for r in secret_scan.scan_secrets(df).collect())
    assert got == [(0, 8, 40), (3, 3009, 40), (3, 3063, 40)]
    rng = random.Random(3)
    lines = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) for _ in range(6)]
    block = spark.createDataFrame([(1, "secret key:\n" + "\n".join(lines) + "\nand " + lines[0][::-1])], "doc_id long, text string")
    assert [r.start for r in secret_scan.scan_secrets(block).orderBy("start").collect()] == [12 + 65 * k for k in range(6)]


def test_extraction_keeps_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = html_extract.extract_content(pages).join(pages, "page_id").toPandas()
    assert len(out) == pages.count()
    right = total = 0
    for r in out.itertuples():
        blocks = html_extract.blocks_of(r.html)
        kept = set(r.text.split("\n"))
        for b in blocks:
            if b.landmark >= 0:
                total += 1
                right += (b.text in kept) == (b.landmark == 1)
    assert right / total > 0.9


def test_extraction_of_awkward_pages(spark):
    df = spark.createDataFrame([(1, None, "u"), (None, "", "u"), (2, "<p>" + "Plain words, many of them. " * 5000, "u"), (2, "<p><b>x", "u"), (2, "<p><b>x", "u")], "page_id long, html string, text string")
    rows = html_extract.extract_content(df).collect()
    assert len(rows) == 5 and [r.n_blocks for r in rows if r.page_id == 1] == [0] and max(len(r.text) for r in rows) > 100_000
    assert html_extract.extract_content(df.limit(0)).count() == 0


def test_rules_of_awkward_rows(awkward, nothing):
    rows = outliers.flag_outliers(awkward).collect()
    assert len(rows) == awkward.count() and all(r.keep and r.distance is None for r in rows)
    assert outliers.flag_outliers(nothing).count() == 0


def test_rules_of_more_groups_than_a_pass_has(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'")
    d = d.withColumn("source", F.when(F.col("doc_id") % 31 == 0, F.concat(F.lit("few"), "doc_id")).when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 4).cast("string")))
    monkeypatch.setattr(outliers, "MIN_ROWS", 20)
    want = {r.doc_id: r for r in outliers.flag_outliers(d).collect()}
    monkeypatch.setattr(outliers, "MAX_GROUPS", 2)
    got = outliers.flag_outliers(d).collect()
    assert len(got) == d.count() == len(want) and d.where("source is null").count() >= 20
    for r in got:
        assert r.keep == want[r.doc_id].keep and r.distance == pytest.approx(want[r.doc_id].distance, rel=1e-3)


def test_rules_equal_an_exact_concentration(spark):
    """The binned, distributed steps end where plain steps over all rows do."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("one")).where("lang = 'en'")
    import pyarrow as pa

    rows = d.select("doc_id", "text").toPandas()
    x = outliers.statistics(pa.array(rows.text, pa.string())).astype(np.float32).astype(np.float64)
    mean, cov = outliers.fast_mcd(x)
    dist = outliers.squared(x, mean, np.linalg.inv(cov))
    want = np.sqrt(dist / np.median(dist) * outliers.MEDIAN)
    got = outliers.flag_outliers(d).toPandas().set_index("doc_id").distance.reindex(rows.doc_id).to_numpy()
    assert np.corrcoef(want, got)[0, 1] > 0.999 and (((want <= outliers.LIMIT) == (got <= outliers.LIMIT)).mean() > 0.995)


def test_rules_reject_junk_and_keep_prose(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = outliers.flag_outliers(d).join(lab, "doc_id").toPandas()
    assert out[out.quality == 1].keep.mean() > 0.98 and out[out.quality == 0].keep.mean() < 0.1


# --- the pipeline


def brute_quality(rows, labels, threshold=0.4):
    """Ids that the classifier keeps, with word vectors summed by one loop over the words. rows: (id, text), each id once."""
    import pyarrow as pa

    q = quality_classifier
    texts = [q.tokens(pa.array([t], pa.string()))[0].tolist() for _, t in rows]
    names = sorted(Counter(itertools.chain(*texts)))
    assert len(names) <= q.WORDS  # each has a vector of its own
    at, sign = q.Coder(np.array(names, np.uint64)).index_vectors()
    place = {w: k for k, w in enumerate(names)}
    total = np.zeros((len(names), q.DIMS))
    for text in texts:
        codes = [place[w] for w in text]
        for k, w in enumerate(codes):
            for near in codes[max(0, k - q.WINDOW) : k] + codes[k + 1 : k + 1 + q.WINDOW]:
                np.add.at(total[w], at[near], sign[near])
    unit = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)
    x = np.zeros((len(rows), 2 * q.DIMS), np.float32)
    for k, text in enumerate(texts):
        if text:
            v = unit[[place[w] for w in text]]
            x[k] = np.append(v.mean(0), v.std(0))
    row = {i: k for k, (i, _) in enumerate(rows)}
    chosen = sorted((i, y) for i, y in labels if i in row)
    net = q.fit_network(np.stack([x[row[i]] for i, _ in chosen]), np.array([y for _, y in chosen]))
    return {i for (i, _), p in zip(rows, net.probability(x)) if p >= threshold}


def brute_leaks(rows, items):
    """Ids of documents that repeat an item: every passage against every item, by sets of words and n-grams."""

    def grams(w):
        return {tuple(w[k : k + decontamination.GRAM]) for k in range(max(1, len(w) - decontamination.GRAM + 1))} if w else set()

    toks = [words(t or "") for t in items]
    n, mean, df = len(items), sum(map(len, toks)) / len(items), Counter(w for t in toks for w in set(t))
    known = []
    for text, t in zip(items, toks):
        norm = decontamination.K1 * (1 - decontamination.B + decontamination.B * len(t) / mean)
        imp = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (decontamination.K1 + 1) / (f + norm) for w, f in Counter(t).items()}
        stride = 64
        while stride < len(t):
            stride *= 2
        known.append((stride, imp, sum(imp.values()), *(grams(words(x)) for x in decontamination.split_item(text))))
    out = set()
    for i, text in rows:
        w = words(text or "")
        for stride in {k[0] for k in known}:
            for lo in range(0, max(1, len(w) - stride), stride):
                own = w[lo : lo + 2 * stride]
                have, parts = set(own), {tuple(own[k : k + m]) for m in range(1, decontamination.GRAM + 1) for k in range(len(own) - m + 1)}
                for size, imp, whole, *wanted in known:
                    if size == stride and sum(v for x, v in imp.items() if x in have) >= decontamination.THRESHOLD * whole - 1e-9:
                        if all(len(g & parts) >= decontamination.OVERLAP * len(g) for g in wanted):
                            out.add(i)
    return out


def test_pipeline_equals_brute_force(spark, docs, labels):
    """run() against loops over the rows, stage by stage, with nothing of Spark in between."""
    import hashlib

    import corpus_pipeline as p

    rows = sorted((tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()), key=lambda r: r[0])
    assert len({r[0] for r in rows}) == len(rows) <= mixing.ROWS_A_BUCKET  # so that the streams are in order of ids
    good = brute_quality([r[:2] for r in rows], [(r.doc_id, r.quality) for r in labels.where("doc_id is not null and quality is not null").collect()])
    rows = [r for r in rows if r[0] in good]
    first = {i: i for i, *_ in rows} | {i: c for i, c, *_ in brute_classes([r[:2] for r in rows])}
    rows = [r for r in rows if first[r[0]] == r[0]]
    leaked = brute_leaks([r[:2] for r in rows], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()])
    assert leaked
    rows = [r for r in rows if r[0] not in leaked]
    owner = defaultdict(list)
    for i, text, lang, source in rows:
        owner[source] += [(i, lang)] * len((text or "").split())
    table, want = sharding.lookup_table(sharding.shard_names()), Counter()
    for s, _, b, tokens in brute_mixture([(0, i, t, s) for i, t, _, s in rows], mixing.BLOCK_TOKENS, mixing.SHARD_SLOTS, mixing.SEED).values():
        at = owner[s][b * mixing.BLOCK_TOKENS : (b + 1) * mixing.BLOCK_TOKENS]
        for (i, lang), part in itertools.groupby(zip(at, tokens), key=lambda x: x[0]):
            slot = int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
            want[i, tuple(w for _, w in part), lang, s, slot, int(table[slot])] += 1
    out = p.run(spark, SF).collect()
    assert all(r.n_chars == len(r.text) for r in out)
    assert Counter((r.doc_id, tuple(r.text.split()), r.lang, r.source, r.slot, r.shard) for r in out) == want


def test_pipeline_stages_in_sequence(spark, docs):
    import corpus_pipeline as p

    assert [f.__name__ for _, f in p.STAGES] == ["quality", "near_copies", "decontaminate", "mix", "shard"]
    at = docs
    for name, stage in p.STAGES:
        out = stage(spark, at, SF)
        assert out.columns[:5] == p.COLUMNS
        at = common.scratch(out, "test")
    kept = {r.doc_id for r in at.select("doc_id").distinct().collect()}
    good = {r.doc_id for r in p.quality(spark, docs, SF).collect()}
    assert kept <= good
    ran = p.run(spark, SF)
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "shard").collect()))
    assert key(ran) == key(at)


def test_pipeline_of_awkward_rows(spark, awkward, nothing):
    import corpus_pipeline as p

    for start in (awkward, nothing):
        at = start
        for name, stage in p.STAGES:
            at = common.scratch(stage(spark, at, SF), "awkward")
        assert at.columns == [*p.COLUMNS, "slot", "shard"]


def test_batches_for_workers_and_row_groups_follow_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes])})

    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 100), k -> sha2(concat_ws('/', id, k), 256)), '') AS text")
    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 4 << 20
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in common.scratch(docs, "groups").inputFiles()]
    assert max(g.row_group(k).total_byte_size for g in groups for k in range(g.num_row_groups)) < 20 << 20
