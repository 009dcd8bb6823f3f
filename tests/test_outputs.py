"""Sinks, adapters and selections against small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from clauseflow.functions import text as t
from clauseflow.operators import models
from clauseflow.plans import crawl, evaluation, metrics, records
from clauseflow.sources import sinks

SF = "/root/testdata/sf0.001"


def read_json(spark, path):
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def test_reports_are_written(spark, tmp_path):
    cov = spark.createDataFrame([(1, 17, 94.4, 1.0, 2.0, 3.0, "Storage Period; Right to Access", 40, False), (2, 18, 100.0, 1.0, 2.0, 3.0, "", 50, True)], "policy long, covered long, percent double, data_handling double, rights double, legal double, missing string, labels long, is_complete boolean")
    sinks.completeness_json(cov, f"{tmp_path}/c")
    assert sorted((r["policy"], r["missing"]) for r in read_json(spark, f"{tmp_path}/c")) == [(1, ["Storage Period", "Right to Access"]), (2, [])]
    sinks.coverage_csv(cov, "site", f"{tmp_path}/v")
    assert len(spark.read.csv(f"{tmp_path}/v", header=True).columns) == 10
    top = spark.createDataFrame([(k, f"x{k}") for k in (3, 1, 2)], "rank int, pattern string").repartition(3)
    sinks.ranked_csv(top, f"{tmp_path}/t")
    assert [r.rank for r in spark.read.csv(f"{tmp_path}/t", header=True).collect()] == ["1", "2", "3"]
    sinks.report_json(top, "pattern", f"{tmp_path}/r")
    assert read_json(spark, f"{tmp_path}/r") == [{"report": {f"x{k}": {"rank": k} for k in (1, 2, 3)}}]
    s = spark.createDataFrame([("a", "b", "A; B"), ("c", "d", ""), (None, "e", "A"), (" ", "f", "A")], "website_sentence string, vendor_sentence string, categories string")
    sinks.sentence_annotations(s, f"{tmp_path}/s")
    rows = spark.read.csv(f"{tmp_path}/s", header=True).collect()
    assert sorted((r.website_sentence, r.category or "") for r in rows) == [("a", "A"), ("a", "B"), ("c", "")]


def test_reflection_goes_on_until_nothing_is_new(spark):
    def model(texts, found):
        out = []
        for x, f in zip(texts, found):
            k = len(json.loads(f))
            out.append("not json" if x == "bad" else json.dumps([{"n": i} for i in range(min(k + 2, 3 if x == "short" else 9))]))
        return out

    rows = spark.createDataFrame([("short",), ("long",), ("bad",), ("short",)], "clause string")
    got = models.reflected(rows, "clause", model).groupBy("clause").agg(F.count("*").alias("n"), F.max("round").alias("last")).collect()
    assert {r.clause: (r.n, r.last) for r in got} == {"short": (3, 1), "long": (6, 2)}


def test_broken_service_is_left_alone(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        raise RuntimeError("down")

    rows = spark.createDataFrame([(str(k),) for k in range(8)], "x string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        out = models.called(rows, "x", model, retries=2, wait=0, broken_after=2).coalesce(1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert len(out) == 8 and all(r.answer is None for r in out) and calls.value < 16


def test_labels_have_thresholds_of_their_own(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "a")], "id int, text string")
    out = models.labelled(rows, "text", lambda xs: [[0.4, 0.1 * len(x)] for x in xs], ["one", "two"], [0.3, 0.2])
    assert {r.id: r.labels for r in out.collect()} == {1: ["one"], 2: ["one", "two"], 3: [], 4: ["one"]}


def test_answers_replace_rules_where_known(spark):
    rows = spark.createDataFrame([("We tell EU residents more.",), ("Nothing here.",)], "text string")
    answers = rows.where("text like 'Nothing%'").select(models.key("text").alias("key"), F.lit(" Newsletter ").alias("answer"))
    got = {r.text[:3]: r.scope for r in models.scoped(rows, "text", answers, t.infer_scope(F.col("text")), ["newsletter", "global"]).collect()}
    assert got == {"We ": "eu_residents", "Not": "newsletter"}
    chunks = spark.createDataFrame([(1, 0, "menu"), (1, 1, "text"), (2, 0, "x")], "page_id long, place int, text string")
    out = models.cleaned(chunks, chunks.where("text = 'menu'").select(models.key("text").alias("key"), F.lit("clean").alias("answer")))
    assert {r.page_id: r.text for r in out.collect()} == {1: "clean\n\ntext", 2: "x"}


def test_pages_are_cut_at_headings(spark, monkeypatch):
    html = "<h1>A</h1><p>one</p><h2>B</h2>two<script>no</script><h2>C</h2>" + "word " * 30 + "<h1>D</h1>four"
    monkeypatch.setattr(crawl, "FIXTURES", [(-1, "https://a.b/", html)])
    rows = crawl.heading_chunks(spark, SF, most=60).where("page_id = -1").orderBy("place").collect()
    assert [(r.breadcrumb, r.text) for r in rows][:2] == [("A", "one"), ("A > B", "two")] and rows[-1].breadcrumb == "D" and all(len(r.text) <= 60 for r in rows)
    assert " ".join(r.text for r in rows if r.breadcrumb == "A > C") == " ".join(["word"] * 30)


@pytest.mark.parametrize("query,least", [(crawl.third_parties, 1), (crawl.hub_links, 1), (crawl.accepted_policies, 1)])
def test_fixture_pages_show_their_signs(spark, query, least):
    assert query(spark, SF).count() >= least


def test_walls_are_told_apart(spark):
    kinds = {r.page_id: r.kind for r in crawl.page_class(spark, SF).where("page_id < 0").collect()}
    assert kinds == {-1: "content", -2: "content", -3: "cloudflare_challenge", -4: "access_denied", -5: "no_links_short_text", -6: "content", -7: "content", -8: "consent_wall", -9: "captcha_wall"}
    best = {r.url: r.score for r in crawl.scored_links(spark, SF).where("page_id = -1").collect()}
    assert best["https://shop.example.com/privacy?x=1#top"] == 9.8 and best["https://www.iubenda.com/privacy/1"] == 8.2 and "mailto:x@example.com" not in best


def test_denials_hold_unless_they_are_limited(spark):
    rows = {r.id: r for r in records.clause_rules(spark, SF).where("id < 0").collect()}
    k = -1 - len(records.fixtures.CLAUSES)
    opt, store, wish, unless, sell, keep, ads, context, vendors = (rows[k - i] for i in range(9))
    assert opt.optional and wish.optional and not store.optional
    assert not unless.no_share and sell.no_sell and not keep.no_retain and ads.no_use and not context.no_share and vendors.no_share


def brute_curation(rows, most=120):
    kept, pattern, statement, said = [], {}, {}, set()
    for r in sorted(rows, key=lambda r: r["place"]):
        says = (r["pattern"], r["text_1"], r["text_2"], r["explanation"])
        if says in said or pattern.get(r["pattern"], 0) >= evaluation.CAPS[r["pattern"]] or any(statement.get(r[x], 0) >= 4 for x in ("statement_1", "statement_2")):
            continue
        said.add(says)
        pattern[r["pattern"]] = pattern.get(r["pattern"], 0) + 1
        for x in ("statement_1", "statement_2"):
            statement[r[x]] = statement.get(r[x], 0) + 1
        kept.append(r["place"])
        if len(kept) == most:
            break
    return kept


def test_curation_equals_brute_force(spark):
    rows = [{"pattern": ["modality", "retention", "condition"][k % 3], "site": 1 + k % 2, "vendor": 9, "statement_1": f"w{k % 11}", "statement_2": f"v{k % 13}", "text_1": f"a{k % 17}", "text_2": f"b{k % 5}", "explanation": "e", "place": k} for k in range(300)]
    df = spark.createDataFrame(rows, "pattern string, site long, vendor long, statement_1 string, statement_2 string, text_1 string, text_2 string, explanation string, place int")
    got = {(r.site, r.place) for r in evaluation.curate(df).collect()}
    assert got == {(s, p) for s in (1, 2) for p in brute_curation([r for r in rows if r["site"] == s])}


def test_scores_discount_what_was_split(spark):
    rows = {r.view: r for r in metrics.extraction_scores(spark, SF).collect()}
    assert rows["adjusted"].f1 >= rows["strict"].f1 > 0 and rows["strict"].n_match <= min(rows["strict"].n_gold, rows["strict"].n_predicted)
    left = metrics.unmatched_kinds(spark, SF).groupBy("side").agg(F.sum("n").alias("n")).collect()
    assert {r.side: r.n for r in left} == {"gold": rows["strict"].n_gold - rows["strict"].n_match, "predicted": rows["strict"].n_predicted - rows["strict"].n_match}
