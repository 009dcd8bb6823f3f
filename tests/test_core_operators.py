"""Operators on small fixtures, and invariants."""

import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from clauseflow.functions import ontology as o
from clauseflow.functions import text as t
from clauseflow.operators import models, normalise, patterns, segment
from clauseflow.plans import evaluation, fixtures, registry, synth
from clauseflow.sources import readers, sinks
from clauseflow.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_closure_is_reflexive_and_transitive():
    c = {(a, b) for a, b, _ in o.closure()}
    assert all((x, x) in c for x in o.types()) and len(o.types()) == 68 and len(c) == 188
    assert all((a, d) in c for a, b in c for b2, d in c if b == b2)


def test_dictionaries_cover_their_names():
    assert {c for _, c, _ in o.phrases(o.DATA_PHRASES)} <= set(o.types())
    assert {c for _, c, _ in o.phrases(o.PURPOSE_PHRASES)} <= set(o.NECESSITY)
    assert len(o.CATEGORIES) == 18 and len(o.group_of()) == 13


@pytest.mark.parametrize("name", sorted(k for k, p in vars(t).items() if isinstance(p, t.Predicate)))
def test_java_and_python_agree_on_predicates(spark, name):
    p = getattr(t, name)
    rows = spark.createDataFrame([(c,) for c in fixtures.CLAUSES], "c string").select("c", p(F.col("c")).alias("hit")).collect()
    assert [(r.c, r.hit) for r in rows if r.hit != p.python(r.c)] == []


def test_segmentation_rules():
    out = segment.segment(fixtures.POLICIES[0][1])
    assert [s for _, s, _ in out][0] == "What We Collect"
    texts = [c for _, _, c in out]
    assert "We collect the following kinds of data from you: your email address and your full name" in texts
    assert "You can ask us to delete everything at any time" in [c.rsplit(": ", 1)[-1] for c in texts]
    assert not any("Last updated" in c for c in texts) and not any(c.endswith("short") and len(c) < 20 for c in texts)
    long = segment.segment(fixtures.POLICIES[1][1])
    assert all(20 <= len(c) <= 2000 for _, _, c in long) and segment.segment("") == segment.segment(None) == []


def test_contrast_splits_two_practices():
    assert segment.split_contrast("We share your email address with partners but we do not sell your phone number.") == ["We share your email address with partners", "we do not sell your phone number"]
    assert segment.split_contrast("We like it but not much.") == ["We like it but not much."]


def test_names_are_normalised_in_order_of_steps(spark):
    got = {r.term: r.canonical for r in normalise.data_types(spark.createDataFrame([(x,) for x in fixtures.TERMS], "term string"), "term").collect()}
    exact = {p: c for p, c, _ in o.phrases(o.DATA_PHRASES)}

    def one(raw):
        x = re.sub(r"\s+", " ", re.sub(r"[^\w\s/-]+", " ", raw.strip().lower().replace("_", " "))).strip()
        if not x or x in exact or x in o.types():
            return exact.get(x, x)
        for p, c, _ in sorted(o.phrases(o.DATA_PHRASES), key=lambda z: -len(z[0])):
            if " " in p and re.search(rf"\b{re.escape(p)}\b", x):
                return c
        score, name = max(((SequenceMatcher(None, x, c).ratio(), c) for c in o.types()), key=lambda z: z[0])
        return name if score >= 0.78 else x

    assert got == {x: one(x) for x in fixtures.TERMS}


def _site(spark, *rows):
    base = dict(policy=1, actor="FirstParty", action="share", modality="COMMITMENT", data_type="email address", purpose="", recipient="", condition="unspecified", temporality="unspecified", temporality_value="", is_negative=False, source_text="We share it.", source_section="", scope="global")
    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in patterns.COLUMNS) for r in full], "policy long, sid string, actor string, action string, modality string, data_type string, purpose string, recipient string, condition string, temporality string, temporality_value string, is_negative boolean, source_text string, source_section string, scope string")


def test_modality_gates(spark):
    sites = _site(
        spark, dict(sid="never", modality="PROHIBITION", source_text="We will never share it."), dict(sid="child", modality="PROHIBITION", source_text="We never share data of children under 13."),
        dict(sid="scoped", modality="PROHIBITION", scope="newsletter", source_text="We never share it here."), dict(sid="month", action="retain", temporality="specific_duration", temporality_value="30 days"),
        dict(sid="named", modality="PROHIBITION", recipient="acme", source_text="We only share with acme, never share else."),
    )
    vendors = _site(
        spark, dict(sid="v1", policy=9, actor="ThirdParty:v9", action="sell", condition="by_default", source_text="We are selling it."), dict(sid="v2", policy=9, actor="ThirdParty:v9", action="retain", temporality="indefinite", source_text="We keep it."),
        dict(sid="v3", policy=9, actor="ThirdParty:v9", action="share", data_type="personal data", source_text="We share all."), dict(sid="v4", policy=9, actor="ThirdParty:v9", action="share", modality="PROHIBITION"),
    )
    pairs = spark.createDataFrame([(1, 9)], "site long, vendor long")
    got = {(r.statement_1, r.statement_2): (r.verdict, r.severity) for r in patterns.modality_cross(sites, vendors, pairs).collect()}
    assert got == {("never", "v1"): ("inconsistent", "HIGH"), ("never", "v3"): ("underspecified", "HIGH"), ("month", "v2"): ("inconsistent", "HIGH")}


def test_retention_across_equals_the_filtered_self_join(spark):
    sites, vendors, pairs = synth.site_statements(spark, SF), synth.vendor_statements(spark, SF), synth.pairs(spark, SF)
    direct = {(r.site, r.vendor, r.statement_1, r.statement_2) for r in patterns.retention_cross(sites, vendors, pairs).collect()}
    rows = {r.sid: r for r in patterns.flagged(sites).union(patterns.flagged(vendors)).collect()}
    related = set(o.related())
    for k, (a, b) in enumerate((x[2], x[3]) for x in sorted(direct)):
        if k % 50 == 0:
            assert (rows[a].data_type, rows[b].data_type) in related
    assert len(direct) > 0


def test_caps_hold(spark):
    f = evaluation.curated_findings(spark, SF)
    most = f.groupBy("site", "vendor", "pattern").count().groupBy("pattern").agg(F.max("count").alias("n")).collect()
    assert all(r.n <= evaluation.CAPS[r.pattern] for r in most)
    assert f.groupBy("site", "vendor", "statement_1").count().agg(F.max("count")).first()[0] <= 4


def test_greedy_match_is_one_to_one(spark):
    g = evaluation.greedy_match_query(spark, SF)
    assert g.groupBy("clause", "gold").count().where("count > 1").isEmpty() and g.groupBy("clause", "predicted").count().where("count > 1").isEmpty()


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "crawl.jsonl").write_text('{"rank": 1, "status": "ok", "policy_is_english": true, "first_party_policy": {"word_count": 700}, "started_at": "2024-05-02T10:00:00Z"}\n{broken\n')
    c = readers.crawl_records(spark, str(tmp_path / "crawl.jsonl"))
    assert [(r.qualified_site, r._corrupt_record) for r in c.orderBy("rank").collect()] == [(False, "{broken"), (True, None)]
    (tmp_path / "c").mkdir()
    for k in (1, 2):
        (tmp_path / "c" / f"shard{k}.json").write_text(json.dumps({"u": {"text": f"t{k}", "language": "en", "word_count": k}, f"only{k}": {"text": "x"}}))
    assert {r.url: r.text for r in readers.policy_cache(spark, str(tmp_path / "c")).collect()} == {"u": "t2", "only1": "x", "only2": "x"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "my policy.txt").write_text("a\nb")
    assert [tuple(r) for r in readers.policy_texts(spark, str(tmp_path / "p")).collect()] == [("my_policy", "a\nb")]
    (tmp_path / "m.csv").write_text("pair_id,website_file,vendor_file,vendor_name,service_type\n,a.txt,/b.txt,V,ads\nx,c.txt,d.txt,W,ads\n")
    assert [(r.pair_id, r.website_file, r.vendor_file) for r in readers.pair_manifest(spark, str(tmp_path / "m.csv"), "/base").collect()] == [("pair_0", "/base/a.txt", "/b.txt"), ("x", "/base/c.txt", "/base/d.txt")]
    ranks = spark.createDataFrame([(1, "www.a.com"), (2, "b.org"), (3, "sub.a.com"), (4, "c.net"), (5, "cdn.io")], "rank int, domain string")
    assert [r.domain for r in readers.ranked_sites(ranks, 2, after=1, excluded=("cdn.io",)).collect()] == ["b.org", "c.net"]
    rows = sinks.category_rows(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, categories array<string>"))
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (1, "b"), (2, "")]
    bad = spark.createDataFrame([(1, None)], "id int, error string")
    assert not sinks.failures(bad, "error", str(tmp_path / "f")) and not (tmp_path / "f").exists()
    assert sinks.failures(bad.fillna("x"), "error", str(tmp_path / "f")) and (tmp_path / "f").exists()


def test_first_writer_of_a_cache_wins(spark):
    cache = spark.createDataFrame([("a", "1")], "key string, answer string")
    fresh = spark.createDataFrame([("a", "2"), ("b", "4"), ("b", "3")], "key string, answer string")
    assert [tuple(r) for r in models.insert_if_absent(cache, fresh).collect()] == [("b", "3")]
    assert {r.x: r.answer for r in models.called(spark.createDataFrame([("p",), ("p",), ("q",)], "x string"), "x", lambda xs: [v.upper() for v in xs]).collect()} == {"p": "P", "q": "Q"}


def test_stream_appends_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string").write.mode("append").parquet(src)
        q = incremental.append_results(incremental.stream(spark, src, "k int, v string"), lambda df: df.withColumn("done", F.lit(True)), out, str(tmp_path / "cp"), ["k"])
        q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


@pytest.fixture(scope="module")
def few_sites(tmp_path_factory):
    """Two sites of many vendors, with their orders and lines."""
    import duckdb

    at, c = str(tmp_path_factory.mktemp("few")), duckdb.connect()
    c.execute(f"copy (select * from '{SF}/orders.parquet' where o_custkey in (select o_custkey from '{SF}/orders.parquet' group by 1 order by count(*) desc, 1 limit 2)) to '{at}/orders.parquet' (format parquet)")
    c.execute(f"copy (select l.* from '{SF}/lineitem.parquet' l join '{at}/orders.parquet' on o_orderkey = l_orderkey) to '{at}/lineitem.parquet' (format parquet)")
    return at


def test_every_observed_pair_and_line_item_counts(spark, few_sites):
    import duckdb

    seen = duckdb.sql(f"select distinct o_custkey, l_partkey * 10 + l_suppkey % 10 from '{few_sites}/orders.parquet' join '{few_sites}/lineitem.parquet' on o_orderkey = l_orderkey").fetchall()
    lines = duckdb.sql(f"select count(*) from '{few_sites}/lineitem.parquet'").fetchall()[0][0]
    assert synth.pairs(spark, few_sites).count() == len(seen) == sum(r.pairs for r in registry.queries()["pair_verdict_mix"](spark, few_sites).collect())
    statements = synth.vendor_statements(spark, few_sites)
    assert statements.count() == statements.select("sid").distinct().count() == lines


def test_meetings_are_those_of_related_types(spark):
    row = lambda policy, sid, kind: (policy, sid, "", "", "", kind)
    kinds = o.types()
    cols = "policy long, sid string, actor string, action string, modality string, data_type string"
    w, v = (spark.createDataFrame([row(p, f"{x}{k}", k) for k in kinds], cols) for p, x in ((1, "w"), (2, "v")))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "site long, vendor long")
    got = sorted((r.w_data_type, r.v_data_type) for r in patterns.meet(w, v, pairs).collect())
    assert got == sorted(o.related())


def test_packed_statements_come_back_as_they_were(spark):
    rows = [
        ("share", "analytics", "email address", True, 3, 5.5, "a"), ("fly", "", "personal data", None, 0, None, ""), (None, "a purpose of its own", "age", False, None, 1.0, None), ("sell", None, "name", True, 6, 0.0, "ü"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "policy long, action string, purpose string, data_type string, broad boolean, need int, days double, sid string")
    small, back = patterns.packed(df, df.columns[1:], ["policy"])
    assert not {"action", "purpose", "data_type", "broad", "need"} & set(small.columns)
    got = small.select("policy", *[back[c].alias(c) for c in df.columns[1:]])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())) and got.dtypes == df.dtypes


def test_findings_are_not_shuffled(spark):
    plan = registry.queries()["cross_policy_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_claims_are_looked_up_not_ranked(spark):
    plan = lambda q: registry.queries()[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number() windowspecdefinition(site" not in plan("claimed_statements")
    moved = [x for q in ("aligned_pairs", "aligned_neighbourhoods", "rescued_orphans") for x in plan(q).splitlines() if "Exchange hashpartitioning(" in x]
    assert moved and not any(k in x for x in moved for k in ("vendor_type#", "kind#", "own#", "site_type#") if "policy#" not in x)


def test_streams_of_groups_choose_as_the_rules_say(spark):
    row = lambda clause, place, tokens, kind="name": (clause, place, tokens, "share", kind)
    cols = "clause long, place long, tokens array<string>, action string, kind string"
    gold = spark.createDataFrame([row(c, k, ["a", "b", str(k)]) for c in range(40) for k in range(3)], cols)
    met = evaluation.greedy_match(gold, gold)
    assert sorted((r.clause, r.gold, r.predicted, r.score) for r in met.collect()) == [(c, k, k, 1.0) for c in range(40) for k in range(3)]
    assert "FlatMapGroups" not in met._jdf.queryExecution().executedPlan().toString()
    f = [(s, 7, k + 1, p, f"w{k}", f"v{k % 2}", f"t{k}", "u", "x") for s in (1, 2) for k, p in enumerate(["modality"] * 25 + ["retention"] * 9)]
    f = spark.createDataFrame(f, "site long, vendor long, place int, pattern string, statement_1 string, statement_2 string, text_1 string, text_2 string, explanation string")
    got = evaluation.curate(f)
    assert got.columns == f.columns and "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.site, r.place) for r in got.collect()) == [(s, k) for s in (1, 2) for k in range(1, 9)]


def test_pairs_are_compared_by_what_goes_with_them(spark):
    plan = lambda q: registry.queries()[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan("coverage_diff") and "CartesianProduct" not in plan("coverage_diff")
    assert "Join" not in plan("weak_components") and "Union" not in plan("bridge_flows")
    assert patterns.spread(spark.read.parquet(f"{SF}/lineitem.parquet"), 1000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "source_text" not in "".join(x for x in plan("statement_sides").splitlines() if "Exchange hashpartitioning(policy" in x)


def test_answers_are_joined_where_findings_are(spark):
    plan = registry.queries()["verify_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "key#" in x]


def test_the_gravest_findings_are_the_same_by_heads_and_by_ranking_all(spark, monkeypatch):
    heads = registry.queries()["research_top"](spark, SF).collect()
    monkeypatch.setattr(evaluation, "LEADING", 3)
    assert sorted(registry.queries()["research_top"](spark, SF).collect()) == sorted(heads)
