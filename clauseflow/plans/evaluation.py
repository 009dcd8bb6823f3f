"""Evaluation: confusion and agreement metrics, threshold sweeps, greedy matching, curation, class weights, resumption."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from . import synth
from .conflicts import all_findings_sql, cross_policy_findings, with_texts
from .synth import table

#: A classifier's stand-in: a score of each labelled document from its id alone.
SCORE = "((doc_id * 7919 + quality * 431 + 13) % 1000) / 1000.0"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "cast(quality as int) as gold", f"cast({SCORE} as double) as score", "cast((doc_id * 31 + quality * 7) % 3 as int) as three", "cast((doc_id * 17 + toxic) % 3 as int) as predicted")


_SCORED_SQL = f"scored AS (SELECT doc_id, CAST(quality AS INTEGER) AS gold, CAST(({SCORE.replace('/ 1000.0', '/ 1000.0::DOUBLE')}) AS DOUBLE) AS score, CAST((doc_id * 31 + quality * 7) % 3 AS INTEGER) AS three, CAST((doc_id * 17 + toxic) % 3 AS INTEGER) AS predicted FROM labels)"
_PRF = "round(tp * 1.0D / nullif(tp + fp, 0), 4) as precision, round(tp * 1.0D / nullif(tp + fn, 0), 4) as recall, round(2.0D * tp / nullif(2 * tp + fp + fn, 0), 4) as f1"
_PRF_SQL = _PRF.replace("1.0D", "1.0::DOUBLE").replace("2.0D", "2.0::DOUBLE")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each of three classes, and their means."""
    c = _scored(spark, sf_dir).groupBy("three", "predicted").agg(F.count("*").alias("n"))
    k = o.frame(spark, [(x,) for x in range(3)], "class int")
    per = c.crossJoin(k).groupBy("class").agg(*[F.sum(F.when(F.expr(e), F.col("n")).otherwise(0)).alias(a) for a, e in (("tp", "three = class and predicted = class"), ("fp", "three <> class and predicted = class"), ("fn", "three = class and predicted <> class"))])
    per = per.selectExpr("cast(class as string) as class", "tp", "fp", "fn", *_PRF.split(", round")[:1], *["round" + x for x in _PRF.split(", round")[1:]])
    total = per.selectExpr("'macro' as class", "tp", "fp", "fn", "precision", "recall", "f1").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *[F.round(F.avg(x), 4).alias(x) for x in ("precision", "recall", "f1")])
    return per.union(total)


CONFUSION_SQL = (
    f"WITH {_SCORED_SQL}, per AS (SELECT class, CAST(count_if(three = class AND predicted = class) AS BIGINT) AS tp, CAST(count_if(three <> class AND predicted = class) AS BIGINT) AS fp, CAST(count_if(three = class AND predicted <> class) AS BIGINT) AS fn FROM scored, (SELECT unnest([0, 1, 2]) AS class) GROUP BY class), "
    f"m AS (SELECT CAST(class AS VARCHAR) AS class, tp, fp, fn, {_PRF_SQL} FROM per) SELECT * FROM m UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4) FROM m"
)


def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all classes, which is also their micro-averaged precision, recall and F1."""
    s = _scored(spark, sf_dir)
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("three") == F.col("predicted")).alias("right"), F.round(F.avg((F.col("three") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


THRESHOLDS = [round(0.05 * k, 2) for k in range(2, 19)]


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at each threshold, and whether it is the first of the best."""
    t = o.frame(spark, [(x,) for x in THRESHOLDS], "threshold double")
    g = _scored(spark, sf_dir).crossJoin(t).groupBy("threshold").agg(*[F.count_if(F.expr(e)).alias(a) for a, e in (("tp", "score >= threshold and gold = 1"), ("fp", "score >= threshold and gold = 0"), ("fn", "score < threshold and gold = 1"))])
    g = g.withColumn("f1", F.expr("round(2.0D * tp / nullif(2 * tp + fp + fn, 0), 6)"))
    return g.withColumn("best", F.row_number().over(Window.orderBy(F.desc("f1"), "threshold")) == 1)


SWEEP_SQL = (
    f"WITH {_SCORED_SQL}, g AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(count_if(score >= CAST(threshold AS DOUBLE) AND gold = 1) AS BIGINT) AS tp, CAST(count_if(score >= CAST(threshold AS DOUBLE) AND gold = 0) AS BIGINT) AS fp, CAST(count_if(score < CAST(threshold AS DOUBLE) AND gold = 1) AS BIGINT) AS fn FROM scored, {o.values([(x,) for x in THRESHOLDS], 'threshold')} GROUP BY 1), "
    "f AS (SELECT *, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM g) SELECT *, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f"
)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often three judges agree, by pair and all together, over what all of them judged."""
    j = table(spark, sf_dir, "events").selectExpr("event_id", "stack(3, 'a', event_id % 4, 'b', (event_id * 3) % 4, 'c', (event_id div 2) % 4) as (judge, verdict)")
    two = j.alias("x").join(j.alias("y"), "event_id").where("x.judge < y.judge").groupBy(F.concat_ws("-", "x.judge", "y.judge").alias("judges")).agg(F.count("*").alias("n"), F.count_if(F.expr("x.verdict = y.verdict")).alias("same"))
    every = j.groupBy("event_id").agg(F.countDistinct("verdict").alias("k")).agg(F.lit("all").alias("judges"), F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("same"))
    return two.union(every).withColumn("percent", F.expr("round(100.0D * same / n, 4)"))


AGREEMENT_SQL = (
    "WITH j AS (SELECT event_id, event_id % 4 AS a, (event_id * 3) % 4 AS b, (event_id // 2) % 4 AS c FROM events), p AS (SELECT 'a-b' AS judges, a = b AS s FROM j UNION ALL SELECT 'a-c', a = c FROM j UNION ALL SELECT 'b-c', b = c FROM j UNION ALL SELECT 'all', a = b AND b = c FROM j) "
    "SELECT judges, count(*) AS n, CAST(count_if(s) AS BIGINT) AS same, round(100.0::DOUBLE * count_if(s) / count(*), 4) AS percent FROM p GROUP BY judges"
)


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of the positives of each label: negatives by positives, between 1 and 50."""
    labels = table(spark, sf_dir, "labels").selectExpr("stack(2, 'quality', quality, 'toxic', toxic) as (label, y)")
    g = labels.groupBy("label").agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"))
    return g.withColumn("weight", F.expr("round(least(50.0D, greatest(1.0D, negative * 1.0D / positive)), 6)"))


CLASS_WEIGHTS_SQL = "SELECT label, CAST(count_if(y = 1) AS BIGINT) AS positive, CAST(count_if(y = 0) AS BIGINT) AS negative, round(least(50.0::DOUBLE, greatest(1.0::DOUBLE, count_if(y = 0)::DOUBLE / count_if(y = 1))), 6) AS weight FROM (SELECT 'quality' AS label, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY label"


def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, and precision, recall and F1 of each label against a stand-in's predictions."""
    s = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality", "toxic", "cast((doc_id * 7 + quality) % 2 as int) as q", "cast((doc_id * 5 + toxic) % 3 = 0 as int) as t")
    long = s.selectExpr("stack(2, 'quality', quality, q, 'toxic', toxic, t) as (label, gold, predicted)")
    g = long.groupBy("label").agg(*[F.count_if(F.expr(e)).alias(a) for a, e in (("tp", "gold = 1 and predicted = 1"), ("fp", "gold = 0 and predicted = 1"), ("fn", "gold = 1 and predicted = 0"))])
    exact = s.agg(F.round(F.avg(((F.col("quality") == F.col("q")) & (F.col("toxic") == F.col("t"))).cast("double")), 6).alias("exact_match"))
    parts = _PRF.split(", round")
    return g.selectExpr("label", "tp", "fp", "fn", parts[0], *["round" + x for x in parts[1:]]).crossJoin(F.broadcast(exact))


MULTILABEL_SQL = (
    "WITH s AS (SELECT quality, toxic, CAST((doc_id * 7 + quality) % 2 AS INTEGER) AS q, CAST((doc_id * 5 + toxic) % 3 = 0 AS INTEGER) AS t FROM labels), l AS (SELECT 'quality' AS label, quality AS gold, q AS predicted FROM s UNION ALL SELECT 'toxic', toxic, t FROM s), "
    "g AS (SELECT label, CAST(count_if(gold = 1 AND predicted = 1) AS BIGINT) AS tp, CAST(count_if(gold = 0 AND predicted = 1) AS BIGINT) AS fp, CAST(count_if(gold = 1 AND predicted = 0) AS BIGINT) AS fn FROM l GROUP BY label) "
    f"SELECT label, tp, fp, fn, {_PRF_SQL}, (SELECT round(avg(CAST(quality = q AND toxic = t AS DOUBLE)), 6) FROM s) AS exact_match FROM g"
)


def greedy_match(gold: DataFrame, predicted: DataFrame, least: float = 0.4) -> DataFrame:
    """(clause, gold, predicted, score): one-to-one matches within each clause, best score first, ties to the larger places.

    Both have clause, place, tokens, action, kind.  The score weighs the tokens' Jaccard similarity, the action and the type."""
    both = F.size(F.array_intersect("g_tokens", "p_tokens"))
    tokens = F.when((F.col("g_n") == 0) & (F.col("p_n") == 0), 1.0).otherwise(both / (F.col("g_n") + F.col("p_n") - both))
    act = F.when(F.col("g_action") == F.col("p_action"), 1.0).otherwise(F.when(F.concat_ws(">", "g_action", "p_action").isin([f"{a}>{b}" for a, b in o.action_closure()] + [f"{b}>{a}" for a, b in o.action_closure()]), 0.5).otherwise(0.0))
    side = lambda df, k: df.select("clause", *[F.col(c).alias(k + c) for c in ("place", "tokens", "action", "kind")], F.size(F.array_distinct("tokens")).alias(k + "n"))
    g, p = side(gold, "g_"), side(predicted, "p_")
    scored = g.join(p, "clause").withColumn("score", F.round(0.45 * tokens + 0.4 * act + 0.15 * (F.col("g_kind") == F.col("p_kind")).cast("double"), 9)).where(F.col("score") >= least)

    def greedy(batches):
        clause, used_g, used_p = None, set(), set()
        for b in batches:
            kept: list[int] = []
            for k, (c, g, p) in enumerate(zip(*(b.column(x).to_pylist() for x in ("clause", "gold", "predicted")))):
                if c != clause:
                    clause, used_g, used_p = c, set(), set()
                if g not in used_g and p not in used_p:
                    used_g.add(g)
                    used_p.add(p)
                    kept.append(k)
            yield b.select(["clause", "gold", "predicted", "score"]).take(pa.array(kept, pa.int64()))

    # the window brings a clause's candidates together and in order; a worker goes through all clauses of its part in one stream
    order = Window.partitionBy("clause").orderBy(F.desc("score"), F.desc("gold"), F.desc("predicted"))
    rows = scored.select(F.col("clause").cast("long").alias("clause"), F.col("g_place").cast("long").alias("gold"), F.col("p_place").cast("long").alias("predicted"), "score").withColumn("k", F.row_number().over(order))
    return rows.mapInArrow(greedy, "clause long, gold long, predicted long, score double")


def greedy_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites' statements as gold against a disturbed copy as predictions."""
    s = synth.site_statements(spark, sf_dir).select(F.col("policy").alias("clause"), F.substring("sid", 2, 20).cast("long").alias("place"), F.array_distinct(F.split(F.lower("source_text"), "[^a-z0-9]+")).alias("tokens"), "action", F.col("data_type").alias("kind"))
    p = s.withColumn("action", F.when(F.col("place") % 3 == 0, "process").otherwise(F.col("action"))).withColumn("kind", F.when(F.col("place") % 5 == 0, o.ROOT).otherwise(F.col("kind")))
    return greedy_match(s, p)


CAPS = {"modality": 20, "exclusivity": 15, "condition": 15, "retention": 20}
PER_PAIR, MOST, RELAXED, LEADING = 35, 100, 1.5, 1000


def curate(findings: DataFrame, most: int = 120, columns: list[str] | None = None) -> DataFrame:
    """A reader's selection of each pair's findings, in priority order: so many of a pattern, so many of a statement (four across policies, two
    within one), none that says the same again, none that compares a clause with itself. Of what is selected, the given columns or all.

    The counters depend on each other, so a pair is gone through in sequence; pairs are independent, and a worker goes through all pairs of its
    part in one stream. Findings have text_1 and text_2; what they say is told apart by a hash of 64 bits, within a pair."""
    columns = columns or findings.columns
    schema = findings.select(columns).schema

    def pick(batches):
        pair, n, by_pattern, by_statement, said = None, 0, {}, {}, set()
        for b in batches:
            kept: list[int] = []
            for k, (site, vendor, pattern, one, two, says, itself) in enumerate(zip(*(b.column(x).to_pylist() for x in ("_site", "_vendor", "_pattern", "_one", "_two", "_says", "_itself")))):
                if (site, vendor) != pair:
                    pair, n, by_pattern, by_statement, said = (site, vendor), 0, {}, {}, set()
                if n >= most or itself or says in said or by_pattern.get(pattern, 0) >= CAPS[pattern]:
                    continue
                if max(by_statement.get(one, 0), by_statement.get(two, 0)) >= (4 if site != vendor else 2):
                    continue
                n += 1
                said.add(says)
                by_pattern[pattern] = by_pattern.get(pattern, 0) + 1
                for x in (one, two):
                    by_statement[x] = by_statement.get(x, 0) + 1
                kept.append(k)
            yield b.select(columns).take(pa.array(kept, pa.int64()))

    across = F.col("site") != F.col("vendor")
    asked = {"_site": F.col("site"), "_vendor": F.col("vendor"), "_pattern": F.col("pattern"), "_one": F.col("statement_1"), "_two": F.col("statement_2")}
    asked["_says"] = F.when(across, F.xxhash64("pattern", "text_1", "text_2", "explanation")).otherwise(F.xxhash64("pattern", "text_1", "text_2"))
    asked["_itself"] = ~across & (F.col("text_1") != "") & (F.col("text_1") == F.col("text_2")) & (F.col("pattern") != "modality")
    rows = findings.withColumns(asked).withColumn("_k", F.row_number().over(Window.partitionBy("site", "vendor").orderBy("place")))
    return rows.select(*columns, *asked, "_k").mapInArrow(pick, schema)


def _with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_texts(spark, sf_dir)


def curated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate(_with_texts(spark, sf_dir), columns=["pattern", "site", "vendor", "statement_1", "statement_2", "severity", "evidence", "place"])


_GRAVITY = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"


def research_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 gravest findings over all pairs: a top-k report. So many of a pattern and 35 of a pair at first, then half as many again of each
    pattern; no two with the same sentences and explanation; a modality finding's sentence has to name the data in question.

    What a pattern and pair contribute is bounded by the pattern's cap, and what a pattern does by that of the pairs that are full: a few hundred
    rows, ranked in parallel, are then gone through in sequence."""
    df = _with_texts(spark, sf_dir)
    words = F.array_sort(F.filter(F.split(F.lower("data_type"), " "), lambda x: F.length(x) >= 4), lambda a, b: F.length(b) - F.length(a))
    named = (F.size(words) == 0) | F.exists(F.slice(words, 1, 2), lambda x: F.contains(F.lower("text_1"), x))
    df = df.where((F.col("pattern") != "modality") | named).withColumn("gravity", F.expr(_GRAVITY)).withColumn("late", (F.col("pattern") != "modality").cast("int"))
    order = ["gravity", "late", "site", "vendor", "statement_1", "statement_2", "pattern"]
    # Repeats within a site go where the findings are; of the rest only the first LEADING of each pattern leave their task, with what they say as a hash.
    # Up to the last of those the list without repeats is whole: a row's first like is before it. Should the choice need more, all findings are ranked.
    df = df.withColumn("says", F.xxhash64("text_1", "text_2", "explanation")).drop("text_1", "text_2", "explanation")
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("site", "pattern", "says").orderBy(*order))).where("k = 1")
    head = df.withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy(*order))).where(F.col("k") <= LEADING)
    first = head.select("pattern", "site", "vendor", "statement_1", "statement_2", "severity", "gravity", "late", "says").toPandas()
    cut = first.groupby("pattern").size()
    first = first.sort_values(order).drop_duplicates(["pattern", "says"])
    once = Window.partitionBy("pattern", "says").orderBy(*order)
    df = df.withColumn("k", F.row_number().over(once)).where("k = 1")
    cap = max(int(c * RELAXED) for c in CAPS.values())
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("pattern", "site", "vendor").orderBy(*order))).where(F.col("k") <= cap)
    # the first rows of each pattern are among the first of each of its 64 parts: one pass, and no window over all rows of a pattern
    part = F.pmod(F.xxhash64("site", "vendor"), F.lit(64))
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("pattern", part).orderBy(*order))).where(F.col("k") <= cap * 4)
    best = df.select("pattern", "site", "vendor", "statement_1", "statement_2", "severity", "gravity", "late")

    def pick(batches):
        rows = pd.concat(list(batches)).sort_values(order).reset_index(drop=True)
        taken: list[int] = []
        by_pair: dict = {}
        by_pattern: dict = {}
        for relaxed in (False, True):
            for k, r in enumerate(rows.itertuples(index=False)):
                cap = int(CAPS[r.pattern] * RELAXED) if relaxed else CAPS[r.pattern]
                pair = (r.site, r.vendor)
                if k in taken or by_pattern.get(r.pattern, 0) >= cap or (not relaxed and (by_pair.get(pair, 0) >= PER_PAIR or len(taken) >= MOST)):
                    continue
                taken.append(k)
                by_pair[pair], by_pattern[r.pattern] = by_pair.get(pair, 0) + 1, by_pattern.get(r.pattern, 0) + 1
        out = rows.iloc[taken[:MOST]].assign(rank=range(1, min(MOST, len(taken)) + 1))
        yield out[["rank", "pattern", "site", "vendor", "statement_1", "statement_2", "severity"]]

    schema = "rank int, pattern string, site long, vendor long, statement_1 string, statement_2 string, severity string"

    def enough() -> bool:
        """No pattern's list was cut off before the pattern had its share, nor after a pair that is full took much of it."""
        capped = {p: int(CAPS[p] * RELAXED) for p, n in cut.items() if n >= LEADING}
        rows = first[first.pattern.isin(capped)].groupby(["pattern", "site", "vendor"]).cumcount()
        usable = first.loc[rows[rows < cap].index].groupby("pattern").size()
        return all(usable.get(p, 0) >= 4 * n for p, n in capped.items())

    if len(first) and enough():
        chosen = next(iter(pick(iter([first]))))
        return spark.createDataFrame(list(chosen.astype(object).itertuples(index=False, name=None)), schema)
    return best.repartition(1).mapInPandas(pick, schema)


def research_top_sql() -> str:
    caps = o.case("pattern", CAPS, 0)
    order = "gravity, late, site, vendor, statement_1, statement_2, pattern"
    return (
        f"{all_findings_sql()}, t AS (SELECT f.*, trim(x.source_text) AS t1, trim(y.source_text) AS t2, x.data_type, {_GRAVITY} AS gravity, CASE WHEN pattern <> 'modality' THEN 1 ELSE 0 END AS late FROM findings f JOIN (SELECT * FROM sites UNION ALL SELECT * FROM vendors) x ON x.sid = statement_1 JOIN (SELECT * FROM sites UNION ALL SELECT * FROM vendors) y ON y.sid = statement_2), "
        f"u AS (SELECT * FROM t WHERE (pattern <> 'modality' OR len(list_filter(string_split(lower(data_type), ' '), lambda w: length(w) >= 4)) = 0 OR len(list_filter(string_split(lower(data_type), ' '), lambda w: length(w) >= 4 AND contains(lower(t1), w))) > 0) QUALIFY row_number() OVER (PARTITION BY pattern, t1, t2, explanation ORDER BY {order}) = 1), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY {order}) AS k FROM u), s AS (SELECT *, CASE WHEN k <= {caps} THEN 0 ELSE 1 END AS turn FROM r WHERE k <= floor({caps} * {RELAXED})) "
        f"SELECT CAST(row_number() OVER (ORDER BY turn, {order}) AS INTEGER) AS rank, pattern, site, vendor, statement_1, statement_2, severity FROM s QUALIFY rank <= {MOST}"
    )


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without a result yet."""
    done = cross_policy_findings(spark, sf_dir).select("site", "vendor").distinct()
    return synth.pairs(spark, sf_dir).join(done, ["site", "vendor"], "left_anti")


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure categories that a finding's pattern bears on."""
    # counted by pair where the findings of a pair are, so that what is summed up is one row a pair, and no distinct pairs are shuffled
    n = {p: F.count_if(F.col("pattern") == p) for p in ATTRIBUTION}
    by_pair = cross_policy_findings(spark, sf_dir).groupBy("site", "vendor").agg(*[x.alias(p) for p, x in n.items()])
    categories = sorted({c for cs in ATTRIBUTION.values() for c in cs.split("|")})
    of = lambda c: reduce(Column.__add__, [F.col(p) for p, cs in ATTRIBUTION.items() if c in cs.split("|")])
    rows = by_pair.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), of(c).alias("n")) for c in categories])).alias("x")).select("x.*").where("n > 0")
    return rows.groupBy("category").agg(F.sum("n").alias("findings"), F.count("*").alias("pairs"))


ATTRIBUTION = {"modality": "Data Recipients|Processing Purpose", "exclusivity": "Processing Purpose", "condition": "Withdraw Consent|Provision Requirement", "retention": "Storage Period"}


def attribution_sql() -> str:
    dim = o.values([(p, c) for p, cs in ATTRIBUTION.items() for c in cs.split("|")], "pattern, category")
    return f"{all_findings_sql()} SELECT category, count(*) AS findings, count(DISTINCT (site, vendor)) AS pairs FROM findings JOIN {dim} USING (pattern) GROUP BY category"


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in training, validation and test parts, each class apart, by rank of a hash."""
    w = Window.partitionBy("quality", "toxic")
    k = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))), "doc_id"))
    share = (k - 1) / F.count("*").over(w)
    return table(spark, sf_dir, "labels").select("doc_id", F.when(share < 0.8, "train").when(share < 0.9, "validation").otherwise("test").alias("part"))


SPLIT_SQL = "SELECT doc_id, CASE WHEN s < 0.8::DOUBLE THEN 'train' WHEN s < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, (row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('split:' || doc_id), doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY quality, toxic) AS s FROM labels)"

RAW = [
    '[{"action": "share", "data_object": "email address"}]', '```json\n{"action": "use", "data_object": "name"}\n```', 'Here it is: [{"action": "sell", "data_object": "age"}] thanks', "no json", "", '{"action": "fly", "data_object": ""}',
]


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of model responses: as they are, within a fence, or from the first bracket to the last; unknown actions become process."""
    kind = "array<struct<action: string, data_object: string>>"
    r = spark.createDataFrame(list(enumerate(RAW)), "id int, raw string")
    found = F.coalesce(F.nullif(F.regexp_extract("raw", r"(?is)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), F.nullif(F.regexp_extract("raw", r"(?s)(\[.*\]|\{.*\})", 1), F.lit("")))
    body = F.when(F.startswith(found, F.lit("{")), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found)
    items = r.select("id", F.explode(F.from_json(body, kind)).alias("x")).select("id", "x.*")
    return items.select("id", F.when(F.col("action").isin(o.ACTIONS), F.col("action")).otherwise("process").alias("action"), F.coalesce("data_object", F.lit("")).alias("data_object")).where("data_object <> ''")


QUERIES = {
    "confusion_metrics": (confusion_metrics, CONFUSION_SQL),
    "micro_metrics": (micro_metrics, f"WITH {_SCORED_SQL} SELECT count(*) AS n, CAST(count_if(three = predicted) AS BIGINT) AS right, round(avg(CAST(three = predicted AS DOUBLE)), 6) AS accuracy FROM scored"),
    "threshold_sweep": (threshold_sweep, SWEEP_SQL),
    "agreement": (agreement, AGREEMENT_SQL),
    "class_weights": (class_weights, CLASS_WEIGHTS_SQL),
    "multilabel_metrics": (multilabel_metrics, MULTILABEL_SQL),
    "greedy_match": (greedy_match_query, None),
    "curated_findings": (curated_findings, None),
    "research_top": (research_top, research_top_sql),
    "resume_antijoin": (resume_antijoin, lambda: f"{all_findings_sql()} SELECT site, vendor FROM pairs WHERE (site, vendor) NOT IN (SELECT (site, vendor) FROM findings)"),
    "attribution": (attribution, attribution_sql),
    "stratified_split": (stratified_split, SPLIT_SQL),
    "parse_responses": (parse_responses, None),
}
