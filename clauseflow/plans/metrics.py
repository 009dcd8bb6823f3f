"""Reports of classifiers and extractors: per class, one against the rest, many labels, fields of matched items, what stayed unmatched.

Predictions are those of plain rules over the documents' texts (length, punctuation, sentences), against the gold labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ontology as o
from . import synth
from .synth import table

CLASSES = {0: "plain", 1: "good", 2: "toxic", 3: "good and toxic"}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, gold, predicted): class of each labelled document and what rules make of its text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim("text")).alias("n"), F.regexp_count("text", F.lit(r"[.!?]( |$)")).alias("ends"), F.regexp_count("text", F.lit("!")).alias("cries"))
    good = ((F.col("n") >= 200) & (F.col("ends") * 400 >= F.col("n"))).cast("int")
    toxic = (F.col("cries") * 300 >= F.col("n")).cast("int") * (F.col("cries") > 0).cast("int")
    p = d.select("doc_id", F.coalesce(good + 2 * toxic, F.lit(0)).alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("gold")).join(p, "doc_id")


_PREDICTED = (
    "pred AS (SELECT doc_id, CAST(quality + 2 * toxic AS INTEGER) AS gold, CAST(coalesce(CASE WHEN n >= 200 AND ends * 400 >= n THEN 1 ELSE 0 END + CASE WHEN cries > 0 AND cries * 300 >= n THEN 2 ELSE 0 END, 0) AS INTEGER) AS predicted FROM labels JOIN "
    "(SELECT doc_id, length(trim(text, ' ')) AS n, len(regexp_extract_all(text, '[.!?]( |$)')) AS ends, len(regexp_extract_all(text, '!')) AS cries FROM documents) USING (doc_id))"
)


def _prf(df: DataFrame) -> DataFrame:
    """With precision, recall and F1 from tp, fp and fn; a class that is never predicted has precision 0, one without support recall 0."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return df.withColumns({"precision": p, "recall": r, "f1": f})


_PRF = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"


def _counts(df: DataFrame, spark: SparkSession) -> DataFrame:
    confusion = df.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    k = o.frame(spark, [(c, name) for c, name in CLASSES.items()], "class int, name string")
    hit = lambda e: F.sum(F.when(F.expr(e), F.col("n")).otherwise(0))
    return confusion.crossJoin(k).groupBy("class", "name").agg(hit("gold = class and predicted = class").alias("tp"), hit("gold <> class and predicted = class").alias("fp"), hit("gold = class and predicted <> class").alias("fn"))


_COUNTS = f"counts AS (SELECT class, name, CAST(count_if(gold = class AND predicted = class) AS BIGINT) AS tp, CAST(count_if(gold <> class AND predicted = class) AS BIGINT) AS fp, CAST(count_if(gold = class AND predicted <> class) AS BIGINT) AS fn FROM pred, {o.values(list(CLASSES.items()), 'class, name')} GROUP BY ALL)"


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; accuracy; macro and weighted means. Classes without support don't count in the means."""
    per = _prf(_counts(predictions(spark, sf_dir), spark)).withColumn("support", F.col("tp") + F.col("fn"))
    r = lambda x: F.round(x, 4)
    rows = per.select(F.col("name").alias("class"), r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "support")
    have = per.where("support > 0")
    mean = lambda name, w: have.agg(F.lit(name).alias("class"), *[r(F.sum(F.col(x) * w) / F.sum(w)).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    right = r(F.sum("tp") / F.sum("support"))
    accuracy = per.agg(F.lit("accuracy").alias("class"), right.alias("precision"), right.alias("recall"), right.alias("f1"), F.sum("support").alias("support"))
    return rows.union(mean("macro", F.lit(1.0))).union(mean("weighted", F.col("support"))).union(accuracy)


_MEAN = lambda name, w: f"SELECT '{name}', " + ", ".join(f"round(sum({x} * {w}) / sum({w}), 4)" for x in ("precision", "recall", "f1")) + ", CAST(sum(support) AS BIGINT) FROM per WHERE support > 0"
CLASS_REPORT_SQL = (
    f"WITH {_PREDICTED}, {_COUNTS}, per AS (SELECT *, {_PRF}, tp + fn AS support FROM counts) SELECT name AS class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM per "
    f"UNION ALL {_MEAN('macro', '1.0::DOUBLE')} UNION ALL {_MEAN('weighted', 'support::DOUBLE')} UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support), 4), round(sum(tp)::DOUBLE / sum(support), 4), round(sum(tp)::DOUBLE / sum(support), 4), CAST(sum(support) AS BIGINT) FROM per"
)


def binary_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class against the rest: the mean F1 of the two sides."""
    c = _counts(predictions(spark, sf_dir), spark)
    n = predictions(spark, sf_dir).agg(F.count("*").alias("all"))
    side = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    tn = F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")
    return c.crossJoin(F.broadcast(n)).select(F.col("name").alias("class"), F.round((side(F.col("tp"), F.col("fp"), F.col("fn")) + side(tn, F.col("fn"), F.col("fp"))) / 2, 4).alias("macro_f1"), F.round((F.col("tp") + tn) / F.col("all"), 4).alias("accuracy"))


BINARY_SQL = (
    f"WITH {_PREDICTED}, {_COUNTS}, w AS (SELECT *, (SELECT count(*) FROM pred) - tp - fp - fn AS tn FROM counts) SELECT name AS class, round((coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 4) AS macro_f1, "
    "round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 4) AS accuracy FROM w"
)


def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many labels a document: each label with support, micro and macro means over them, and the share of documents with all labels right."""
    p = predictions(spark, sf_dir)
    bit = lambda c, k: F.expr(f"cast(floor({c} / {k}) % 2 as int)")
    long = p.select("doc_id", F.explode(F.array(*[F.struct(F.lit(name).alias("label"), bit("gold", k).alias("g"), bit("predicted", k).alias("p")) for name, k in (("good", 1), ("toxic", 2), ("never", 4))])).alias("x")).select("doc_id", "x.*")
    per = long.groupBy("label").agg(*[F.count_if(F.expr(e)).alias(a) for a, e in (("tp", "g = 1 and p = 1"), ("fp", "g = 0 and p = 1"), ("fn", "g = 1 and p = 0"))]).where("tp + fn > 0")
    exact = p.agg(F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 4).alias("exact"))
    r = [F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")]
    each = _prf(per).select("label", *r)
    micro = _prf(per.agg(F.lit("micro").alias("label"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])).select("label", *r)
    macro = _prf(per).agg(F.lit("macro").alias("label"), *[F.round(F.avg(x), 4).alias(x) for x in ("precision", "recall", "f1")])
    return each.union(micro).union(macro).crossJoin(F.broadcast(exact))


LABEL_SQL = (
    f"WITH {_PREDICTED}, l AS (SELECT label, gold // k % 2 AS g, predicted // k % 2 AS p FROM pred, {o.values([('good', 1), ('toxic', 2), ('never', 4)], 'label, k')}), per AS (SELECT label, count_if(g = 1 AND p = 1) AS tp, count_if(g = 0 AND p = 1) AS fp, count_if(g = 1 AND p = 0) AS fn FROM l GROUP BY label HAVING count_if(g = 1) > 0), "
    f"m AS (SELECT label, {_PRF} FROM per UNION ALL SELECT 'micro', {_PRF} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per)) SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, (SELECT round(avg(CAST(gold = predicted AS DOUBLE)), 4) FROM pred) AS exact FROM m "
    "UNION ALL SELECT 'macro', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), (SELECT round(avg(CAST(gold = predicted AS DOUBLE)), 4) FROM pred) FROM m WHERE label <> 'micro'"
)


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each label in each part of the stratified split, zeros included, and the weight with which a sampler would draw one."""
    from .evaluation import stratified_split

    s = stratified_split(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    long = s.select("part", F.explode(F.array(F.struct(F.lit("good").alias("label"), (F.col("quality") == 1).alias("has")), F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("has")))).alias("x")).select("part", "x.*")
    grid = o.frame(spark, [(p, x) for p in ("train", "validation", "test") for x in ("good", "toxic")], "part string, label string")
    g = long.groupBy("part", "label").agg(F.count_if("has").alias("n"), F.count("*").alias("of"))
    return grid.join(g, ["part", "label"], "left").select("part", "label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.try_divide(F.col("of"), F.col("n")), F.lit(0.0)), 4).alias("oversampling"))


def split_summary_sql() -> str:
    from .evaluation import SPLIT_SQL

    return (
        f"WITH s AS (SELECT part, quality, toxic FROM ({SPLIT_SQL}) JOIN labels USING (doc_id)), l AS (SELECT part, 'good' AS label, quality = 1 AS has FROM s UNION ALL SELECT part, 'toxic', toxic = 1 FROM s), g AS (SELECT part, label, count_if(has) AS n, count(*) AS of_ FROM l GROUP BY ALL) "
        f"SELECT x.part, x.label, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(of_::DOUBLE / nullif(n, 0), 0), 4) AS oversampling FROM {o.values([(p, x) for p in ('train', 'validation', 'test') for x in ('good', 'toxic')], 'part, label')} x LEFT JOIN g USING (part, label)".replace("AS t(part, label) x", "AS x(part, label)")
    )


def _gold_and_predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sites' statements as gold; as predictions a copy that misses some, splits some and mistakes some."""
    words = F.array_distinct(F.filter(F.split(F.lower("source_text"), "[^a-z0-9]+"), lambda x: x != ""))
    s = synth.site_statements(spark, sf_dir).select(F.col("policy").alias("clause"), F.substring("sid", 2, 20).cast("long").alias("place"), words.alias("tokens"), "action", F.col("data_type").alias("kind"), "condition", "modality", "purpose")
    k = F.col("place")
    p = s.where(k % 7 != 0).withColumn("action", F.when(k % 3 == 0, "process").otherwise(F.col("action"))).withColumn("kind", F.when(k % 5 == 0, o.ROOT).otherwise(F.col("kind"))).withColumn("condition", F.when(k % 4 == 0, "unspecified").otherwise(F.col("condition")))
    return s, p.union(p.where(k % 11 == 0).withColumn("place", k + 1_000_000_000))


#: Words for an action that an extractor may use, by the action that they mean.
REMAP = {
    w: a
    for a, ws in {
        "sell": "rent sale sales selling sold trade", "share": "disclose disclosed discloses disclosing disclosure distribute distributed shared shares sharing", "transfer": "transmission transmit transmitted",
        "retain": "retention storage store stored storing", "delete": "erase erased removal remove removed", "use": "process processed processing",
    }.items()
    for w in ws.split()
}


def unmatched_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of either side that the greedy matching left over, by why: B a synonym of an action that is there, A the same action split another way,
    D (predicted) or E (gold) nothing of that action."""
    from .evaluation import greedy_match

    gold, predicted = _gold_and_predicted(spark, sf_dir)
    met = greedy_match(gold, predicted)
    left = gold.withColumn("side", F.lit("gold")).join(met.select("clause", F.col("gold").alias("place")), ["clause", "place"], "left_anti")
    left = left.unionByName(predicted.withColumn("side", F.lit("predicted")).join(met.select("clause", F.col("predicted").alias("place")), ["clause", "place"], "left_anti"))
    there = gold.select("clause", F.lit("predicted").alias("side"), "action").union(predicted.select("clause", F.lit("gold").alias("side"), "action")).groupBy("clause", "side").agg(F.collect_set("action").alias("there"))
    df = left.join(there, ["clause", "side"], "left").withColumn("there", F.coalesce("there", F.array().cast("array<string>")))
    remapped = F.expr(o.case("action", REMAP))
    synonym = (F.col("side") == "predicted") & remapped.isNotNull() & (F.array_contains("there", remapped) | F.array_contains("there", F.col("action")))
    kind = F.when(F.coalesce(synonym, F.lit(False)), "B").when(F.array_contains("there", F.col("action")), "A").when(F.col("side") == "predicted", "D").otherwise("E")
    return df.groupBy("side", kind.alias("kind")).agg(F.count("*").alias("n"))


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 over all clauses, plain and with split or renamed items discounted."""
    from .evaluation import greedy_match

    gold, predicted = _gold_and_predicted(spark, sf_dir)
    n = gold.agg(F.count("*").alias("n_gold")).crossJoin(predicted.agg(F.count("*").alias("n_predicted"))).crossJoin(greedy_match(gold, predicted).agg(F.count("*").alias("n_match")))
    u = unmatched_kinds(spark, sf_dir).agg(F.coalesce(F.sum(F.when((F.col("side") == "predicted") & F.col("kind").isin("A", "B"), F.col("n"))), F.lit(0)).alias("dup_p"), F.coalesce(F.sum(F.when((F.col("side") == "gold") & (F.col("kind") == "A"), F.col("n"))), F.lit(0)).alias("dup_g"))
    df = n.crossJoin(u).select("n_gold", "n_predicted", "n_match", F.explode(F.array(F.struct(F.lit("strict").alias("view"), F.col("n_predicted").alias("p"), F.col("n_gold").alias("g")), F.struct(F.lit("adjusted").alias("view"), F.greatest(F.col("n_predicted") - F.col("dup_p"), "n_match").alias("p"), F.greatest(F.col("n_gold") - F.col("dup_g"), "n_match").alias("g")))).alias("x"))
    precision, recall = F.coalesce(F.try_divide("n_match", "x.p"), F.lit(0.0)), F.coalesce(F.try_divide("n_match", "x.g"), F.lit(0.0))
    return df.select("x.view", "n_gold", "n_predicted", "n_match", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 4).alias("f1"))


def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of matched items, how often each field is right."""
    from .evaluation import greedy_match

    gold, predicted = _gold_and_predicted(spark, sf_dir)
    fields = ["action", "kind", "condition", "modality", "purpose"]
    g, p = (x.select("clause", F.col("place").alias(k), F.struct(*fields).alias(k[0])) for x, k in ((gold, "gold"), (predicted, "predicted")))
    m = greedy_match(gold, predicted).join(g, ["clause", "gold"]).join(p, ["clause", "predicted"])
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"g.{f}") == F.col(f"p.{f}")).alias("right")) for f in fields])).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(F.col("right").cast("double")), 4).alias("accuracy"))


QUERIES = {
    "class_report": (class_report, CLASS_REPORT_SQL),
    "binary_views": (binary_views, BINARY_SQL),
    "label_report": (label_report, LABEL_SQL),
    "split_summary": (split_summary, split_summary_sql),
    "unmatched_kinds": (unmatched_kinds, None),
    "extraction_scores": (extraction_scores, None),
    "field_accuracy": (field_accuracy, None),
}
