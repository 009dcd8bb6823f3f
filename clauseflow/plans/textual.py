"""Queries of the ontology, the text predicates, segmentation, coverage and the statement graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions import text as t
from ..operators import normalise, segment
from ..operators.labels import labels_sql, rule_bits, rule_labels
from ..operators.patterns import spread
from . import fixtures, synth


def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(general, specific, steps) of all types, by recursion in SQL."""
    edges = spark.createDataFrame(o.edges(), "parent string, child string")
    nodes = spark.createDataFrame([(x,) for x in o.types()], "node string")
    return spark.sql(
        "WITH RECURSIVE up(general, specific, steps) AS (SELECT node, node, 0 FROM {nodes} UNION ALL SELECT parent, specific, steps + 1 FROM up JOIN {edges} ON child = general) SELECT * FROM up", nodes=nodes, edges=edges
    )


_EDGES = f"edges AS (SELECT * FROM {o.values(o.edges(), 'parent, child')}), nodes AS (SELECT * FROM {o.values([(x,) for x in o.types()], 'node')})"
CLOSURE_SQL = f"WITH RECURSIVE {_EDGES}, up(general, specific, steps) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT parent, specific, steps + 1 FROM up JOIN edges ON child = general) SELECT general, specific, CAST(steps AS INTEGER) AS steps FROM up"


def ontology_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(o.edges(), "parent string, child string")
    return e.alias("x").join(e.alias("y"), "parent").where("x.child <> y.child").select(F.col("x.child").alias("a"), F.col("y.child").alias("b"))


def subsume_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way down to each type from each one above it."""
    edges = spark.createDataFrame(o.edges(), "parent string, child string")
    nodes = spark.createDataFrame([(x,) for x in o.types()], "node string")
    return spark.sql(
        "WITH RECURSIVE down(general, specific, path) AS (SELECT node, node, node FROM {nodes} UNION ALL SELECT general, child, concat(path, ' > ', child) FROM down JOIN {edges} ON parent = specific) SELECT * FROM down", nodes=nodes, edges=edges
    )


PATH_SQL = f"WITH RECURSIVE {_EDGES}, down(general, specific, path) AS (SELECT node, node, node FROM nodes UNION ALL SELECT general, child, path || ' > ' || child FROM down JOIN edges ON parent = specific) SELECT * FROM down"


def action_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(o.action_closure(), "general string, specific string")


ACTIONS_SQL = (
    f"WITH RECURSIVE a AS (SELECT * FROM {o.values([(a,) for a in o.ACTIONS], 'action')}), b AS (SELECT * FROM {o.values(sorted(o.BROADER.items()), 'child, parent')}), "
    "up(general, specific) AS (SELECT action, action FROM a UNION ALL SELECT parent, specific FROM up JOIN b ON child = general) SELECT * FROM up"
)


def type_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and depth of each type, and how many statements of sites name it."""
    sens = [(x, s) for s, xs in o.SENSITIVITY.items() for x in xs.split("|")]
    depth = {b: max(k for _, c, k in o.closure() if c == b) for b in o.types()}
    dim = o.frame(spark, [(x, s, depth[x]) for x, s in sens], "data_type string, sensitivity string, depth int")
    n = synth.site_statements(spark, sf_dir).groupBy("data_type").agg(F.count("*").alias("statements"))
    return dim.join(n, "data_type", "left").withColumn("statements", F.coalesce("statements", F.lit(0)))


def type_attributes_sql() -> str:
    sens = [(x, s) for s, xs in o.SENSITIVITY.items() for x in xs.split("|")]
    depth = {b: max(k for _, c, k in o.closure() if c == b) for b in o.types()}
    return f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT t.data_type, sensitivity, CAST(depth AS INTEGER) AS depth, count(s.sid) AS statements FROM {o.values([(x, s, depth[x]) for x, s in sens], 'data_type, sensitivity, depth')} LEFT JOIN sites s USING (data_type) GROUP BY ALL"


def norm_data_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.data_types(spark.createDataFrame([(x,) for x in fixtures.TERMS], "term string"), "term")


def norm_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.purposes(spark.createDataFrame([(x,) for x in fixtures.AIMS], "term string"), "term")


def duration_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(x,) for x in fixtures.DURATIONS], "value string")
    return d.select("value", F.round(t.duration_days(F.col("value")), 6).alias("days"))


def _clauses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fixtures.CLAUSES)), "clause_id int, clause string")


_CLAUSES_SQL = o.values(list(enumerate(fixtures.CLAUSES)), "clause_id, clause")
_CASCADES = {
    "modality_infer": (lambda c: t.infer_modality(c, F.lit(False)), lambda c: t.infer_modality_sql(c, "false"), "modality"),
    "condition_infer": (t.infer_condition, t.infer_condition_sql, "condition"),
    "scope_regex": (t.infer_scope, t.infer_scope_sql, "scope"),
    "nonpractice_reason": (t.non_practice_reason, t.non_practice_reason_sql, "reason"),
    "prohibition_validate": (t.keeps_prohibition, t.keeps_prohibition_sql, "keeps"),
}


def _cascade(col, name):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _clauses(spark)
        return c.select("clause_id", col(F.col("clause")).alias(name))

    return query


PREDICATES = {k.lower(): p for k, p in vars(t).items() if isinstance(p, t.Predicate) and not k.startswith("_") and k != "INELIGIBLE"}


def clause_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicate on every clause."""
    return _clauses(spark).select("clause_id", *[p(F.col("clause")).alias(k) for k, p in PREDICATES.items()])


CLAUSE_PREDICATES_SQL = f"SELECT CAST(clause_id AS INTEGER) AS clause_id, {', '.join(f'{p.sql(chr(99) + "lause")} AS {k}' for k, p in PREDICATES.items())} FROM {_CLAUSES_SQL}"


def _labelled(spark: SparkSession, sf_dir: str, side: str = "site") -> DataFrame:
    s = (synth.site_statements if side == "site" else synth.vendor_statements)(spark, sf_dir)
    c = {x: F.col(x) for x in s.columns}
    return s.withColumn("categories", rule_labels(c["source_text"], c["action"], c["purpose"], c["recipient"], c["temporality"], c["data_type"]))


def gdpr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("sid", F.array_join("categories", "; ").alias("categories"))


def gdpr_rules_sql() -> str:
    return f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT sid, array_to_string(categories, '; ') AS categories FROM ({labels_sql('sites')})"


def _coverage(labelled: DataFrame) -> DataFrame:
    """Counts of every category for each policy, zeros included, as long rows."""
    dim = o.frame(labelled.sparkSession, [(c, o.FAMILY_OF[c], k) for k, c in enumerate(o.CATEGORIES)], "category string, family string, ord int")
    n = labelled.select("policy", F.explode("categories").alias("category")).groupBy("policy", "category").agg(F.count("*").alias("n"))
    return labelled.select("policy").distinct().crossJoin(dim).join(n, ["policy", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each site's policy covers: share of the 18 categories and of each family, and what is missing."""
    c = _coverage(_labelled(spark, sf_dir))
    hit = F.col("n") > 0
    family = lambda f: F.round(100.0 * F.count_if(hit & (F.col("family") == f)) / F.count_if(F.col("family") == f), 1)
    g = c.groupBy("policy").agg(
        F.count_if(hit).alias("covered"), F.round(100.0 * F.count_if(hit) / 18, 1).alias("percent"), family("Data Handling").alias("data_handling"), family("Data Subject Rights").alias("rights"), family("Legal / Organisational").alias("legal"),
        F.array_join(F.array_sort(F.collect_list(F.when(~hit, F.col("category")))), "; ").alias("missing"), F.sum("n").alias("labels"),
    )
    return g.withColumn("is_complete", F.col("covered") == 18)


_DIM_SQL = f"dim AS (SELECT * FROM {o.values([(c, o.FAMILY_OF[c], k) for k, c in enumerate(o.CATEGORIES)], 'category, family, ord')})"


def _coverage_sql(source: str, name: str) -> str:
    return (
        f"{name}_l AS ({labels_sql(source)}), {name}_n AS (SELECT policy, category, count(*) AS n FROM (SELECT policy, unnest(categories) AS category FROM {name}_l) GROUP BY ALL), "
        f"{name} AS (SELECT p.policy, d.category, d.family, coalesce(n, 0) AS n FROM (SELECT DISTINCT policy FROM {name}_l) p CROSS JOIN dim d LEFT JOIN {name}_n x ON x.policy = p.policy AND x.category = d.category)"
    )


def coverage_policy_sql() -> str:
    fam = lambda f: f"round(100.0::DOUBLE * count_if(n > 0 AND family = '{f}') / count_if(family = '{f}'), 1)"
    return (
        f"{synth.STATEMENTS_SQL.rstrip(', ')}, {_DIM_SQL}, {_coverage_sql('sites', 'cov')} SELECT policy, CAST(count_if(n > 0) AS BIGINT) AS covered, round(100.0::DOUBLE * count_if(n > 0) / 18, 1) AS percent, {fam('Data Handling')} AS data_handling, {fam('Data Subject Rights')} AS rights, "
        f"{fam('Legal / Organisational')} AS legal, coalesce(string_agg(CASE WHEN n = 0 THEN category END, '; ' ORDER BY category), '') AS missing, CAST(sum(n) AS BIGINT) AS labels, count_if(n > 0) = 18 AS is_complete FROM cov GROUP BY policy"
    )


def category_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of policies that disclose each category."""
    c = _coverage(_labelled(spark, sf_dir))
    return c.groupBy("category").agg(F.count_if(F.col("n") > 0).alias("policies"), F.round(100.0 * F.count_if(F.col("n") > 0) / F.count("*"), 4).alias("percent"))


def category_disclosure_sql() -> str:
    return f"{synth.STATEMENTS_SQL.rstrip(', ')}, {_DIM_SQL}, {_coverage_sql('sites', 'cov')} SELECT category, CAST(count_if(n > 0) AS BIGINT) AS policies, round(100.0::DOUBLE * count_if(n > 0) / count(*), 4) AS percent FROM cov GROUP BY category"


def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one side of each pair covers and the other doesn't, with a label of the asymmetry."""
    # a policy's categories are bits of one number, which goes with the pair to its site
    sets = lambda f, side, key: f(spark, sf_dir).select(F.col("policy").alias(key), rule_bits(*map(F.col, ("source_text", "action", "purpose", "recipient", "temporality", "data_type"))).alias("shown")).groupBy(key).agg(F.bit_or("shown").alias(side))
    p = synth.pairs(spark, sf_dir)
    df = p.join(sets(synth.vendor_statements, "b", "vendor"), "vendor").repartition(spread(p), "site").join(sets(synth.site_statements, "a", "site"), "site")
    place = {c: k for k, c in enumerate(o.CATEGORIES)}
    joined = lambda bits: F.array_join(F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << place[c])) != 0, c) for c in sorted(place)])), "; ")
    a, b = F.col("a"), F.col("b")
    gap = (F.bit_count("a") - F.bit_count("b")) * 100.0 / 18
    return df.select(
        "site", "vendor", joined(a.bitwiseAND(F.bitwise_not(b))).alias("only_site"), joined(b.bitwiseAND(F.bitwise_not(a))).alias("only_vendor"), joined(a.bitwiseAND(b)).alias("both"), (18 - F.bit_count(a.bitwiseOR(b))).alias("neither"),
        F.when(gap >= 20, "site_broader").when(gap <= -20, "vendor_broader").otherwise("balanced").alias("asymmetry"),
    )


def coverage_diff_sql() -> str:
    agg = lambda c: f"coalesce(string_agg(CASE WHEN {c} THEN a.category END, '; ' ORDER BY a.category), '')"
    gap = "(count_if(a.n > 0) - count_if(b.n > 0)) * 100.0::DOUBLE / 18"
    return (
        f"{synth.STATEMENTS_SQL.rstrip(', ')}, {_DIM_SQL}, {_coverage_sql('sites', 'cs')}, {_coverage_sql('vendors', 'cv')} SELECT site, vendor, {agg('a.n > 0 AND b.n = 0')} AS only_site, {agg('a.n = 0 AND b.n > 0')} AS only_vendor, {agg('a.n > 0 AND b.n > 0')} AS both, "
        f"CAST(count_if(a.n = 0 AND b.n = 0) AS INTEGER) AS neither, CASE WHEN {gap} >= 20 THEN 'site_broader' WHEN {gap} <= -20 THEN 'vendor_broader' ELSE 'balanced' END AS asymmetry FROM pairs JOIN cs a ON a.policy = site JOIN cv b ON b.policy = vendor AND b.category = a.category GROUP BY site, vendor"
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the policies' graphs: practices from actor to type, and what goes to a named recipient."""
    s = synth.site_statements(spark, sf_dir)
    practice = s.select("policy", F.col("actor").alias("src"), F.col("data_type").alias("dst"), F.concat(F.when(F.col("is_negative") | (F.col("modality") == "PROHIBITION"), "NOT_").otherwise(""), F.upper("action")).alias("kind"), "sid")
    shares = s.where((F.col("recipient") != "") & F.col("action").isin("share", "sell", "transfer")).select("policy", F.col("data_type").alias("src"), F.col("recipient").alias("dst"), F.lit("SHARES_WITH").alias("kind"), "sid")
    return practice.union(shares)


_EDGES_SQL = (
    "graph AS (SELECT policy, actor AS src, data_type AS dst, CASE WHEN is_negative OR modality = 'PROHIBITION' THEN 'NOT_' ELSE '' END || upper(action) AS kind, sid FROM sites "
    "UNION ALL SELECT policy, data_type, recipient, 'SHARES_WITH', sid FROM sites WHERE recipient <> '' AND action IN ('share','sell','transfer'))"
)


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, distinct edges and density of each policy's graph."""
    g = graph_edges(spark, sf_dir)
    nodes = g.select("policy", F.explode(F.array("src", "dst")).alias("node")).groupBy("policy").agg(F.countDistinct("node").alias("nodes"))
    edges = g.groupBy("policy").agg(F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("simple_edges"))
    return nodes.join(edges, "policy").withColumn("density", F.round(F.col("simple_edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6))


def graph_metrics_sql() -> str:
    return (
        f"{synth.STATEMENTS_SQL.rstrip(', ')}, {_EDGES_SQL}, n AS (SELECT policy, count(DISTINCT node) AS nodes FROM (SELECT policy, src AS node FROM graph UNION ALL SELECT policy, dst FROM graph) GROUP BY policy), "
        "e AS (SELECT policy, count(*) AS edges, count(DISTINCT (src, dst)) AS simple_edges FROM graph GROUP BY policy) SELECT policy, nodes, edges, simple_edges, round(simple_edges::DOUBLE / (nodes * (nodes - 1)), 6) AS density FROM n JOIN e USING (policy)"
    )


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a site beside equal or subsuming types of its vendors."""
    from .graphs import related_types

    return related_types(spark, sf_dir).withColumn("same", F.col("site_type") == F.col("vendor_type"))


def aligned_pairs_sql() -> str:
    return f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT DISTINCT site, vendor, w.data_type AS site_type, v.data_type AS vendor_type, w.data_type = v.data_type AS same FROM pairs JOIN sites w ON w.policy = site JOIN related ON a = w.data_type JOIN vendors v ON v.policy = vendor AND v.data_type = b"


def neighbourhood_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's statements around each of its types: sets, flags, the histogram of conditions."""
    s = synth.site_statements(spark, sf_dir)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return s.groupBy("policy", "data_type").agg(F.count("*").alias("statements"), joined("action").alias("actions"), joined("purpose").alias("purposes"), F.bool_or(F.col("modality") == "PROHIBITION").alias("prohibits"), F.bool_or(F.col("recipient") != "").alias("names_recipient"), F.count_if(F.col("condition") == "upon_consent").alias("on_consent"))


def neighbourhood_context_sql() -> str:
    return f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT policy, data_type, count(*) AS statements, string_agg(DISTINCT action, '; ' ORDER BY action) AS actions, string_agg(DISTINCT purpose, '; ' ORDER BY purpose) AS purposes, bool_or(modality = 'PROHIBITION') AS prohibits, bool_or(recipient <> '') AS names_recipient, CAST(count_if(condition = 'upon_consent') AS BIGINT) AS on_consent FROM sites GROUP BY policy, data_type"


def segment_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the fixture policies and of all documents."""
    docs = synth.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("policy_id"), "text")
    return segment.segment_policies(spark.createDataFrame(fixtures.POLICIES, "policy_id string, text string").union(docs))


STOPS = "the and of to a in that is for on with as by be this it from or at an are we you your our their".split()
_EDGE = ".,;:!?()\"'"


def is_english(text: Column, share: float = 0.07) -> Column:
    """Of the first 300 words, without the punctuation around them, that share are English stop words; of 20 words at least."""
    words = F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, 300)
    hits = F.size(F.filter(words, lambda x: F.btrim(F.lower(x), F.lit(_EDGE)).isin(STOPS)))
    return F.coalesce((F.size(words) >= 20) & (hits / F.size(words) >= share), F.lit(False))


def is_english_sql(text: str) -> str:
    stops, edge = ",".join(f"'{s}'" for s in STOPS), _EDGE.replace("'", "''")
    words = f"list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '')[1:300]"
    return f"coalesce(len({words}) >= 20 AND len(list_filter({words}, lambda x: trim(lower(x), '{edge}') IN ({stops})))::DOUBLE / len({words}) >= 0.07, false)"


def english_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are in English. The rule looks at the first 300 words: that is the feature."""
    return synth.table(spark, sf_dir, "documents").select("doc_id", is_english(F.col("text")).alias("english"))


def english_detector_sql() -> str:
    return f"SELECT doc_id, {is_english_sql('text')} AS english FROM documents"


def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by language, described."""
    d = synth.table(spark, sf_dir, "documents").select("lang", t.word_count(F.col("text")).cast("long").alias("n"))
    q = lambda p: F.round(F.percentile("n", F.lit(p)), 4)
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.round(F.avg("n"), 4).alias("mean"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"))


_WORDS_SQL = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))"
DOC_LENGTH_SQL = f"SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.75), 4) AS p75 FROM (SELECT lang, {_WORDS_SQL} AS n FROM documents) GROUP BY lang"
EDGES = [round(200 * (30000 / 200) ** (k / 10), 6) for k in range(11)]


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents in geometric bins of words, bins of five at least."""
    bins = o.frame(spark, [(k, lo, hi) for k, (lo, hi) in enumerate(zip(EDGES, EDGES[1:]))], "bin int, lo double, hi double")
    d = synth.table(spark, sf_dir, "documents").select("n_chars", t.word_count(F.col("text")).alias("n"))
    df = d.join(bins, (F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi"))).groupBy("bin").agg(F.count("*").alias("docs"), F.round(F.percentile("n_chars", F.lit(0.5)), 4).alias("median_chars"))
    return df.where("docs >= 5")


LENGTH_BUCKETS_SQL = f"SELECT CAST(bin AS INTEGER) AS bin, count(*) AS docs, round(quantile_cont(n_chars, 0.5), 4) AS median_chars FROM (SELECT n_chars, {_WORDS_SQL} AS n FROM documents) JOIN {o.values([(k, lo, hi) for k, (lo, hi) in enumerate(zip(EDGES, EDGES[1:]))], 'bin, lo, hi')} ON n >= lo AND n < hi GROUP BY bin HAVING count(*) >= 5"


def near_dup_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three documents with the same first 200 characters."""
    w = Window.partitionBy(F.substring(F.trim("text"), 1, 200)).orderBy("doc_id")
    return synth.table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc_id")


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short content hashes and how many documents share each."""
    d = synth.table(spark, sf_dir, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("sha256_16"))
    return d.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


QUERIES = {
    "ontology_closure": (ontology_closure, CLOSURE_SQL),
    "ontology_siblings": (ontology_siblings, f"WITH {_EDGES} SELECT x.child AS a, y.child AS b FROM edges x JOIN edges y USING (parent) WHERE x.child <> y.child"),
    "subsume_path": (subsume_path, PATH_SQL),
    "action_closure": (action_closure, ACTIONS_SQL),
    "type_attributes": (type_attributes, type_attributes_sql),
    "norm_data_type": (norm_data_type, None),
    "norm_purpose": (norm_purpose, None),
    "duration_days": (duration_days, f"SELECT value, round({t.duration_days_sql('value')}, 6) AS days FROM {o.values([(x,) for x in fixtures.DURATIONS], 'value')}"),
    **{k: (_cascade(col, name), f"SELECT CAST(clause_id AS INTEGER) AS clause_id, {sql('clause')} AS {name} FROM {_CLAUSES_SQL}") for k, (col, sql, name) in _CASCADES.items()},
    "clause_predicates": (clause_predicates, CLAUSE_PREDICATES_SQL),
    "gdpr_rules": (gdpr_rules, gdpr_rules_sql),
    "coverage_policy": (coverage_policy, coverage_policy_sql),
    "category_disclosure": (category_disclosure, category_disclosure_sql),
    "coverage_diff": (coverage_diff, coverage_diff_sql),
    "graph_edges": (graph_edges, lambda: f"{synth.STATEMENTS_SQL.rstrip(', ')}, {_EDGES_SQL} SELECT * FROM graph"),
    "graph_metrics": (graph_metrics, graph_metrics_sql),
    "aligned_pairs": (aligned_pairs, aligned_pairs_sql),
    "neighbourhood_context": (neighbourhood_context, neighbourhood_context_sql),
    "segment_clauses": (segment_clauses, None),
    "english_detector": (english_detector, english_detector_sql),
    "doc_length_stats": (doc_length_stats, DOC_LENGTH_SQL),
    "length_buckets": (length_buckets, LENGTH_BUCKETS_SQL),
    "near_dup_cap": (near_dup_cap, "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(trim(text), 1, 200) ORDER BY doc_id) <= 3"),
    "content_keys": (content_keys, "SELECT substr(sha256(text), 1, 16) AS sha256_16, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"),
}
