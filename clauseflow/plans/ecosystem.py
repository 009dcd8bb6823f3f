"""Reports on who embeds whom: funnels, availability, prevalence, concentration, densities, over the star schema's mapping.

A customer is a site of rank c_custkey + 1 and category c_mktsegment; it qualifies with a positive balance.  A supplier is a vendor; an
observation is a line that a site ordered of a vendor, in the class of the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from . import synth
from .synth import table

RANKS = [(1, 100), (101, 500), (501, 1000), (1001, 2500), (2501, 5000), (5001, 10000), (10001, None)]
PREVALENCE_RANKS = [(1, 100), (101, 250), (251, 500), (501, 1000), (1001, 2000), (2001, None)]
MIN_GROUP = 5


def bucket(rank: str, edges: list) -> str:
    """SQL for the name of the bucket of a rank."""
    return "CASE " + " ".join(f"WHEN {rank} <= {hi} THEN '{lo}-{hi}'" if hi else f"ELSE '{lo}+'" for lo, hi in edges) + " END"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("site"), (F.col("c_custkey") + 1).alias("rank"), F.col("c_mktsegment").alias("category"), (F.col("c_acctbal") > 0).alias("qualified"))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("vendor"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("qualified"))


SITES = "sites_ AS (SELECT c_custkey AS site, c_custkey + 1 AS rank, c_mktsegment AS category, c_acctbal > 0 AS qualified FROM customer)"
VENDORS = "vendors_ AS (SELECT s_suppkey AS vendor, s_name AS name, s_acctbal > 0 AS qualified FROM supplier)"
OBSERVED = synth.OBSERVED_SQL.rstrip(", ")
EMBEDS = "pairs AS (SELECT DISTINCT site, vendor FROM observed)"


def embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, vendor): every vendor that each site embeds, once."""
    return synth.observations(spark, sf_dir).select("site", "vendor").distinct()


def percent(k: str, n: str = "count(*)") -> str:
    return f"round(100.0D * {k} / {n}, 4)"


def percent_sql(k: str, n: str = "count(*)") -> str:
    return f"round(100.0::DOUBLE * {k} / {n}, 4)"


def status_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status with their share: the crawl's funnel."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def qualified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties in all, with a policy, and their share, by role."""
    both = sites(spark, sf_dir).select(F.lit("site").alias("role"), "qualified").union(vendors(spark, sf_dir).select(F.lit("vendor"), "qualified"))
    return both.groupBy("role").agg(F.count("*").alias("n"), F.count_if("qualified").alias("available")).withColumn("percent", F.expr(percent("available", "n")))


def availability_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability by category, a missing one named, small groups left out."""
    g = sites(spark, sf_dir).groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")).alias("category"))
    g = g.agg(F.count("*").alias("n"), F.count_if("qualified").alias("available")).where(F.col("n") >= MIN_GROUP)
    return g.withColumn("percent", F.expr(percent("available", "n")))


def availability_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability by bucket of rank; empty buckets don't appear."""
    g = sites(spark, sf_dir).groupBy(F.expr(bucket("rank", RANKS)).alias("ranks")).agg(F.count("*").alias("n"), F.count_if("qualified").alias("available"))
    return g.withColumn("percent", F.expr(percent("available", "n")))


def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors' prevalence: observations, and distinct sites; rank by observations."""
    seen = synth.observations(spark, sf_dir).groupBy("vendor").agg(F.count("*").alias("observations"), F.countDistinct("site").alias("sites"))
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("all_sites"))
    w = Window.orderBy(F.desc("observations"), "vendor")
    return seen.crossJoin(F.broadcast(n)).select("vendor", "observations", "sites", F.round(F.col("sites") * 100.0 / F.col("all_sites"), 4).alias("percent"), F.row_number().over(w).alias("rank"))


PREVALENCE_SQL = (
    f"WITH {OBSERVED}, prevalence AS (SELECT vendor, count(*) AS observations, count(DISTINCT site) AS sites FROM observed GROUP BY vendor), "
    "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY observations DESC, vendor) AS INTEGER) AS rank FROM prevalence)"
)


def prevalence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability of vendors' policies by bucket of their prevalence rank."""
    df = prevalence(spark, sf_dir).join(vendors(spark, sf_dir), "vendor").groupBy(F.expr(bucket("rank", PREVALENCE_RANKS)).alias("ranks"))
    return df.agg(F.count("*").alias("n"), F.count_if("qualified").alias("available")).withColumn("percent", F.expr(percent("available", "n")))


def top_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 vendors of most observations with their share of all."""
    p = prevalence(spark, sf_dir).withColumn("share", F.round(F.col("observations") * 100.0 / F.sum("observations").over(Window.partitionBy(F.lit(0))), 4))
    return p.join(vendors(spark, sf_dir), "vendor").orderBy("rank").limit(15).select("rank", "name", "observations", "share")


TOPS = [1, 3, 5, 10, 20, 50, 100, 259]


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all observations that fall to the first N vendors."""
    tops = o.frame(spark, [(n,) for n in TOPS], "top int")
    p = prevalence(spark, sf_dir)
    total = p.agg(F.sum("observations").alias("total"))
    return p.join(tops, F.col("rank") <= F.col("top")).groupBy("top").agg(F.sum("observations").alias("observations")).crossJoin(F.broadcast(total)).select("top", "observations", F.round(F.col("observations") * 100.0 / F.col("total"), 4).alias("share"))


def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of cumulative shares by rank."""
    p = prevalence(spark, sf_dir)
    run = F.sum("observations").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return p.select("rank", F.round(run * 100.0 / F.sum("observations").over(Window.partitionBy(F.lit(0))), 4).alias("share"))


def vendors_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifying vendors of each site, described."""
    ok = vendors(spark, sf_dir).where("qualified").select("vendor")
    per = synth.observations(spark, sf_dir).join(ok, "vendor", "left_semi").groupBy("site").agg(F.countDistinct("vendor").alias("n"))
    q = lambda p: F.round(F.percentile("n", F.lit(p)), 4)
    return per.agg(F.count("*").alias("sites"), F.round(F.avg("n"), 4).alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.max("n").alias("most"))


def density_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct vendors per site, on average, for each category of site and class of part."""
    s = sites(spark, sf_dir).where("qualified").select("site", "category")
    seen = synth.observations(spark, sf_dir).join(s, "site").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind")), "part")
    g = seen.groupBy("category", "kind").agg(F.countDistinct("site", "vendor").alias("pairs"), F.countDistinct("site").alias("sites"))
    return g.where(F.col("sites") >= MIN_GROUP).withColumn("per_site", F.round(F.col("pairs") / F.col("sites"), 4))


def tracker_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair with the record of the first index that has the vendor, else of the second, else none.

    The first index holds even vendors, the second those divisible by three; an override gives the address of some."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor"), "s_name", "s_acctbal", "s_nationkey")
    first = s.where("vendor % 2 = 0").select("vendor", F.struct(F.col("s_name").alias("entity"), F.lit("first").alias("index"), F.round("s_acctbal", 2).alias("prevalence")).alias("f"))
    second = s.where("vendor % 3 = 0").select("vendor", F.struct(F.upper("s_name").alias("entity"), F.lit("second").alias("index"), F.lit(None).cast("double").alias("prevalence")).alias("g"))
    over = s.where("s_nationkey = 7").select("vendor", F.concat(F.lit("https://"), F.lower("s_name"), F.lit("/privacy")).alias("policy_url"))
    p = embeds(spark, sf_dir)
    df = p.join(first, "vendor", "left").join(second, "vendor", "left").join(over, "vendor", "left").withColumn("e", F.coalesce("f", "g"))
    return df.select("site", "vendor", "e.entity", "e.index", "e.prevalence", "policy_url")


TRACKER_SQL = (
    f"WITH {OBSERVED}, {EMBEDS} SELECT site, p.vendor, CASE WHEN p.vendor % 2 = 0 THEN s_name WHEN p.vendor % 3 = 0 THEN upper(s_name) END AS entity, "
    "CASE WHEN p.vendor % 2 = 0 THEN 'first' WHEN p.vendor % 3 = 0 THEN 'second' END AS index, CASE WHEN p.vendor % 2 = 0 THEN round(s_acctbal, 2) END AS prevalence, "
    "CASE WHEN s_nationkey = 7 THEN 'https://' || lower(s_name) || '/privacy' END AS policy_url FROM pairs p JOIN supplier ON s_suppkey = p.vendor"
)


def same_entity_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without those whose two parties belong to one entity (here: nation); parties without one stay."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("a"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor"), F.col("s_nationkey").alias("b"))
    df = embeds(spark, sf_dir).join(c, "site", "left").join(s, "vendor", "left")
    return df.where(~F.coalesce(F.col("a") == F.col("b"), F.lit(False))).select("site", "vendor")


SAME_ENTITY_SQL = f"WITH {OBSERVED}, {EMBEDS} SELECT site, vendor FROM pairs LEFT JOIN customer ON c_custkey = site LEFT JOIN supplier ON s_suppkey = vendor WHERE NOT coalesce(c_nationkey = s_nationkey, false)"


def group_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vendors that share an address (nation), the most prevalent leads; each member with its leader."""
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor"), F.col("s_nationkey").alias("address"))
    p = v.join(prevalence(spark, sf_dir).select("vendor", "observations"), "vendor", "left").withColumn("rank", F.struct((-F.coalesce("observations", F.lit(-1))).alias("a"), "vendor"))
    lead = p.groupBy("address").agg(F.min_by("vendor", "rank").alias("leader"))
    return p.join(lead, "address").select("vendor", "leader")


LEADERS_SQL = f"{PREVALENCE_SQL} SELECT s_suppkey AS vendor, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY coalesce(observations, -1) DESC, s_suppkey) AS leader FROM supplier LEFT JOIN prevalence ON vendor = s_suppkey"


def pair_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a qualifying site and a qualifying vendor that it embeds."""
    seen = synth.observations(spark, sf_dir).select("site", "vendor").distinct()
    return seen.join(sites(spark, sf_dir).where("qualified"), "site", "left_semi").join(vendors(spark, sf_dir).where("qualified"), "vendor", "left_semi").select("site", "vendor")


PAIR_GENERATION_SQL = f"WITH {OBSERVED}, {SITES}, {VENDORS} SELECT DISTINCT site, vendor FROM observed WHERE site IN (SELECT site FROM sites_ WHERE qualified) AND vendor IN (SELECT vendor FROM vendors_ WHERE qualified)"


def curated_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifying sites without those of a blacklist (here: a nation)."""
    black = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("site"))
    return sites(spark, sf_dir).where("qualified").join(black, "site", "left_anti").select("site", "rank")


def top_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five qualifying sites of best rank in each category."""
    w = Window.partitionBy("category").orderBy("rank")
    return sites(spark, sf_dir).where("qualified").withColumn("place", F.row_number().over(w)).where("place <= 5").select("category", "site", "place")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors per site, clipped at 60, in bins of 5."""
    per = synth.observations(spark, sf_dir).groupBy("site").agg(F.countDistinct("vendor").alias("n"))
    return per.groupBy((F.floor(F.least("n", F.lit(60)) / 5) * 5).cast("long").alias("bin")).agg(F.count("*").alias("sites"))


def one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category and by bucket of rank from one scan."""
    s = sites(spark, sf_dir).withColumn("ranks", F.expr(bucket("rank", RANKS)))
    g = s.groupingSets([["category"], ["ranks"]], "category", "ranks").agg(F.count("*").alias("n"), F.count_if("qualified").alias("available"))
    return g.select(F.coalesce("category", "ranks").alias("group_name"), "n", "available")


def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred moving average of three over the rank-ordered prevalence; an end counts itself twice."""
    p = prevalence(spark, sf_dir)
    w = Window.orderBy("rank")
    y = F.col("observations")
    return p.select("rank", F.round((F.coalesce(F.lag(y).over(w), y) + y + F.coalesce(F.lead(y).over(w), y)) / 3, 6).alias("smooth"))


def ranked_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and near percentiles of balances in groups of 250 by rank."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 250").alias("bucket"), "c_acctbal")
    q = lambda p: F.round(F.percentile("c_acctbal", F.lit(p)), 4)
    return c.groupBy("bucket").agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.45).alias("p45"), q(0.55).alias("p55"))


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of balances by category: the element at the rounded place."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), "c_acctbal")
    w = Window.partitionBy("category")
    c = c.withColumn("k", F.row_number().over(w.orderBy("c_acctbal"))).withColumn("n", F.count("*").over(w))
    at = lambda p: F.round(F.max(F.when(F.col("k") == F.bround((F.col("n") - 1) * p / 100.0).cast("int") + 1, F.col("c_acctbal"))), 4)
    return c.groupBy("category").agg(at(10).alias("p10"), at(50).alias("p50"), at(90).alias("p90"))


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vendors of each site, drawn by a hash of the pair and a seed."""
    w = Window.partitionBy("site").orderBy(F.md5(F.concat_ws(":", F.lit("42"), "site", "vendor")), "vendor")
    return synth.observations(spark, sf_dir).select("site", "vendor").distinct().withColumn("k", F.row_number().over(w)).where("k <= 2").select("site", "vendor")


QUERIES = {
    "status_funnel": (status_funnel, "SELECT o_orderstatus AS status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM orders GROUP BY ALL"),
    "qualified_counts": (qualified_counts, f"WITH {SITES}, {VENDORS} SELECT role, count(*) AS n, CAST(count_if(qualified) AS BIGINT) AS available, {percent_sql('count_if(qualified)')} AS percent FROM (SELECT 'site' AS role, qualified FROM sites_ UNION ALL SELECT 'vendor', qualified FROM vendors_) GROUP BY role"),
    "availability_category": (availability_category, f"WITH {SITES} SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, count(*) AS n, CAST(count_if(qualified) AS BIGINT) AS available, {percent_sql('count_if(qualified)')} AS percent FROM sites_ GROUP BY 1 HAVING count(*) >= {MIN_GROUP}"),
    "availability_rank_bucket": (availability_rank, f"WITH {SITES} SELECT {bucket('rank', RANKS)} AS ranks, count(*) AS n, CAST(count_if(qualified) AS BIGINT) AS available, {percent_sql('count_if(qualified)')} AS percent FROM sites_ GROUP BY 1"),
    "vendor_prevalence": (prevalence, f"{PREVALENCE_SQL} SELECT vendor, observations, sites, round(100.0::DOUBLE * sites / (SELECT count(*) FROM customer), 4) AS percent, rank FROM ranked"),
    "prevalence_coverage": (prevalence_coverage, f"{PREVALENCE_SQL}, {VENDORS} SELECT {bucket('rank', PREVALENCE_RANKS)} AS ranks, count(*) AS n, CAST(count_if(qualified) AS BIGINT) AS available, {percent_sql('count_if(qualified)')} AS percent FROM ranked JOIN vendors_ USING (vendor) GROUP BY 1"),
    "top_vendors": (top_vendors, f"{PREVALENCE_SQL}, {VENDORS} SELECT rank, name, observations, round(100.0::DOUBLE * observations / (SELECT sum(observations) FROM ranked), 4) AS share FROM ranked JOIN vendors_ USING (vendor) ORDER BY rank LIMIT 15"),
    "concentration": (concentration, f"{PREVALENCE_SQL} SELECT CAST(top AS INTEGER) AS top, CAST(sum(observations) AS BIGINT) AS observations, round(100.0::DOUBLE * sum(observations) / (SELECT sum(observations) FROM ranked), 4) AS share FROM ranked JOIN {o.values([(n,) for n in TOPS], 'top')} ON rank <= top GROUP BY top"),
    "cumulative_share": (cumulative_share, f"{PREVALENCE_SQL} SELECT rank, round(100.0::DOUBLE * sum(observations) OVER (ORDER BY rank) / sum(observations) OVER (), 4) AS share FROM ranked"),
    "vendors_per_site": (vendors_per_site, f"WITH {OBSERVED}, {VENDORS}, per AS (SELECT site, count(DISTINCT vendor) AS n FROM observed WHERE vendor IN (SELECT vendor FROM vendors_ WHERE qualified) GROUP BY site) SELECT count(*) AS sites, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.75), 4) AS p75, round(quantile_cont(n, 0.9), 4) AS p90, max(n) AS most FROM per"),
    "density_matrix": (density_matrix, f"WITH {OBSERVED}, {SITES} SELECT category, p_type AS kind, count(DISTINCT (site, vendor)) AS pairs, count(DISTINCT site) AS sites, round(count(DISTINCT (site, vendor))::DOUBLE / count(DISTINCT site), 4) AS per_site FROM observed JOIN sites_ USING (site) JOIN part ON p_partkey = part WHERE qualified GROUP BY 1, 2 HAVING count(DISTINCT site) >= {MIN_GROUP}"),
    "tracker_enrichment": (tracker_enrichment, TRACKER_SQL),
    "same_entity_excluded": (same_entity_excluded, SAME_ENTITY_SQL),
    "group_leaders": (group_leaders, LEADERS_SQL),
    "pair_generation": (pair_generation, PAIR_GENERATION_SQL),
    "curated_sites": (curated_sites, f"WITH {SITES} SELECT site, rank FROM sites_ WHERE qualified AND site NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"),
    "top_complete": (top_complete, f"WITH {SITES} SELECT category, site, CAST(row_number() OVER (PARTITION BY category ORDER BY rank) AS INTEGER) AS place FROM sites_ WHERE qualified QUALIFY place <= 5"),
    "histogram_clipped": (histogram, f"WITH {OBSERVED}, per AS (SELECT site, count(DISTINCT vendor) AS n FROM observed GROUP BY site) SELECT CAST(least(n, 60) // 5 * 5 AS BIGINT) AS bin, count(*) AS sites FROM per GROUP BY 1"),
    "category_and_rank_scan": (one_scan, f"WITH {SITES} SELECT coalesce(category, ranks) AS group_name, count(*) AS n, CAST(count_if(qualified) AS BIGINT) AS available FROM (SELECT *, {bucket('rank', RANKS)} AS ranks FROM sites_) GROUP BY GROUPING SETS ((category), (ranks))"),
    "smoothing": (smoothing, f"{PREVALENCE_SQL} SELECT rank, round((coalesce(lag(observations) OVER w, observations) + observations + coalesce(lead(observations) OVER w, observations))::DOUBLE / 3, 6) AS smooth FROM ranked WINDOW w AS (ORDER BY rank)"),
    "ranked_medians": (ranked_medians, "SELECT c_custkey // 250 AS bucket, count(*) AS n, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.45), 4) AS p45, round(quantile_cont(c_acctbal, 0.55), 4) AS p55 FROM customer GROUP BY 1"),
    "nearest_rank": (nearest_rank, "SELECT category, " + ", ".join(f"round(max(CASE WHEN k = CAST(round_even((n - 1) * {p} / 100.0::DOUBLE, 0) AS INTEGER) + 1 THEN c_acctbal END), 4) AS p{p}" for p in (10, 50, 90)) + " FROM (SELECT c_mktsegment AS category, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) GROUP BY category"),
    "pairs_random2": (uniform_sample, f"WITH {OBSERVED} SELECT site, vendor FROM (SELECT DISTINCT site, vendor FROM observed) QUALIFY row_number() OVER (PARTITION BY site ORDER BY md5('42:' || site || ':' || vendor), vendor) <= 2"),
}
