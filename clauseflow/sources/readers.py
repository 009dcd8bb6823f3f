"""Readers of the analysis' inputs, each with an explicit schema; bad rows are kept apart rather than dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICY = "struct<url: string, status_code: int, likeliness_score: double, text_len: int, text_len_raw: int, extraction_method: string, word_count: int, is_english: boolean>"
THIRD_PARTY = (
    "struct<third_party_etld1: string, entity: string, categories: array<string>, prevalence: double, policy_url: string, tracker_radar_source_domain_file: string, "
    "trackerdb_source_pattern_file: string, trackerdb_source_org_file: string, policy_extraction_method: string>"
)
COOKIE = "struct<name: string, value: string, domain: string, path: string, expires: string, secure: boolean, http_only: boolean, same_site: string>"
CRAWL = (
    "rank int, input string, site_url string, final_url string, site_etld1 string, status string, home_status_code int, home_ok boolean, policy_found boolean, policy_is_english boolean, policy_source string, "
    f"first_party_policy {POLICY}, third_parties array<{THIRD_PARTY}>, cookies struct<first_party: array<{COOKIE}>, third_party: map<string, array<{COOKIE}>>>, main_category string, started_at string, ended_at string, _corrupt_record string"
)
MANIFEST = "pair_id string, website_file string, vendor_file string, vendor_name string, service_type string"
POLICIES = "policy_id string, policy_file string, policy_source string"
OVERRIDES = "tp_etld1 string, policy_url string"
CASES = "case_id string, perturbation_type string, pattern_id string, explanation string, statement_1 string, statement_2 string, ground_truth string"


def crawl_records(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records, one JSON object a line, with the fields that reports expect at the top level."""
    df = spark.read.schema(CRAWL).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    words = F.col("first_party_policy.word_count")
    return df.withColumns(
        {
            "first_party_policy_word_count": words,
            "qualified_site": F.coalesce((F.col("status") == "ok") & F.coalesce("policy_is_english", F.col("first_party_policy.is_english")) & (words >= 500), F.lit(False)),
            "started": F.to_timestamp("started_at"),
            "ended": F.to_timestamp("ended_at"),
        }
    )


def policy_cache(spark: SparkSession, path: str) -> DataFrame:
    """(url, text, language, word_count, rediscovered_from_etld1) of sharded maps; of an address in several shards the last one's, by file name."""
    kind = "map<string, struct<text: string, language: string, word_count: int, rediscovered_from_etld1: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("shard"), F.from_json("value", kind).alias("m"))
    rows = raw.select("shard", F.explode("m").alias("url", "x"))
    return rows.groupBy("url").agg(F.max_by("x", "shard").alias("x")).select("url", "x.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def policy_texts(spark: SparkSession, path: str) -> DataFrame:
    """(policy_id, text) of whole text files; the id is the file's stem with underscores for spaces."""
    name = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, " ", "_").alias("policy_id"), F.col("value").alias("text"))


def resolved(path: Column, base: str) -> Column:
    """A path relative to the manifest's folder, made absolute."""
    return F.when(F.startswith(path, F.lit("/")) | path.rlike("^[a-z]+://"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def pair_manifest(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Pairs with absolute paths; a missing id is the pair's place in the file."""
    df = csv_table(spark, path, MANIFEST).withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    df = df.withColumn("pair_id", F.coalesce(F.nullif("pair_id", F.lit("")), F.concat(F.lit("pair_"), "place")))
    return df.withColumns({c: resolved(F.col(c), base) for c in ("website_file", "vendor_file")}).drop("place")


def ranked_sites(ranks: DataFrame, top: int, after: int = 0, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The first `top` domains beyond rank `after`, each at its earliest rank (one seen before `after` doesn't come back)."""
    domain = F.substring_index(F.regexp_replace(F.lower("domain"), r"^www\.", ""), ".", -2)
    df = ranks.select(F.col("rank").cast("int").alias("rank"), domain.alias("domain")).groupBy("domain").agg(F.min("rank").alias("rank"))
    if excluded:
        df = df.where(~F.col("domain").isin(*excluded))
    return df.where(F.col("rank") > after).orderBy("rank").limit(top)


def with_overrides(table: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """Curated rows first; built-in ones fill in the keys that they lack."""
    return table.unionByName(embedded.join(table, key, "left_anti"))


def gold_items(spark: SparkSession, path: str) -> DataFrame:
    """(clause_id, action, data_object, ...) of gold rows, nested in gold_pps or flat."""
    item = "struct<action: string, modality: string, data_object: string, purpose: string, recipient: string, condition: string>"
    fields = "action string, modality string, data_object string, purpose string, recipient string, condition string"
    df = spark.read.schema(f"clause_id string, gold_pps array<{item}>, {fields}").json(path)
    flat = F.array(F.struct("action", "modality", "data_object", "purpose", "recipient", "condition"))
    return df.select("clause_id", F.explode(F.coalesce("gold_pps", flat)).alias("x")).select("clause_id", "x.*").where("action is not null")


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, domain, text, labels) of a headerless file whose labels are a quoted list."""
    df = spark.read.schema("row_id string, domain string, text string, labels string").csv(path, header=False, quote='"', escape='"', multiLine=True)
    return df.withColumn("labels", F.from_json(F.translate("labels", "'", '"'), "array<string>"))


def cdx_candidates(rows: DataFrame, per_site: int = 8) -> DataFrame:
    """Archived addresses of each site that look like policies: distinct, privacy before policy before others, the first few."""
    rank = F.when(F.contains(F.lower("url"), F.lit("privacy")), 0).when(F.contains(F.lower("url"), F.lit("policy")), 1).otherwise(2)
    df = rows.where(F.col("url").rlike("(?i)privacy|policy|legal|terms")).dropDuplicates(["site", "url"])
    return df.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(rank, "url"))).where(F.col("place") <= per_site)


def requested_urls(requests: DataFrame) -> DataFrame:
    """Distinct http(s) addresses of a request log, in order."""
    return requests.select("url").where(F.startswith("url", F.lit("http://")) | F.startswith("url", F.lit("https://"))).distinct().orderBy("url")
