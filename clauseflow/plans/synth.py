"""Views that read the star schema as a privacy ecosystem, for both engines.

Customers are sites.  Who embeds whom is counted by supplier; the vendors whose policies are compared are the offers of parts, a part by
one of ten groups of suppliers (l_partkey * 10 + l_suppkey % 10), so that vendors grow with the data like sites do. Every order is a statement
of its site and every line item one of its vendor, and every distinct observed (site, vendor) is a pair: nothing is left out.
Statements are made by integer arithmetic only, so that Spark and DuckDB see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..session import compiled

TYPES, ACTIONS = o.types(), ["collect", "use", "share", "sell", "transfer", "retain"]
PURPOSES = [*sorted(o.NECESSITY), ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return compiled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def nth(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def nth_sql(values: list[str], index: str) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({index}) + 1]"


def _template(action: str, kind: str, purpose: str, modality: str, mark: str, number: str) -> str:
    """The sentence of a statement, in SQL that both engines read."""
    end = f"|| ' (clause ' || CAST({number} AS STRING) || ').'"
    aim = f"CASE WHEN {purpose} = '' THEN '' ELSE ' for ' || {purpose} END"
    return (
        f"CASE WHEN {modality} = 'PROHIBITION' AND {mark} % 4 = 0 THEN 'Generally we do not ' || {action} || ' your ' || {kind} {end}"
        f" WHEN {modality} = 'PROHIBITION' THEN 'We will never ' || {action} || ' your ' || {kind} || {aim} {end}"
        f" WHEN {mark} % 5 = 0 THEN 'We only use your ' || {kind} || {aim} {end}"
        f" WHEN {mark} % 7 = 0 THEN 'We may ' || {action} || ' aggregate ' || {kind} || {aim} {end}"
        f" WHEN {mark} % 11 = 0 THEN 'If you are selling with us we ' || {action} || ' your ' || {kind} || {aim} {end}"
        f" ELSE 'We ' || {action} || ' your ' || {kind} || {aim} {end} END"
    )


COLUMNS = "policy, sid, actor, action, modality, data_type, purpose, recipient, condition, temporality, temporality_value, is_negative, source_text, source_section, scope"


def _finish(index: str, side: str) -> str:
    """Statement columns from integers a_, c_, t_, m_, e_, d_, p_, n_ of a row, as SQL for both engines; ? marks array look-ups."""
    actor = "'FirstParty'" if side == "website" else "'ThirdParty:v' || CAST(policy AS STRING)"
    return f"""
SELECT policy, sid, {actor} AS actor, action, modality, data_type, purpose, CASE WHEN n_ % 9 = 0 THEN 'v' || CAST(n_ % 50 AS STRING) ELSE '' END AS recipient, condition, temporality,
  CASE temporality WHEN 'specific_duration' THEN CAST(d_ AS STRING) || ' days' WHEN 'until_purpose' THEN 'as long as necessary' ELSE '' END AS temporality_value,
  n_ % 23 = 0 AS is_negative, {_template('action', 'data_type', 'purpose', 'modality', 'n_', 'n_')} AS source_text,
  CASE WHEN n_ % 6 = 0 THEN 'Section ' || CAST(n_ % 5 AS STRING) ELSE '' END AS source_section,
  CASE WHEN n_ % 13 = 0 THEN 'newsletter' WHEN n_ % 17 = 0 THEN 'eu_residents' ELSE 'global' END AS scope
FROM {index}"""


_SITE = {"a_": "(7*k + 3*c) % 6", "c_": "(13*k + 5*c) % 7", "t_": "(31*k + 17*c) % 90", "m_": "(11*k + 3*c) % 7", "e_": "(29*k + 2*c) % 5", "d_": "1 + (23*k + c) % 730", "p_": "(19*k + 7*c) % 14", "n_": "k + c"}
_VENDOR = {"a_": "(7*d + 5*n + 3*s) % 6", "c_": "(13*p + 5*n + s) % 7", "t_": "(31*p + 17*n) % 90", "m_": "(11*p + s) % 7", "e_": "(29*p + 2*n) % 5", "d_": "1 + (23*p + s) % 730", "p_": "(19*p + 7*n) % 14", "n_": "p + n + s"}


def _named(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    df = df.select("policy", "sid", *[F.expr(e).alias(k) for k, e in exprs.items()])
    kind = F.when(F.col("t_") >= 68, o.ROOT).otherwise(nth(TYPES, F.least(F.col("t_"), F.lit(67))))
    return df.select(
        "policy", "sid", "d_", "n_", nth(ACTIONS, F.col("a_")).alias("action"), nth(o.CONDITIONS, F.col("c_")).alias("condition"), kind.alias("data_type"),
        nth(o.MODALITIES, F.col("m_")).alias("modality"), nth(o.TEMPORALITIES, F.col("e_")).alias("temporality"), nth(PURPOSES, F.col("p_")).alias("purpose"),
    )


def _named_sql(source: str, exprs: dict[str, str]) -> str:
    x = {k: f"CAST({e} AS BIGINT)" for k, e in exprs.items()}
    return f"""SELECT policy, sid, {x['d_']} AS d_, {x['n_']} AS n_, {nth_sql(ACTIONS, x['a_'])} AS action, {nth_sql(o.CONDITIONS, x['c_'])} AS condition,
  CASE WHEN {x['t_']} >= 68 THEN '{o.ROOT}' ELSE {nth_sql(TYPES, f"least({x['t_']}, 67)")} END AS data_type,
  {nth_sql(o.MODALITIES, x['m_'])} AS modality, {nth_sql(o.TEMPORALITIES, x['e_'])} AS temporality, {nth_sql(PURPOSES, x['p_'])} AS purpose FROM {source}"""


def _text_once(statements: DataFrame) -> DataFrame:
    """With the sentence made once a row: a generator's output isn't written out again in each of the many expressions that read it, which would make
    code too large to be compiled."""
    return statements.withColumn("source_text", F.explode(F.array("source_text")))


def site_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("policy"), F.concat(F.lit("w"), "o_orderkey").alias("sid"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return _text_once(spark.sql(_finish("{x}", "website"), x=_named(raw, _SITE)))


VENDOR = "l_partkey * 10 + l_suppkey % 10"


def vendor_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of the vendor for each line item; lines that repeat a key are numbered."""
    lines = table(spark, sf_dir, "lineitem").select(F.expr(VENDOR).alias("s"), F.col("l_orderkey").alias("d"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"))
    # by vendor, as statements are joined; a key's lines are of one vendor
    raw = lines.repartition("s").withColumn("k", F.row_number().over(Window.partitionBy("s", "d", "n").orderBy("p")))
    raw = raw.select(F.col("s").alias("policy"), F.concat_ws("_", F.concat(F.lit("v"), "s"), "d", "n", "k").alias("sid"), "d", "s", "n", "p")
    return _text_once(spark.sql(_finish("{x}", "vendor"), x=_named(raw, _VENDOR)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, vendor) for each line that a site ordered of a vendor; not distinct."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("site"), F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("part"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, vendor): all distinct observed pairs."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("site"), F.expr(VENDOR).alias("vendor")).repartition("vendor").distinct()


SITES_SQL = f"""sites AS ({_finish('site_raw', 'website').replace('AS STRING', 'AS VARCHAR')}),"""
SITE_RAW_SQL = f"""site_raw AS ({_named_sql("(SELECT o_custkey AS policy, 'w' || o_orderkey AS sid, o_orderkey AS k, o_custkey AS c FROM orders)", _SITE)}),"""
VENDOR_RAW_SQL = f"""vendor_raw AS ({_named_sql(f"(SELECT s AS policy, 'v' || s || '_' || d || '_' || n || '_' || row_number() OVER (PARTITION BY s, d, n ORDER BY p) AS sid, d, s, n, p FROM (SELECT {VENDOR} AS s, l_orderkey AS d, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p FROM lineitem))", _VENDOR)}),"""
VENDORS_SQL = f"""vendors AS ({_finish('vendor_raw', 'vendor').replace('AS STRING', 'AS VARCHAR')}),"""
OBSERVED_SQL = "observed AS (SELECT o_custkey AS site, l_suppkey AS vendor, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey),"
PAIRS_SQL = f"pairs AS (SELECT DISTINCT o_custkey AS site, {VENDOR} AS vendor FROM orders JOIN lineitem ON o_orderkey = l_orderkey),"
RELATED_SQL = f"related AS (SELECT * FROM {o.values(o.related(), 'a, b')}),"

#: Everything that the detectors' oracles start from; ends with a comma.
STATEMENTS_SQL = "WITH " + SITE_RAW_SQL + SITES_SQL + VENDOR_RAW_SQL + VENDORS_SQL + PAIRS_SQL + RELATED_SQL
