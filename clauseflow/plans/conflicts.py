"""Queries of the conflict detectors over the synthetic statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions import text as t
from ..operators import patterns as p
from . import synth


def _cross(detect):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect(synth.site_statements(spark, sf_dir), synth.vendor_statements(spark, sf_dir), synth.pairs(spark, sf_dir))

    return query


def _within(detect):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect(synth.site_statements(spark, sf_dir))

    return query


def cross_policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors, modality findings capped per sentence, exact repeats dropped, in priority order within the pair."""
    out = p.all_cross(synth.site_statements(spark, sf_dir), synth.vendor_statements(spark, sf_dir), synth.pairs(spark, sf_dir))
    return p.prioritised(out).select("pattern", "site", "vendor", "statement_1", "statement_2", "verdict", "severity", "n_violations", "evidence", "place")


def with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings with both statements' trimmed texts, the explanation and the first one's type."""
    return p.prioritised(p.all_cross(synth.site_statements(spark, sf_dir), synth.vendor_statements(spark, sf_dir), synth.pairs(spark, sf_dir), texts=True))


_PARTS = {"modality": p.modality_cross_sql, "exclusivity": p.exclusivity_cross_sql, "condition": p.condition_cross_sql, "retention": p.retention_cross_sql}


def all_findings_sql() -> str:
    """A WITH clause that ends in the table `findings`; each detector's own tables are local to it."""
    parts = ", ".join(f"{k}_all AS ({sql()})" for k, sql in _PARTS.items())
    texts = synth.STATEMENTS_SQL.rstrip(", ")
    return (
        f"{texts}, {parts}, both_sides AS (SELECT sid, trim(source_text) AS text, length(source_text) AS size, {p.DERIVED['evidence']} AS evidence FROM (SELECT * FROM sites UNION ALL SELECT * FROM vendors)), "
        "capped AS (SELECT m.* FROM modality_all m JOIN both_sides s ON s.sid = m.statement_1 JOIN both_sides v ON v.sid = m.statement_2 QUALIFY row_number() OVER (PARTITION BY m.site, m.vendor, s.text "
        f"ORDER BY severity, n_violations DESC, v.size DESC, statement_1, statement_2) <= {p.PER_SENTENCE}), "
        "every AS (SELECT * FROM capped UNION ALL SELECT * FROM exclusivity_all UNION ALL SELECT * FROM condition_all UNION ALL SELECT * FROM retention_all), "
        f"findings AS (SELECT e.*, CAST({p.WEIGHT.replace('{1}', 'x.').replace('{2}', 'y.')} AS INTEGER) AS evidence FROM every e JOIN both_sides x ON x.sid = e.statement_1 JOIN both_sides y ON y.sid = e.statement_2 "
        "QUALIFY row_number() OVER (PARTITION BY site, vendor, pattern, x.text, y.text ORDER BY severity, n_violations DESC, statement_1, statement_2) = 1)"
    )


def cross_policy_findings_sql() -> str:
    order = f"{p.PRIORITY}, pattern <> 'modality', evidence DESC, pattern, statement_1, statement_2"
    return f"{all_findings_sql()} SELECT pattern, site, vendor, statement_1, statement_2, verdict, severity, n_violations, evidence, CAST(row_number() OVER (PARTITION BY site, vendor ORDER BY {order}) AS INTEGER) AS place FROM findings"


def _pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict a pair: inconsistent over underspecified over none."""
    found = cross_policy_findings(spark, sf_dir).groupBy("site", "vendor").agg(F.min(F.expr(o.case("verdict", p.VERDICT_RANK, 9))).alias("rank"))
    pairs = synth.pairs(spark, sf_dir).join(found, ["site", "vendor"], "left")
    return pairs.withColumn("verdict", F.when(F.col("rank") == 0, "inconsistent").when(F.col("rank") == 1, "underspecified").otherwise("no_finding"))


_PAIR_SQL = f"pair_rank AS (SELECT site, vendor, min({o.case('verdict', p.VERDICT_RANK, 9)}) AS rank FROM findings GROUP BY ALL), pair_verdict AS (SELECT p.site, p.vendor, CASE rank WHEN 0 THEN 'inconsistent' WHEN 1 THEN 'underspecified' ELSE 'no_finding' END AS verdict FROM pairs p LEFT JOIN pair_rank USING (site, vendor))"


def pair_verdict_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by verdict, those without finding included, with shares."""
    v = _pair_verdicts(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("pairs"))
    total = F.sum("pairs").over(Window.partitionBy(F.lit(1)))
    return v.withColumn("share", F.round(F.col("pairs") * 100.0 / total, 4))


def pair_verdict_mix_sql() -> str:
    return f"{all_findings_sql()}, {_PAIR_SQL} SELECT verdict, count(*) AS pairs, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM pair_verdict GROUP BY verdict"


def party_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and vendors with an inconsistent pair among those in any pair."""
    v = _pair_verdicts(spark, sf_dir).withColumn("bad", F.col("verdict") == "inconsistent")
    out = None
    for role in ("site", "vendor"):
        each = v.groupBy(role).agg(F.bool_or("bad").alias("bad"))
        one = each.agg(F.lit(role).alias("role"), F.count("*").alias("n"), F.count_if("bad").alias("inconsistent"))
        out = one if out is None else out.union(one)
    return out.withColumn("percent", F.round(F.col("inconsistent") * 100.0 / F.col("n"), 4))


def party_inconsistency_sql() -> str:
    one = "SELECT '{0}' AS role, count(*) AS n, count_if(bad) AS inconsistent FROM (SELECT {0}, bool_or(verdict = 'inconsistent') AS bad FROM pair_verdict GROUP BY {0})"
    both = " UNION ALL ".join(one.format(r) for r in ("site", "vendor"))
    return f"{all_findings_sql()}, {_PAIR_SQL} SELECT role, n, CAST(inconsistent AS BIGINT) AS inconsistent, round(inconsistent * 100.0::DOUBLE / n, 4) AS percent FROM ({both})"


def verdict_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns against verdicts with margins."""
    f = cross_policy_findings(spark, sf_dir).rollup("pattern").agg(F.count_if(F.col("verdict") == "inconsistent").alias("inconsistent"), F.count_if(F.col("verdict") == "underspecified").alias("underspecified"), F.count("*").alias("total"))
    return f.withColumn("pattern", F.coalesce("pattern", F.lit("all"))).withColumn("inconsistent_percent", F.round(F.col("inconsistent") * 100.0 / F.col("total"), 4))


def verdict_crosstab_sql() -> str:
    return f"{all_findings_sql()} SELECT coalesce(pattern, 'all') AS pattern, CAST(count_if(verdict = 'inconsistent') AS BIGINT) AS inconsistent, CAST(count_if(verdict = 'underspecified') AS BIGINT) AS underspecified, count(*) AS total, round(count_if(verdict = 'inconsistent') * 100.0::DOUBLE / count(*), 4) AS inconsistent_percent FROM findings GROUP BY ROLLUP (pattern)"


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity and verdict, combinations without any as zero."""
    grid = o.frame(spark, [(s, v) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW") for v in ("inconsistent", "underspecified", "non_conflict")], "severity string, verdict string")
    n = cross_policy_findings(spark, sf_dir).groupBy("severity", "verdict").agg(F.count("*").alias("n"))
    return grid.join(n, ["severity", "verdict"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def finding_counts_sql() -> str:
    grid = o.values([(s, v) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW") for v in ("inconsistent", "underspecified", "non_conflict")], "severity, verdict")
    return f"{all_findings_sql()}, grid AS (SELECT * FROM {grid}) SELECT g.severity, g.verdict, count(f.pattern) AS n FROM grid g LEFT JOIN findings f USING (severity, verdict) GROUP BY ALL"


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of inconsistent pairs for each segment of sites and class of vendors."""
    c, s = synth.table(spark, sf_dir, "customer"), synth.table(spark, sf_dir, "part")
    v = _pair_verdicts(spark, sf_dir).join(c, F.col("site") == F.col("c_custkey")).join(s, F.expr("vendor div 10") == F.col("p_partkey"))
    g = v.groupBy(F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("vendor_class"))
    return g.agg(F.count("*").alias("pairs"), F.count_if(F.col("verdict") == "inconsistent").alias("inconsistent")).withColumn("percent", F.round(F.col("inconsistent") * 100.0 / F.col("pairs"), 4))


def heatmap_sql() -> str:
    return f"{all_findings_sql()}, {_PAIR_SQL} SELECT c_mktsegment AS segment, p_brand AS vendor_class, count(*) AS pairs, CAST(count_if(verdict = 'inconsistent') AS BIGINT) AS inconsistent, round(count_if(verdict = 'inconsistent') * 100.0::DOUBLE / count(*), 4) AS percent FROM pair_verdict JOIN customer ON c_custkey = site JOIN part ON p_partkey = vendor // 10 GROUP BY ALL"


def website_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each website statement is or isn't compared with vendors'."""
    s = synth.site_statements(spark, sf_dir)
    return s.select("sid", t.website_reject({c: F.col(c) for c in s.columns}).alias("reject"))


def website_eligibility_sql() -> str:
    return f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT sid, {t.website_reject_sql('x')} AS reject FROM sites x"


QUERIES = {
    "website_eligibility": (website_eligibility, website_eligibility_sql),
    "modality_cross": (_cross(p.modality_cross), p.modality_cross_sql),
    "modality_graph": (_cross(p.modality_graph), p.modality_graph_sql),
    "modality_within": (_within(p.modality_within), p.modality_within_sql),
    "exclusivity_cross": (_cross(p.exclusivity_cross), p.exclusivity_cross_sql),
    "exclusivity_within": (_within(p.exclusivity_within), p.exclusivity_within_sql),
    "condition_cross": (_cross(p.condition_cross), p.condition_cross_sql),
    "condition_within": (_within(p.condition_within), p.condition_within_sql),
    "retention_cross": (_cross(p.retention_cross), p.retention_cross_sql),
    "retention_within": (_within(p.retention_within), p.retention_within_sql),
    "cross_policy_findings": (cross_policy_findings, cross_policy_findings_sql),
    "pair_verdict_mix": (pair_verdict_mix, pair_verdict_mix_sql),
    "party_inconsistency": (party_inconsistency, party_inconsistency_sql),
    "verdict_crosstab": (verdict_crosstab, verdict_crosstab_sql),
    "finding_counts": (finding_counts, finding_counts_sql),
    "inconsistency_heatmap": (heatmap, heatmap_sql),
}
