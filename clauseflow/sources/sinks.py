"""Writers of results. Spark's commit protocol makes each all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.patterns import PRIORITY


def pair_results(findings: DataFrame, path: str) -> None:
    """One JSON row a pair with all its findings, in priority order."""
    row = F.struct("place", *[c for c in findings.columns if c not in ("site", "vendor", "place")])
    findings.groupBy("site", "vendor").agg(F.array_sort(F.collect_list(row)).alias("findings")).write.json(path)


def findings_csv(findings: DataFrame, statements: DataFrame, path: str) -> None:
    """All findings in priority order with both sentences, cut to 500 characters for the reader, the explanation to 600, categories joined."""
    text = statements.select("sid", F.substring("source_text", 1, 500).alias("text"))
    df = findings.join(text.withColumnsRenamed({"sid": "statement_1", "text": "text_1"}), "statement_1").join(text.withColumnsRenamed({"sid": "statement_2", "text": "text_2"}), "statement_2", "left")
    if "explanation" in df.columns:
        df = df.withColumn("explanation", F.substring("explanation", 1, 600))
    if "categories" in df.columns:
        df = df.withColumn("categories", F.array_join("categories", "; "))
    df.orderBy(F.expr(PRIORITY), "pattern", "site", "vendor", "statement_1", "statement_2").write.csv(path, header=True)


def annotation_template(findings: DataFrame, path: str) -> None:
    """Findings with three blank columns for annotators."""
    findings.select("*", *[F.lit("").alias(c) for c in ("is_true", "annotator", "comment")]).write.csv(path, header=True)


def category_rows(findings: DataFrame) -> DataFrame:
    """A row for each finding and category, one with an empty category where there is none."""
    return findings.withColumn("category", F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(""))))).drop("categories")


def sentence_annotations(sentences: DataFrame, path: str) -> None:
    """A row for each finding and category with both sentences, findings without one of them left out, and three blank columns."""
    both = sentences.where("trim(coalesce(website_sentence, '')) <> '' and trim(coalesce(vendor_sentence, '')) <> ''")
    rows = category_rows(both.withColumn("categories", F.filter(F.split("categories", "; "), lambda c: c != "")))
    rows.select("*", *[F.lit("").alias(c) for c in ("is_true", "annotator", "comment")]).write.csv(path, header=True)


def completeness_json(coverage: DataFrame, path: str) -> None:
    """One JSON object a policy: its coverage as it is, and the missing categories as a list."""
    coverage.withColumn("missing", F.filter(F.split("missing", "; "), lambda c: c != "")).write.json(path)


def ranked_csv(top: DataFrame, path: str) -> None:
    """A ranked report in one file, in the order of its rank."""
    top.coalesce(1).sortWithinPartitions("rank").write.csv(path, header=True)


COVERAGE = "policy covered percent data_handling rights legal missing labels is_complete".split()


def coverage_csv(coverage: DataFrame, role: str, path: str) -> None:
    """The summary of coverage: ten columns, a row for each policy."""
    coverage.select(F.lit(role).alias("role"), *COVERAGE).write.csv(path, header=True)


def report_json(report: DataFrame, key: str, path: str) -> None:
    """A small report as one JSON object from its key to the other columns."""
    rest = F.struct(*[c for c in report.columns if c != key])
    report.groupBy(F.lit(1)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), rest)))).alias("report")).select("report").coalesce(1).write.json(path)


def summary_json(findings: DataFrame, path: str) -> None:
    """Counts by pattern, verdict and severity as one object each."""
    parts = [findings.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).withColumn("by", F.lit(c)) for c in ("pattern", "verdict", "severity")]
    rows = parts[0].union(parts[1]).union(parts[2])
    rows.groupBy("by").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts")).coalesce(1).write.json(path)


def failures(rows: DataFrame, reason: str, path: str) -> bool:
    """Bad rows with the reason, written only if there are any."""
    bad = rows.where(F.col(reason).isNotNull())
    if bad.isEmpty():
        return False
    bad.write.json(path)
    return True


def miss_log(normalised: DataFrame, kind: str, path: str) -> None:
    """Distinct names that no step could normalise."""
    normalised.where("not is_canonical and canonical <> ''").select(F.lit(kind).alias("kind"), F.col("canonical").alias("value")).distinct().write.csv(path, sep="\t", header=False)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
