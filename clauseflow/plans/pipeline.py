"""Queries of statement building, verification, streaming and the remaining infrastructure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions import text as t
from ..operators import models, normalise, statements
from ..streaming import incremental
from . import fixtures, synth
from .conflicts import cross_policy_findings

ITEMS = [
    ("We share your email address with our partners.", "we", "share", "PERMISSION", "email address", "marketing", "our partners", "", "", "", "no", ""),
    ("We will never sell your phone number.", "the company", "sell", "PROHIBITION", "phone number", "", "", "", "indefinite", "forever", "true", "global"),
    ("We do not sell your name unless you agree.", "we", "sell", "PROHIBITION", "name", "", "", "", "", "", "true", ""),
    ("You have the right to access your data.", "you", "access_right", "UNSPECIFIED", "personal information", "none", "n/a", "", "", "", "0", ""),
    ("We keep transaction history for 5 years.", "we", "retain", "", "transaction history", "legal compliance", "", "", "specific_duration", "for 5 years", "", ""),
    ("We collect things.", "we", "collect", "PERMISSION", "data", "", "", "", "", "", "", ""),
    ("We collect cookies.", "we", "fly", "PERMISSION", "cookies", "", "", "", "", "", "", ""),
    ("We use your location with your consent.", "we", "use", "MAYBE", "location", "analytics", "Acme, Inc.", "sometimes", "sometime", "", "", "eu_residents"),
    ("We use your location.", "we", "use", "", "shoe size", "", "", "", "", "", "", ""),
    ("We send ip addresses to Google Analytics servers.", "", "transfer", "POSSIBILITY", "ip addresses", "analytics", "the Google Analytics team", "by_default", "", "", "", ""),
]


def build_pps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed statements of raw items, with why an item is none."""
    rows = [(str(k), x[0], "", "first_party" if k % 2 else "third_party:acme", *x[1:]) for k, x in enumerate(ITEMS)]
    items = spark.createDataFrame(rows, "clause_id string, clause string, section string, policy_source string, " + ", ".join(f"{c} string" for c in statements.RAW))
    return statements.build(items, normalise.data_types(items, "data_object"))


def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of replayed answers: every third finding has a valid one, every third an invalid one, the rest none."""
    f = cross_policy_findings(spark, sf_dir)
    k = F.pmod(F.xxhash64("statement_1", "statement_2", "pattern"), F.lit(3))
    good = F.to_json(F.struct(F.lit("inconsistent").alias("verdict"), F.lit("The two statements can't both hold.").alias("explanation"), F.lit("high").alias("confidence"), F.lit("none").alias("false_alarm_category")))
    answers = f.select("site", models.key("pattern", "statement_1", "statement_2").alias("key"), F.when(k == 0, good).when(k == 1, '{"verdict": "perhaps"}').alias("answer")).where("answer is not null")
    out = models.verified(models.replay(f, answers, "pattern", "statement_1", "statement_2", beside=("site",)))
    return out.groupBy("llm_verdict", "llm_confidence", "llm_false_alarm_category", "llm_verified").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind, run through a stream to its end."""
    name = f"windows_{uuid.uuid4().hex}"
    src = incremental.stream(spark, f"{sf_dir}/event*.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    g = src.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    q = g.select(F.col("w.start").alias("start"), "event_type", "n", "total").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def scope_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the scope that their words give."""
    return synth.table(spark, sf_dir, "documents").groupBy(t.infer_scope(F.col("text")).alias("scope")).agg(F.count("*").alias("n"))


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result depends on: versions and the hash of the ontology."""
    text = ";".join(f"{a}>{b}" for a, b in o.edges())
    return spark.range(1).select(F.sha2(F.lit(text), 256).alias("ontology"), F.lit(len(o.types())).alias("types"), F.lit(len(fixtures.CLAUSES)).alias("fixture_clauses"))


def _metadata_sql() -> str:
    text = ";".join(f"{a}>{b}" for a, b in o.edges())
    return f"SELECT sha256('{text}') AS ontology, CAST({len(o.types())} AS INTEGER) AS types, CAST({len(fixtures.CLAUSES)} AS INTEGER) AS fixture_clauses"


QUERIES = {
    "build_pps": (build_pps, None),
    "verify_findings": (verify_findings, None),
    "event_windows": (event_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "scope_of_documents": (scope_of_documents, lambda: f"SELECT {t.infer_scope_sql('text')} AS scope, count(*) AS n FROM documents GROUP BY 1"),
    "run_metadata": (run_metadata, _metadata_sql),
}
