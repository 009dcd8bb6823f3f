"""Where outside models plug in: an extractor, a verifier, a labeller. None is called here; answers are replayed from a table, keyed by
a hash of the text and the version, and what has no answer gets the rules' or the fallback's."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ["inconsistent", "unspecified", "non_conflict"]
ALARMS = ["none", "borderline_drafting", "different_context", "different_data", "different_scope", "extraction_error"]


def key(*columns: str, version: str = "1"):
    return F.sha2(F.concat_ws("\u0001", F.lit(version), *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256)


def replay(rows: DataFrame, answers: DataFrame, *columns: str, version: str = "1", beside: tuple[str, ...] = ()) -> DataFrame:
    """rows with the answer to each (key, answer), null where there is none. Columns `beside` are in both and equal where keys are: rows and answers
    that are partitioned by the first of them are then joined where they are, without shuffling their keys."""
    rows, answers = rows.withColumn("key", key(*columns, version=version)), answers.select(*beside, "key", "answer")
    if not beside:
        return rows.join(answers, "key", "left")
    return rows.join(answers, [*beside, "key"], "left")


def called(rows: DataFrame, column: str, model: Callable[[list[str]], list[str]], retries: int = 3, wait: float = 1.0, broken_after: int = 3) -> DataFrame:
    """(column, answer) of the distinct texts that need one, in Arrow batches.

    A failing batch is tried again after waits that double, and then left without answers; once so many batches in a row have failed, a task
    asks no more, and its other texts are left without answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for b in batches:
            answers: list[str | None] = [None] * len(b)
            if failed < broken_after:
                for k in range(retries):
                    try:
                        answers, failed = list(model(b[column].tolist())), 0
                        break
                    except Exception as e:  # an outside service: whatever it raises, the batch is tried again
                        print(f"model call failed: {e}")
                        if k + 1 < retries:
                            time.sleep(wait * 2**k)
                else:
                    failed += 1
            yield pd.DataFrame({column: b[column], "answer": answers})

    return rows.select(column).distinct().mapInPandas(run, f"{column} string, answer string")


def reflected(rows: DataFrame, column: str, model: Callable[[list[str], list[str]], list[str]], rounds: int = 3) -> DataFrame:
    """(column, round, item) of extraction in rounds: each is told what was found and adds what was missed, until nothing is or the rounds are
    over. Equal items count once, at their first round. model: (texts, JSON lists of what was found) to JSON lists of items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[column].tolist()
            found: list[dict[str, int]] = [{} for _ in texts]
            todo = list(range(len(texts)))
            for k in range(rounds):
                answers = model([texts[i] for i in todo], [json.dumps(list(found[i])) for i in todo]) if todo else []
                more = []
                for i, raw in zip(todo, answers):
                    try:
                        items = json.loads(raw or "[]")
                    except ValueError:
                        items = []  # what can't be read says that nothing is missing
                    new = [x for x in (json.dumps(y, sort_keys=True) for y in items) if x not in found[i]]
                    for x in new:
                        found[i].setdefault(x, k)
                    if new:
                        more.append(i)
                todo = more
            yield pd.DataFrame([(t, k, x) for t, f in zip(texts, found) for x, k in f.items()], columns=[column, "round", "item"])

    return rows.select(column).distinct().mapInPandas(run, f"{column} string, round int, item string")


def labelled(rows: DataFrame, column: str, scorer: Callable[[list[str]], list[list[float]]], labels: list[str], thresholds: list[float]) -> DataFrame:
    """rows with `labels`, in their order, whose score comes up to the label's own threshold. Equal texts are scored once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = scorer(b[column].tolist())
            yield pd.DataFrame({"_text": b[column], "labels": [[n for n, t, x in zip(labels, thresholds, s) if x >= t] for s in scores]})

    once = rows.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, "_text string, labels array<string>")
    return rows.join(once, F.col(column) == F.col("_text"), "left").drop("_text").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def scoped(rows: DataFrame, column: str, answers: DataFrame, fallback: Column, known: list[str]) -> DataFrame:
    """rows with `scope`: the replayed answer where it is a known one, else the rules'."""
    out = replay(rows, answers, column)
    said = F.lower(F.trim("answer"))
    return out.withColumn("scope", F.when(said.isin(known), said).otherwise(fallback)).drop("key", "answer")


def cleaned(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(page_id, text): each page's chunks put together again, each as the cleaner's answer has it, or as it was."""
    out = replay(chunks, answers, "text").withColumn("text", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.col("text")))
    return out.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def insert_if_absent(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """What is new to a cache (key, answer): its first writer wins."""
    once = fresh.groupBy("key").agg(F.min("answer").alias("answer"))
    return once.join(cache, "key", "left_anti")


def verified(findings: DataFrame) -> DataFrame:
    """Verdicts of the verifier's JSON answers, checked; without a valid one the fallback, marked as not verified."""
    x = F.from_json(F.coalesce(F.nullif(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), F.lit("")), F.col("answer")), "struct<verdict: string, explanation: string, confidence: string, false_alarm_category: string>")
    df = findings.withColumn("x", x)
    alarm = F.when((F.col("x.verdict") == "non_conflict") & (F.col("x.false_alarm_category") == "none"), "borderline_drafting").otherwise(F.col("x.false_alarm_category"))
    genuine = F.col("x.verdict").isin("inconsistent", "unspecified")
    ok = F.coalesce(F.col("x.verdict").isin(VERDICTS) & (F.length("x.explanation") >= 20) & F.col("x.confidence").isin("low", "medium", "high") & alarm.isin(ALARMS) & ~(genuine & (alarm != "none")), F.lit(False))
    return df.select(
        *[c for c in findings.columns], F.when(ok, F.col("x.verdict")).otherwise("unspecified").alias("llm_verdict"), F.when(ok, F.col("x.confidence")).otherwise("low").alias("llm_confidence"),
        F.when(ok, alarm).otherwise("none").alias("llm_false_alarm_category"), ok.alias("llm_verified"),
    )
