"""Raw names of data types and purposes to canonical ones: dictionary steps as joins on distinct values, fuzzy matching on what is left."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions.text import normal_text

CUTOFF = 0.78


def fuzzy(values: DataFrame, column: str, candidates: list[str]) -> DataFrame:
    """(column, fuzzy): the best candidate by matching blocks, the first in order among equals, null below the cutoff."""
    names = sorted(candidates)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b[column]:
                scores = [SequenceMatcher(None, raw, c).ratio() for c in names]
                top = max(range(len(names)), key=lambda k: (scores[k], -k))
                out.append(names[top] if scores[top] >= CUTOFF else None)
            yield pd.DataFrame({column: b[column], "fuzzy": out})

    return values.mapInPandas(best, f"{column} string, fuzzy string")


def _steps(raw: DataFrame, column: str, table: list, canonical: list[str], contains) -> DataFrame:
    """(column, canonical, is_canonical) of the distinct values of a column."""
    spark = raw.sparkSession
    d = raw.select(column).where(F.col(column).isNotNull()).distinct().withColumn("name", normal_text(F.col(column)))
    d = d.join(o.frame(spark, [(p, c) for p, c, _ in table], "name string, exact string"), "name", "left")
    d = d.withColumn("exact", F.coalesce("exact", F.when(F.col("name").isin(canonical), F.col("name"))))
    open_ = d.where(F.col("exact").isNull() & (F.col("name") != "")).select("name").distinct()
    phrase = o.frame(spark, [(p, c, k) for p, c, k in table], "phrase string, canonical string, place int")
    within = contains(open_.crossJoin(phrase))
    left = open_.join(within, "name", "left")
    misses = left.where("inner_match is null").select("name")
    found = left.join(fuzzy(misses, "name", canonical), "name", "left")
    out = d.join(found, "name", "left")
    out = out.withColumn("canonical", F.coalesce("exact", "inner_match", "fuzzy", "name"))
    return out.select(column, "canonical", F.col("canonical").isin(canonical).alias("is_canonical"))


def data_types(raw: DataFrame, column: str) -> DataFrame:
    """Exact phrase, canonical name, longest phrase of several words contained, fuzzy, else as it is."""

    def contains(pairs: DataFrame) -> DataFrame:
        hit = pairs.where((F.instr("phrase", " ") > 0) & F.expr("concat(' ', regexp_replace(name, '(?U)[^\\\\w]+', ' '), ' ') LIKE concat('% ', regexp_replace(phrase, '(?U)[^\\\\w]+', ' '), ' %')"))
        w = Window.partitionBy("name").orderBy(F.desc(F.length("phrase")), "place")
        return hit.withColumn("k", F.row_number().over(w)).where("k = 1").select("name", F.col("canonical").alias("inner_match"))

    return _steps(raw, column, o.phrases(o.DATA_PHRASES), o.types(), contains)


def purposes(raw: DataFrame, column: str) -> DataFrame:
    """Exact phrase, canonical name, the first phrase that contains it or is contained, fuzzy, else as it is."""

    def contains(pairs: DataFrame) -> DataFrame:
        hit = pairs.where(F.contains("name", "phrase") | F.contains("phrase", "name"))
        return hit.groupBy("name").agg(F.min_by("canonical", "place").alias("inner_match"))

    return _steps(raw, column, o.phrases(o.PURPOSE_PHRASES), sorted(o.NECESSITY), contains)
