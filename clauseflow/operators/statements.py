"""Raw items of an extractor to typed statements, as column expressions: gates, inferred values, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions import text as t

RAW = "actor action modality data_object purpose recipient condition temporality temporality_value is_negative scope".split()
RIGHTS = ["access_right", "deletion_right", "optout_right", "portability_right"]
GENERIC = ["data", "information", "your data", "your information"]


def blankish(value: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.lower(clean).isin("", "none", "null", "n/a", "na", "unspecified"), "").otherwise(clean)


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def actor_of(value: Column, source: Column) -> Column:
    """Whom a pronoun stands for: the policy's own party."""
    vendor = F.trim(F.regexp_replace(source, "^third_party:", ""))
    own = F.when(F.startswith(source, F.lit("third_party:")), F.when(vendor != "", F.concat(F.lit("ThirdParty:"), vendor)).otherwise("ThirdParty")).otherwise("FirstParty")
    low = F.lower(F.trim(value))
    return F.when(low.isin("", "we", "us", "our", "ours", "company", "the company", "website operator"), own).when(low.isin("you", "user", "users"), "DataSubject").otherwise(F.trim(value))


def recipient_of(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), r"(?i)^(our|their|its)\s+", "")
    suffix = r"(?i),\s*(ag|b\.?v|co|company|corp|corporation|gmbh|group|holdings|inc|limited|llc|llp|lp|ltd|n\.?v|plc|s\.?a|s\.?l|se)\.?\s*$"
    return F.when(F.contains(F.lower(bare), F.lit("google analytics")), "Google Analytics").otherwise(F.trim(F.regexp_replace(bare, suffix, "")))


def temporality_value(kind: Column, value: Column) -> Column:
    found = F.regexp_extract(F.lower(value), r"\b\d+(?:\.\d+)?\s*(?:hour|day|week|month|year)s?\b", 0)
    return F.when((value == "") | (kind == "indefinite"), "").when(found != "", found).when(F.lower(value).isin("never", "at any time"), "").otherwise(value)


def grounded(kind: Column, raw: Column, clause: Column) -> Column:
    """The clause names the object, by its words or those of its canonical type."""
    has = lambda phrase: F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(clause), r"[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(F.lower(phrase), r"[^a-z0-9]+", " "), F.lit(" ")))
    tokens = F.filter(F.split(F.lower(kind), "[^a-z0-9]+"), lambda x: (F.length(x) >= 3) & ~x.isin("data", "information", "personal", "user", "your"))
    return has(raw) | has(kind) | ((F.size(tokens) > 0) & F.forall(tokens, lambda x: F.contains(F.lower(clause), x)))


def build(items: DataFrame, types: DataFrame) -> DataFrame:
    """Statements of raw items (clause_id, clause, section, policy_source and RAW); types: (data_object, canonical) of their objects.

    `reject` says why an item is none ('' if it is)."""
    df = items.select("clause_id", "clause", "section", "policy_source", *[blankish(F.col(c)).alias(c) for c in RAW if c != "is_negative"], truth(F.col("is_negative")).alias("is_negative"))
    df = df.join(types.select(F.col("data_object"), F.col("canonical").alias("data_type")), "data_object", "left").withColumn("data_type", F.coalesce("data_type", t.normal_text(F.col("data_object"))))
    rights = F.col("action").isin(RIGHTS)
    reject = (
        F.when(~F.col("action").isin(o.ACTIONS), "action").when(F.col("data_object") == "", "no_object")
        .when(t.normal_text(F.col("data_object")).isin(GENERIC), "generic").when(~grounded(F.col("data_type"), F.col("data_object"), F.col("clause")), "ungrounded").otherwise("")
    )
    up = F.upper("modality")
    given = F.when(up.isin(o.MODALITIES), up).otherwise("UNSPECIFIED")
    inferred = t.infer_modality(F.col("clause"), F.col("is_negative"))
    modality = F.when(given.isin("UNSPECIFIED", "OBLIGATION") | ((given == "POSSIBILITY") & (inferred == "PERMISSION")), inferred).otherwise(given)
    df = df.withColumns({"reject": reject, "modality": modality, "reason": t.non_practice_reason(F.col("clause"))})
    calm = (F.col("modality") == "PROHIBITION") & (F.col("reason") != "")
    df = df.withColumn("is_negative", F.col("is_negative") & ~calm).withColumn("modality", F.when(calm, F.when(F.col("reason") == "rights", "PERMISSION").otherwise("COMMITMENT")).otherwise(F.col("modality")))
    forbids = (F.col("modality") == "PROHIBITION") | F.col("is_negative")
    undone = forbids & ~t.keeps_prohibition(F.col("clause"))
    df = df.withColumn("modality", F.when(undone, "COMMITMENT").otherwise(F.col("modality"))).withColumn("is_negative", F.col("is_negative") & ~undone)
    known = F.when(F.col("condition").isin(o.CONDITIONS), F.col("condition")).otherwise("unspecified")
    guess = t.infer_condition(F.col("clause"))
    condition = F.when((known == "unspecified") | ((known == "by_default") & (guess == "unspecified")), guess).otherwise(known)
    temporality = F.when(F.col("temporality").isin(o.TEMPORALITIES), F.col("temporality")).otherwise("unspecified")
    recipient = recipient_of(F.col("recipient"))
    recipient = F.when(F.lower(recipient).isin("us", "we", "ourselves", "our company"), "").otherwise(recipient)
    keep = lambda c, none="": F.when(rights, none).otherwise(c)
    endless = (F.col("modality") == "PROHIBITION") & temporality.isin("indefinite", "unspecified")
    return df.select(
        "clause_id", F.col("clause").alias("source_text"), F.col("section").alias("source_section"), "policy_source", actor_of(F.col("actor"), F.col("policy_source")).alias("actor"), "action", "modality", "is_negative", "data_type",
        keep(F.col("purpose")).alias("purpose"), keep(recipient).alias("recipient"), keep(condition, "unspecified").alias("condition"), F.when(rights | endless, "unspecified").otherwise(temporality).alias("temporality"),
        F.when(rights | endless, "").otherwise(temporality_value(temporality, F.col("temporality_value"))).alias("temporality_value"), F.when(F.col("scope") == "", "global").otherwise(F.col("scope")).alias("scope"), "reject",
    )
