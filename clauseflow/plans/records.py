"""Statements as records: sides, negative practices, names, deduplication, sentences and their surroundings, coverage by clause.

Fixture clauses carry the signs; where a rule reads free text it runs over all documents too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..operators.labels import labels_sql, rule_labels
from ..operators.patterns import spread
from . import fixtures, synth
from .conflicts import all_findings_sql, cross_policy_findings, cross_policy_findings_sql, with_texts
from .synth import table

_NOT = r"\b(?:can|did|do|does|shall|will)\s+not\s+"
#: What denies each action: verbs after a negation, and after "never".
DENIED = {"collect": ("collect", "collect"), "use": ("use", "use"), "share": ("share|disclos(?:e|ing)", "share"), "sell": ("sell", "sell"), "retain": ("retain|keep|store", "retain"), "transfer": ("transfer", "transfer"), "process": ("process", "process")}
SCOPED = (
    r"\b(?:unless\s+(?:you|they|the\s+user)\s+(?:explicitly|expressly|specifically)?\s*(?:agree|choose|consent|decide|log|opt|sign)|except\s+(?:as|in|when|where)\s+(?:described|noted|outlined|permitted|required|specified|stated)"
    r"|in\s+(?:this|that)\s+(?:case|context|regard)|(?:only|solely)\s+(?:if|when|where)\s+(?:it|the\s+user|they|we|you)|to\s+the\s+extent\s+(?:necessary|permitted|required|that)|does\s+not\s+apply\s+(?:in|to|when|where))\b"
)
ADS = _NOT + r"(?:process|use)\b.*\b(?:ads|advertising|marketing|personalized ads|targeted advertising)\b"
OPTIONAL = r"\bnot required to provide\b|\bif you (?:choose|wish) to provide\b|\boptional(?:ly)? provide\b"
PRACTICE = r"\b(?:our|service providers|third parties|vendors?|we)\s+(?:can\s+|could\s+|do\s+|does\s+|may\s+|might\s+|will\s+)?(?:collect|disclose|keep|process|retain|sell|share|store|transfer|use)\b"
_TARGETED = ["advertising", "marketing", "targeted advertising"]


def denial(action: str) -> str:
    verbs, never = DENIED[action]
    return rf"{_NOT}(?:{verbs})\b|\bnever\s+(?:{never})\b"


def negative_practice(text: Column, action: Column, purpose: Column) -> Column:
    """A practice is denied outright: not within a scope, not with an exception."""
    low = F.lower(text)
    hit = F.lit(False)
    for a in DENIED:
        hit = hit | ((action == a) & low.rlike(denial(a)))
    ads = action.isin("use", "process") & purpose.isin(_TARGETED) & low.rlike(ADS)
    return F.coalesce((hit | ads) & ~low.rlike(SCOPED), F.lit(False))


def negative_sql(text: str, action: str, purpose: str) -> str:
    hit = " OR ".join(f"({action} = '{a}' AND regexp_matches(lower({text}), '{denial(a)}'))" for a in DENIED)
    return f"coalesce(({hit} OR ({action} IN ('use', 'process') AND {purpose} IN ('advertising', 'marketing', 'targeted advertising') AND regexp_matches(lower({text}), '{ADS}'))) AND NOT regexp_matches(lower({text}), '{SCOPED}'), false)"


def negative_practices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites' statements that deny their practice, and vendors'."""
    both = synth.site_statements(spark, sf_dir).select("sid", "source_text", "action", "purpose").union(synth.vendor_statements(spark, sf_dir).select("sid", "source_text", "action", "purpose"))
    return both.select("sid", negative_practice(F.col("source_text"), F.col("action"), F.col("purpose")).alias("denied"))


def optional_input(text: Column) -> Column:
    """A clause says only that something needn't be given."""
    return F.coalesce(F.lower(text).rlike(OPTIONAL) & ~F.lower(text).rlike(PRACTICE), F.lit(False))


EXTRA = [
    "You are not required to provide your birthday.", "If you choose to provide a photo, we may store it.", "If you wish to provide feedback, write to the address below.", "We will not share your email unless you agree.",
    "We do not sell your data.", "We never keep card numbers.", "We do not use your location for advertising.", "In this context we do not share it.", "Vendors do not disclose names.",
]


def clause_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional input, and each action's denial, in fixture clauses and in all documents."""
    c = o.frame(spark, [(-1 - k, x) for k, x in enumerate(fixtures.CLAUSES + EXTRA)], "id long, text string").union(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return c.select("id", optional_input(F.col("text")).alias("optional"), *[negative_practice(F.col("text"), F.lit(a), F.lit("advertising")).alias(f"no_{a}") for a in sorted(DENIED)])


_CLAUSES = f"c AS (SELECT CAST(id AS BIGINT) AS id, text FROM {o.values([(-1 - k, x) for k, x in enumerate(fixtures.CLAUSES + EXTRA)], 'id, text')} UNION ALL SELECT doc_id, text FROM documents)"
CLAUSE_RULES_SQL = f"WITH {_CLAUSES} SELECT id, coalesce(regexp_matches(lower(text), '{OPTIONAL}') AND NOT regexp_matches(lower(text), '{PRACTICE}'), false) AS optional, " + ", ".join(f"{negative_sql('text', repr(a), repr('advertising'))} AS no_{a}" for a in sorted(DENIED)) + " FROM c"

GENERIC = {f"{a}{b}" for a in ("", "your ", "their ", "the ", "this ", "that ", "all ", "any ", "other ", "unspecified ", "collected ") for b in ("data", "information")} | {"additional information", "data we collect", "information we collect", "unspecified personal data"}
ACTOR_MARKS = {
    "DataSubject": "data subject|end user|visitor|individual|customer|you", "FirstParty": "first party|firstparty|our company|the company|the website|website operator|the service|we",
    "ThirdParty": "third part|partner|vendor|service provider|advertiser|analytics provider|affiliate",
}
ACTORS = [
    ("We", "acme"), ("", "acme"), ("the user's data subject", "acme"), ("ACME Inc", "acme"), ("ThirdParty:Google", "acme"), ("thirdparty:", "acme"), ("trusted partners", "acme"), ("cookies", "acme"), ("Trustpilot", "acme"),
    ("our advertisers", "acme"), ("you", "acme"), ("the website", "acme"), ("Data information", "acme"), ("all data", "acme"),
]


def actor_name(raw: Column, own: Column) -> Column:
    """Whom a name stands for, given what the first party is called."""
    low = F.lower(F.trim(raw))
    mark = lambda who: low.rlike(r"\b(?:" + ACTOR_MARKS[who] + ")")
    named = F.trim(F.regexp_replace(F.trim(raw), "(?i)^thirdparty:", ""))
    return (
        F.when(low == "", "FirstParty").when(mark("DataSubject"), "DataSubject").when(mark("FirstParty"), "FirstParty").when(F.contains(low, F.lower(own)) | F.contains(F.lower(own), low), "FirstParty")
        .when(F.startswith(low, F.lit("thirdparty:")), F.when(named == "", "ThirdParty").otherwise(named)).when(mark("ThirdParty") | low.isin("cookies", "these cookies", "tracking cookies"), "ThirdParty").otherwise(F.trim(raw))
    )


def actor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture actors by name, and whether as an object they would be too general."""
    a = o.frame(spark, [(k, *x) for k, x in enumerate(ACTORS)], "id int, raw string, own string")
    return a.select("id", actor_name(F.col("raw"), F.col("own")).alias("actor"), F.lower(F.trim("raw")).isin(sorted(GENERIC)).alias("generic"))


ACTOR_SQL = (
    "SELECT CAST(id AS INTEGER) AS id, CASE WHEN low = '' THEN 'FirstParty' " + " ".join(f"WHEN regexp_matches(low, '\\b(?:{ACTOR_MARKS[k]})') THEN '{k}'" for k in ("DataSubject", "FirstParty")) + " WHEN contains(low, own) OR contains(own, low) THEN 'FirstParty' "
    "WHEN starts_with(low, 'thirdparty:') THEN CASE WHEN low = 'thirdparty:' THEN 'ThirdParty' ELSE trim(substr(trim(raw), 12)) END " + f"WHEN regexp_matches(low, '\\b(?:{ACTOR_MARKS['ThirdParty']})') OR low IN ('cookies', 'these cookies', 'tracking cookies') THEN 'ThirdParty' ELSE trim(raw) END AS actor, "
    f"low IN ({','.join(repr(x) for x in sorted(GENERIC))}) AS generic FROM (SELECT *, lower(trim(raw)) AS low FROM {o.values([(k, *x) for k, x in enumerate(ACTORS)], 'id, raw, own')})"
)


def statement_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of both sides in one table, each with its side by the prefix of its source, kept once by id, and its place in the order by length."""
    w = synth.site_statements(spark, sf_dir).withColumn("policy_source", F.lit("first_party"))
    v = synth.vendor_statements(spark, sf_dir).withColumn("policy_source", F.concat(F.lit("third_party:v"), "policy"))
    # as many parts as the tables' bytes ask for, so that a task's share doesn't grow with them
    parts = spread(table(spark, sf_dir, "lineitem"))
    once = w.unionByName(v).select("sid", "policy_source", "policy", "data_type", "source_text").repartition(parts, "sid").groupBy("sid").agg(F.min(F.struct("policy_source", "policy", "data_type", "source_text")).alias("x")).select("sid", "x.policy_source", "x.policy", F.length("x.data_type").alias("n_type"), F.length("x.source_text").alias("n_text")).repartition(parts, "policy")
    side = F.when(F.startswith("policy_source", F.lit("third_party")), "vendor").otherwise("website")
    place = F.row_number().over(Window.partitionBy(side, "policy").orderBy("n_type", "n_text", "sid"))
    return once.select("sid", side.alias("side"), place.alias("place"))


SIDES_SQL = (
    f"{synth.STATEMENTS_SQL.rstrip(', ')}, u AS (SELECT sid, policy, data_type, source_text, 'website' AS side FROM sites UNION ALL SELECT sid, policy, data_type, source_text, 'vendor' FROM vendors) "
    "SELECT sid, side, CAST(row_number() OVER (PARTITION BY side, policy ORDER BY length(data_type), length(source_text), sid) AS INTEGER) AS place FROM u"
)

ITEM = ["policy", "action", "modality", "data_type", "purpose", "recipient", "condition", "temporality", "temporality_value", "is_negative"]


def reflection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of several rounds, each distinct one once: of the first round that has it, at its first place. Here an order's rounds are the residues of its id."""
    s = synth.site_statements(spark, sf_dir).withColumn("k", F.substring("sid", 2, 20).cast("long")).withColumn("round", (F.col("k") % 3).cast("int"))
    return s.groupBy(*ITEM).agg(F.min(F.struct("round", "k")).alias("first"), F.count("*").alias("seen")).select("policy", F.col("first.round").alias("round"), F.col("first.k").alias("item"), "seen")


DEDUP_SQL = f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT policy, CAST(k % 3 AS INTEGER) AS round, k AS item, seen FROM (SELECT *, CAST(substr(sid, 2) AS BIGINT) AS k, count(*) OVER (PARTITION BY {', '.join(ITEM)}) AS seen FROM sites) QUALIFY row_number() OVER (PARTITION BY {', '.join(ITEM)} ORDER BY k % 3, k) = 1"


def skipped_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no statement would be taken from, by why, with the others."""
    n = F.length(F.trim("text"))
    why = F.when(F.col("text").isNull() | (n == 0), "empty").when(n < 200, "too short").when(optional_input(F.col("text")), "optional input").when(~F.lower("text").rlike(r"[a-z]{3}"), "no words").otherwise("used")
    return table(spark, sf_dir, "documents").groupBy(why.alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"))


SKIPPED_SQL = f"SELECT CASE WHEN text IS NULL OR length(trim(text, ' ')) = 0 THEN 'empty' WHEN length(trim(text, ' ')) < 200 THEN 'too short' WHEN regexp_matches(lower(text), '{OPTIONAL}') AND NOT regexp_matches(lower(text), '{PRACTICE}') THEN 'optional input' WHEN NOT regexp_matches(lower(text), '[a-z]{{3}}') THEN 'no words' ELSE 'used' END AS reason, count(*) AS n, round(avg(length(trim(text, ' '))), 4) AS mean_chars FROM documents GROUP BY 1"


def _text_labels(text: Column) -> Column:
    none = F.lit("")
    return rule_labels(text, none, none, none, F.lit("unspecified"), none)


def clause_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that each site's clauses show by their text alone, every clause counted, beside those of its statements: what was not
    extracted, and what only the statements have."""
    s = synth.site_statements(spark, sf_dir)
    full = rule_labels(*map(F.col, ("source_text", "action", "purpose", "recipient", "temporality", "data_type")))
    both = s.select("policy", _text_labels(F.col("source_text")).alias("c"), full.alias("p"))
    sets = both.groupBy("policy").agg(F.count("*").alias("clauses"), F.sum(F.size("c")).alias("clause_labels"), F.array_distinct(F.flatten(F.collect_set("c"))).alias("c"), F.array_distinct(F.flatten(F.collect_set("p"))).alias("p"))
    text = lambda x: F.array_join(F.array_sort(x), "; ")
    return sets.select(
        "policy", "clauses", "clause_labels", F.round(F.size("c") * 100.0 / 18, 1).alias("clause_percent"), F.round(F.size("p") * 100.0 / 18, 1).alias("statement_percent"), F.round(F.round(F.size("c") * 100.0 / 18, 1) - F.round(F.size("p") * 100.0 / 18, 1), 1).alias("delta"),
        text(F.array_except("c", "p")).alias("gap"), text(F.array_except("p", "c")).alias("only_statements"), (F.size("p") == 18).alias("complete"),
    )


def clause_coverage_sql() -> str:
    blank = "(SELECT sid, policy, source_text, '' AS action, '' AS purpose, '' AS recipient, 'unspecified' AS temporality, '' AS data_type FROM sites)"
    d = "100.0::DOUBLE / 18, 1)"
    return (
        f"{synth.STATEMENTS_SQL.rstrip(', ')}, cl AS ({labels_sql(blank)}), pl AS ({labels_sql('sites')}), c AS (SELECT DISTINCT policy, unnest(categories) AS category FROM cl), q AS (SELECT DISTINCT policy, unnest(categories) AS category FROM pl), "
        "n AS (SELECT policy, count(*) AS clauses, CAST(sum(len(categories)) AS BIGINT) AS clause_labels FROM cl GROUP BY policy), m AS (SELECT policy, category, c.category IS NOT NULL AS in_c, q.category IS NOT NULL AS in_p FROM c FULL JOIN q USING (policy, category)), "
        "g AS (SELECT policy, count_if(in_c) AS nc, count_if(in_p) AS np, string_agg(CASE WHEN in_c AND NOT in_p THEN category END, '; ' ORDER BY category) AS gap, string_agg(CASE WHEN in_p AND NOT in_c THEN category END, '; ' ORDER BY category) AS only_p FROM m GROUP BY policy) "
        f"SELECT policy, clauses, clause_labels, round(coalesce(nc, 0) * {d} AS clause_percent, round(coalesce(np, 0) * {d} AS statement_percent, round(round(coalesce(nc, 0) * {d} - round(coalesce(np, 0) * {d}, 1) AS delta, coalesce(gap, '') AS gap, coalesce(only_p, '') AS only_statements, coalesce(np, 0) = 18 AS complete FROM n LEFT JOIN g USING (policy)"
    )


def complete_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many policies disclose everything, and most of it, with shares."""
    c = clause_coverage(spark, sf_dir)
    return c.agg(F.count("*").alias("policies"), F.count_if("complete").alias("complete"), F.round(100.0 * F.count_if("complete") / F.count("*"), 4).alias("percent"), F.count_if(F.col("statement_percent") >= 50).alias("half"))


def finding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with the site's and the vendor's sentence, whichever statement comes first, its categories in canonical order and a label of
    the policies."""
    df = with_texts(spark, sf_dir)
    first = F.startswith("statement_1", F.lit("w"))
    union = F.array_join(F.array_compact(F.array(*[F.when(F.col("shown").bitwiseAND(F.lit(1 << k)) != 0, c) for k, c in enumerate(o.CATEGORIES)])), "; ")
    return df.select(
        "pattern", "statement_1", "statement_2", F.when(first, F.col("text_1")).otherwise(F.col("text_2")).alias("website_sentence"), F.when(first, F.col("text_2")).otherwise(F.col("text_1")).alias("vendor_sentence"),
        union.alias("categories"), F.concat(F.lit("site "), F.col("site").cast("string"), F.lit(" / vendor "), F.col("vendor").cast("string")).alias("label"),
        F.sha2(F.concat_ws("|", F.lit("1"), "pattern", "text_1", "text_2"), 256).alias("pair_key"),
    )


def finding_sentences_sql() -> str:
    every = f"every_label AS ({labels_sql('(SELECT * FROM sites UNION ALL SELECT * FROM vendors)')})"
    cats = ", ".join(f"'{c}'" for c in o.CATEGORIES)
    return (
        f"{all_findings_sql()}, {every} SELECT pattern, statement_1, statement_2, CASE WHEN starts_with(statement_1, 'w') THEN trim(x.source_text) ELSE trim(y.source_text) END AS website_sentence, CASE WHEN starts_with(statement_1, 'w') THEN trim(y.source_text) ELSE trim(x.source_text) END AS vendor_sentence, "
        f"array_to_string(list_filter([{cats}], lambda c: list_contains(x.categories, c) OR list_contains(y.categories, c)), '; ') AS categories, 'site ' || site || ' / vendor ' || vendor AS label, sha256('1|' || pattern || '|' || trim(x.source_text) || '|' || trim(y.source_text)) AS pair_key "
        "FROM findings f JOIN every_label x ON x.sid = statement_1 JOIN every_label y ON y.sid = statement_2"
    )


def supporting_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each statement in a site's finding, five other statements of the same type, prohibitions first: a top-k report."""
    s = synth.site_statements(spark, sf_dir)
    polar = F.when(F.col("is_negative") | (F.col("modality") == "PROHIBITION"), 0).otherwise(1)
    found = cross_policy_findings(spark, sf_dir).where("statement_1 like 'w%'").select(F.col("site"), F.col("statement_1").alias("of")).distinct().withColumnRenamed("site", "policy")
    typed = found.join(s.select("policy", F.col("sid").alias("of"), "data_type"), ["policy", "of"])
    other = s.select("policy", "data_type", "sid", polar.alias("polar"))
    w = Window.partitionBy("of").orderBy("polar", "sid")
    return typed.join(other, ["policy", "data_type"]).where("sid <> of").withColumn("place", F.row_number().over(w)).where("place <= 5").select("of", "sid", "place")


SUPPORT_SQL = lambda: (
    f"{all_findings_sql()}, found AS (SELECT DISTINCT site, statement_1 AS of_ FROM findings WHERE statement_1 LIKE 'w%') SELECT of_ AS of, y.sid, CAST(row_number() OVER (PARTITION BY of_ ORDER BY CASE WHEN y.is_negative OR y.modality = 'PROHIBITION' THEN 0 ELSE 1 END, y.sid) AS INTEGER) AS place "
    "FROM found JOIN sites x ON x.sid = of_ JOIN sites y ON y.policy = site AND y.data_type = x.data_type AND y.sid <> of_ QUALIFY place <= 5"
)


def surroundings(spark: SparkSession, sf_dir: str, around: int = 600) -> DataFrame:
    """Where each benchmark item stands in each document that has it, found by its first 120 signs with spaces squeezed, with the text around it."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring(flat("text"), 1, 120).alias("head"))
    # candidates share the hash of the first eight words; the position is then looked up
    words = lambda c: F.split(flat(c), " ")
    keyed = items.where(F.length("head") > 0).withColumn("key", F.xxhash64(F.array_join(F.slice(F.split("head", " "), 1, 8), " ")))
    docs = table(spark, sf_dir, "documents").select("doc_id", flat("text").alias("text")).where("text <> ''")
    cut = docs.select("doc_id", words("text").alias("w"))
    n = F.greatest(F.size("w") - 7, F.lit(1))
    grams = cut.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(8)), " "))))).alias("key"))
    hit = grams.join(keyed, "key").select("doc_id", "item_id", "head").distinct().join(docs, "doc_id").withColumn("at", F.instr("text", F.col("head"))).where("at > 0")
    return hit.select("doc_id", "item_id", "at", F.substring("text", F.greatest(F.col("at") - around, F.lit(1)), F.col("at") - F.greatest(F.col("at") - around, F.lit(1)) + F.length("head") + around).alias("context"))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
SURROUND_SQL = f"WITH i AS (SELECT item_id, substr({_FLAT}, 1, 120) AS head FROM benchmark), d AS (SELECT doc_id, {_FLAT} AS text FROM documents) SELECT doc_id, item_id, CAST(instr(text, head) AS INTEGER) AS at, substr(text, greatest(instr(text, head) - 600, 1), instr(text, head) - greatest(instr(text, head) - 600, 1) + length(head) + 600) AS context FROM d JOIN i ON head <> '' AND contains(text, head)".replace(" AS at,", ' AS "at",')

VERDICTS = ["Inconsistent", "unspecified", "soft_tension", "hard_contradiction", "non_conflict", " UNDERSPECIFIED ", ""]
EXHAUSTED = ['{"exhausted": true}', '{"exhausted": false}', "```json\n{\"exhausted\": false, \"missing\": []}\n```", "no idea", "", '{"other": 1}']


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old names of verdicts under the present ones; whether a round says that nothing is missing (what can't be read says so)."""
    v = o.frame(spark, [(k, x) for k, x in enumerate(VERDICTS)], "id int, raw string").select("id", F.lit("verdict").alias("kind"), F.lower(F.trim("raw")).alias("x"))
    v = v.select("id", "kind", F.when(F.col("x").isin("unspecified", "soft_tension"), "underspecified").when(F.col("x") == "hard_contradiction", "inconsistent").otherwise(F.col("x")).alias("value"))
    e = o.frame(spark, [(k, x) for k, x in enumerate(EXHAUSTED)], "id int, raw string")
    body = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    e = e.select("id", F.lit("exhausted").alias("kind"), F.coalesce(F.get_json_object(F.nullif(body, F.lit("")), "$.exhausted"), F.lit("true")).alias("value"))
    return v.union(e)


ANSWERS_SQL = (
    f"SELECT CAST(id AS INTEGER) AS id, 'verdict' AS kind, CASE x WHEN 'unspecified' THEN 'underspecified' WHEN 'soft_tension' THEN 'underspecified' WHEN 'hard_contradiction' THEN 'inconsistent' ELSE x END AS value FROM (SELECT id, lower(trim(raw)) AS x FROM {o.values([(k, x) for k, x in enumerate(VERDICTS)], 'id, raw')}) "
    f"UNION ALL SELECT CAST(id AS INTEGER), 'exhausted', CASE WHEN regexp_matches(raw, '\"exhausted\":\\s*false') THEN 'false' ELSE 'true' END FROM {o.values([(k, x) for k, x in enumerate(EXHAUSTED)], 'id, raw')}"
)


def first_party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a site may call itself: the words of its address, and what its page's title begins with."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"), F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>([^<|\-]*)", 1)).alias("title"))
    label = F.element_at(F.split("host", r"\."), -2)
    return p.select("page_id", F.concat_ws("; ", F.nullif(label, F.lit("")), F.nullif(F.lower("title"), F.lit(""))).alias("names"))


NAMES_SQL = "SELECT page_id, concat_ws('; ', nullif(string_split(regexp_extract(url, '^https?://([^/:]+)', 1), '.')[-2], ''), nullif(lower(trim(regexp_extract(coalesce(html, ''), '(?is)<title>([^<|\\-]*)', 1))), '')) AS names FROM pages"


def prompts(spark: SparkSession, sf_dir: str, most: int = 1500) -> DataFrame:
    """What a verifier is asked about each finding: both sentences, so many signs of each (the prompt's own limit), the pattern and the question."""
    f = finding_sentences(spark, sf_dir)
    ask = F.format_string("Pattern: %s\nWebsite: %s\nVendor: %s\nCategories: %s\nDo both hold?", "pattern", F.substring("website_sentence", 1, most), F.substring("vendor_sentence", 1, most), "categories")
    return f.select("statement_1", "statement_2", "pattern", ask.alias("prompt"))


def prompts_sql() -> str:
    return f"SELECT statement_1, statement_2, pattern, 'Pattern: ' || pattern || chr(10) || 'Website: ' || substr(website_sentence, 1, 1500) || chr(10) || 'Vendor: ' || substr(vendor_sentence, 1, 1500) || chr(10) || 'Categories: ' || categories || chr(10) || 'Do both hold?' AS prompt FROM ({finding_sentences_sql()})"


QUERIES = {
    "negative_practices": (negative_practices, lambda: f"{synth.STATEMENTS_SQL.rstrip(', ')} SELECT sid, {negative_sql('source_text', 'action', 'purpose')} AS denied FROM (SELECT sid, source_text, action, purpose FROM sites UNION ALL SELECT sid, source_text, action, purpose FROM vendors)"),
    "clause_rules": (clause_rules, CLAUSE_RULES_SQL),
    "actor_names": (actor_names, ACTOR_SQL),
    "statement_sides": (statement_sides, SIDES_SQL),
    "reflection_dedup": (reflection_dedup, DEDUP_SQL),
    "skipped_by_reason": (skipped_by_reason, SKIPPED_SQL),
    "clause_coverage": (clause_coverage, clause_coverage_sql),
    "complete_policies": (complete_policies, lambda: f"SELECT count(*) AS policies, CAST(count_if(complete) AS BIGINT) AS complete, round(100.0::DOUBLE * count_if(complete) / count(*), 4) AS percent, CAST(count_if(statement_percent >= 50) AS BIGINT) AS half FROM ({clause_coverage_sql()})"),
    "finding_sentences": (finding_sentences, finding_sentences_sql),
    "supporting_clauses": (supporting_clauses, SUPPORT_SQL),
    "surroundings": (surroundings, SURROUND_SQL),
    "answers": (answers, ANSWERS_SQL),
    "first_party_names": (first_party_names, NAMES_SQL),
    "prompts": (prompts, prompts_sql),
}
