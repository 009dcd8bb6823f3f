"""Conflict detectors over statements: modality, exclusivity, condition and retention, across policies and within one.

Types are compared through the closed relation "equal or subsuming".  Across policies the statements of a pair meet within the pair alone, and
what a vendor's statement is asked there travels to the site as a few bytes.  Predicates over text, and all that a condition asks of one
statement only, are computed once per statement, before the join.  The conditions on a pair are strings that Spark and an oracle both read.

Statements have the columns of COLUMNS; empty strings stand for missing values.  Findings have those of FINDINGS.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions import text as t
from .labels import labels_sql, rule_bits

COLUMNS = "policy sid actor action modality data_type purpose recipient condition temporality temporality_value is_negative source_text source_section scope".split()
FINDINGS = "pattern site vendor statement_1 statement_2 verdict severity n_violations explanation".split()

MIN_GAP, MIN_STRICTNESS, RATIO, PER_SENTENCE, PURPOSES_PER_CLAUSE = 4, 3, 2.0, 3, 3
SHARING, USAGE = ("sell", "share", "transfer"), ("collect", "process", "use")


def listed(values) -> str:
    return "(" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


#: Text predicates that the detectors need of each statement, by the name of the column.
FLAGS = {
    "blanket": t.BLANKET, "hedged": t.HEDGED, "at_user": t.AT_USER, "restrictive": t.RESTRICTIVE, "context_limited": t.CONTEXT, "limited": t.LIMITED,
    "exclusive": t.EXCLUSIVE, "self_reference": t.SELF_REFERENCE, "only_retain": t.ONLY_RETAIN, "grounds": t.LEGAL_GROUNDS, "cited": t.GROUNDS_CITED,
    "safeguard": t.SAFEGUARD, "public": t.PUBLIC, "not_personal": t.NOT_PERSONAL, "sale": t.SALE, "ineligible": t.INELIGIBLE,
}
_WITH_SECTION = {"context_limited", "limited", "safeguard"}
#: Further columns of a statement, in SQL that both engines read.
DERIVED = {
    "prohibitive": "(is_negative OR modality = 'PROHIBITION')",
    "permissive": "(NOT is_negative AND modality IN ('PERMISSION','COMMITMENT','OBLIGATION'))",
    "strictness": o.case("condition", o.STRICTNESS, 0),
    "need": o.case("purpose", o.NECESSITY, 3),
    "family": o.case("purpose", o.group_of(), "''"),
    "actor_key": "regexp_replace(lower(actor), '[^a-z0-9]+', ''{g})",
    "broad": f"(data_type IN {listed(o.BROAD_TYPES)})",
    #: How much a statement says, and how legibly: a curator's measure of evidence.
    "evidence": (
        f"(CASE WHEN data_type = '' THEN 0 WHEN data_type IN {listed(o.BROAD_TYPES)} THEN 1 ELSE 3 END + CASE WHEN purpose <> '' THEN 2 ELSE 0 END + CASE WHEN recipient <> '' THEN 1 ELSE 0 END"
        " + CASE WHEN condition <> 'unspecified' THEN 1 ELSE 0 END + CASE WHEN temporality <> 'unspecified' THEN 1 ELSE 0 END + CASE WHEN is_negative THEN 2 ELSE 0 END"
        " + CASE WHEN length(trim(source_text)) BETWEEN 1 AND 280 THEN 2 WHEN length(trim(source_text)) <= 500 THEN 1 WHEN length(trim(source_text)) >= 900 THEN -2 WHEN length(trim(source_text)) >= 650 THEN -1 ELSE 0 END"
        " - CASE WHEN contains(source_text, '|') THEN 2 ELSE 0 END - CASE WHEN contains(lower(source_text), 'controller') AND contains(lower(source_text), 'responsible for') THEN 2 ELSE 0 END)"
    ),
}


def flagged(statements: DataFrame) -> DataFrame:
    """Statements with their flags, derived columns and days; what a detector doesn't use is pruned away."""
    both = F.concat_ws(" ", "source_section", "source_text")
    df = statements.select(*COLUMNS).withColumns({k: p(both if k in _WITH_SECTION else F.col("source_text")) for k, p in FLAGS.items()})
    df = df.withColumns({k: F.expr(e.replace("{g}", "")) for k, e in DERIVED.items()})
    df = df.withColumns(
        {
            "days": t.duration_days(F.col("temporality_value")),
            "open_ended": t.OPEN_ENDED(F.col("temporality_value")),
            "shown": rule_bits(*map(F.col, ("source_text", "action", "purpose", "recipient", "temporality", "data_type"))),
            "said": F.xxhash64(F.trim("source_text")),
            "size": F.length("source_text"),
        }
    )
    return df.withColumns({k: F.expr(on(e, "", "")) for k, e in ALONE.items()} | {"act": act()}).withColumn("fits", fitting())


def flagged_sql(source: str) -> str:
    both = "(source_section || ' ' || source_text)"
    flags = ", ".join(f"{p.sql(both if k in _WITH_SECTION else 'source_text')} AS {k}" for k, p in FLAGS.items())
    derived = ", ".join(f"{e.replace('{g}', ', ' + chr(39) + 'g' + chr(39))} AS {k}" for k, e in DERIVED.items())
    return (
        f"SELECT x.*, {flags}, {derived}, {t.duration_days_sql('temporality_value')} AS days, {t.OPEN_ENDED.sql('temporality_value')} AS open_ended FROM ({labels_sql(source)}) x"
    )


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def related_frame(df: DataFrame) -> DataFrame:
    return o.frame(df.sparkSession, o.related(), "a string, b string")


#: Columns whose values are mostly of a fixed list, and whole numbers of a fixed range.
LISTS: dict[str, list[str]] = {
    "action": o.ACTIONS, "modality": o.MODALITIES, "data_type": o.types(), "purpose": [*sorted(o.NECESSITY), ""], "family": [*sorted(o.PURPOSE_GROUPS), ""], "condition": o.CONDITIONS,
    "temporality": o.TEMPORALITIES, "scope": ["global", *sorted({n for n, _ in t.SCOPES} - {"global"})],
}
RANGES = {"place": (0, len(o.types()) - 1), "act": (0, 63), "strictness": (0, 6), "need": (0, 6), "evidence": (-16, 46), "shown": (0, (1 << 18) - 1)}


def packed(df: DataFrame, columns: list[str], keep: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """df with `keep` as it is and `columns` in few bytes, and how to get them back by name: values of fixed lists, small numbers and booleans are bits of
    whole numbers. A value that is outside its list travels beside them; nulls are kept."""
    kinds = dict(df.dtypes)
    words: list[Column] = []
    back: dict[str, Column] = {}
    used = 63
    listed_ones = [c for c in columns if c in LISTS]
    code = {c: F.coalesce(F.array_position(F.array(*map(F.lit, LISTS[c])), F.col(c)), F.lit(0)) for c in listed_ones}

    def put(value: Column, bits: int) -> Column:
        nonlocal used
        if used + bits > 63:
            words.append(F.lit(0).cast("long"))
            used = 0
        words[-1] = words[-1].bitwiseOR(F.shiftleft(value.cast("long"), used))
        got = F.shiftright(F.col(f"word_{len(words) - 1}"), used).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        used += bits
        return got.cast("int")

    for c in columns:
        if c in LISTS:
            k = put(code[c], len(LISTS[c]).bit_length())
            back[c] = F.coalesce(F.get(F.array(*map(F.lit, LISTS[c])), k - 1), F.col(f"rest.{c}"))
        elif c in RANGES:
            lo, hi = RANGES[c]
            k = put(F.coalesce(F.col(c) - lo, F.lit(hi - lo + 1)), (hi - lo + 1).bit_length())
            back[c] = F.when(k <= hi - lo, k + lo).cast(kinds[c])
        elif kinds[c] == "boolean":
            k = put(F.coalesce(F.col(c).cast("int"), F.lit(2)), 2)
            back[c] = F.when(k < 2, k == 1)
        else:
            back[c] = F.col(c)
    out = [F.col(c) for c in columns if c not in LISTS and c not in RANGES and kinds[c] != "boolean"]
    if listed_ones:
        some = F.least(*code.values(), F.lit(1)) == 0
        out.append(F.when(some, F.struct(*listed_ones)).alias("rest"))
    return df.select(*keep, *[w.alias(f"word_{i}") for i, w in enumerate(words)], *out), back


def spread(df: DataFrame, each: int = 1 << 20) -> int:
    """Into how many parts what comes of df's tables is shuffled: as many as the session has, or one for so many bytes of its files. Rows multiply
    where statements meet, so the session's number alone would let the parts grow with the data."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-total // each), 20_000))


def meet(sites: DataFrame, vendors: DataFrame, pairs: DataFrame, *used: str) -> DataFrame:
    """Website statements (w_) beside the vendors' (v_) of their pairs, where types are equal or one subsumes the other.

    `used`: what is asked of a meeting, as SQL; of the vendors' columns those it names are there, or all if nothing is given.

    A vendor's statements go to the sites of its pairs in few bytes, and meet the site's there. The result is partitioned by site, so what
    is done by site or pair afterwards needs no further shuffle. Whether types relate is a bit of the site's statement."""
    text = " ".join(used)
    columns = [c for c in vendors.columns if c != "policy" and (not used or re.search(rf"\bv_{c}\b", text))]
    place = {k: i for i, k in enumerate(o.types())}
    near = {k: sum(1 << place[b] for a, b in o.related() if a == k) for k in place}
    at = lambda c: F.array_position(F.array(*map(F.lit, place)), F.col(c)).cast("int") - 1
    v = vendors.withColumn("place", at("data_type")).where("place >= 0")
    v, back = packed(v, ["place", *columns], ["policy"])
    seen = pairs.join(v.withColumnRenamed("policy", "v_policy"), F.col("vendor") == F.col("v_policy")).drop("v_policy").repartition(spread(pairs), "site")
    seen = seen.select("site", "vendor", *[back[c].alias(f"v_{c}") for c in columns], back["place"].alias("v_place"))
    bits = lambda cut: F.get(F.array(*[F.lit(cut(m)).cast("long") for m in near.values()]), at("w_data_type"))
    w = prefixed(sites, "w_").withColumns({"near_0": bits(lambda m: m & ((1 << 34) - 1)), "near_1": bits(lambda m: m >> 34), "w_site": F.col("w_policy")})
    relates = F.expr("(CASE WHEN v_place < 34 THEN shiftright(near_0, v_place) ELSE shiftright(near_1, v_place - 34) END & 1) = 1")
    out = seen.join(w, (F.col("site") == F.col("w_site")) & relates).drop("w_site", "near_0", "near_1", "v_place")
    return out if used else out.withColumn("v_policy", F.col("vendor"))


MEET_SQL = "pairs JOIN fw w ON w.policy = pairs.site JOIN related r ON r.a = w.data_type JOIN fv v ON v.policy = pairs.vendor AND v.data_type = r.b"

CROSS_SCOPE = "({1}scope = {2}scope OR {1}scope = 'global')"
SCOPE = "({1}scope = {2}scope OR {1}scope = 'global' OR {2}scope = 'global')"


def on(expr: str, first: str = "w_", second: str = "v_") -> str:
    return expr.replace("{1}", first).replace("{2}", second)


COVERS = "({1}action || '>' || {2}action) IN " + listed(f"{a}>{b}" for a, b in o.action_closure())
SAME_GROUP = f"(({{1}}action IN {listed(SHARING)} AND {{2}}action IN {listed(SHARING)}) OR ({{1}}action IN {listed(USAGE)} AND {{2}}action IN {listed(USAGE)}))"
RELATED_ACTIONS = f"({COVERS} OR {COVERS.replace('{1}', '{x}').replace('{2}', '{1}').replace('{x}', '{2}')} OR {SAME_GROUP})"
PERSONAL = f"(NOT {{2}}not_personal OR {{2}}data_type IN {listed(t.IDENTIFIERS)})"

#: What the two sides of the modality check have to be.
SITE_ELIGIBLE = f"({{1}}action IN {listed([*SHARING, *USAGE, 'retain'])} AND NOT {{1}}ineligible AND NOT ({{1}}prohibitive AND {{1}}at_user) AND (NOT {{1}}not_personal OR {{1}}data_type IN {listed(t.IDENTIFIERS)}))"
VENDOR_ELIGIBLE = f"(NOT {{2}}prohibitive AND NOT {{2}}safeguard AND {PERSONAL} AND NOT {{2}}public AND ({{2}}action <> 'sell' OR {{2}}sale))"
GENERIC_RECIPIENTS = "advertising partners|business partners|marketing partners|our partners|our service providers|partners|processors|service providers|subprocessors|third parties|third party|third-parties|trusted partners|vendors".split("|")
NAMES_VENDOR = f"(NOT {{1}}restrictive OR lower({{1}}recipient) IN {listed(['', *GENERIC_RECIPIENTS])} OR contains({{2}}actor_key, lower({{1}}recipient)) OR contains(lower({{1}}recipient), replace({{2}}actor_key, 'thirdparty', '')))"

#: The arms of the modality check.
ARMS = {
    "purpose": (
        "({1}purpose <> '' AND {2}purpose <> '' AND {1}purpose <> {2}purpose"
        f" AND NOT ({{1}}action IN {listed(SHARING)} AND ({{1}}purpose = 'legal compliance' OR {{1}}context_limited)) AND (NOT {{1}}broad OR {{1}}action IN {listed(SHARING)}) AND {{2}}need < {{1}}need)"
    ),
    "condition": (
        f"(({{1}}action = {{2}}action OR ({{1}}action IN {listed(SHARING)} AND {{2}}action IN {listed(SHARING)})) AND {{1}}strictness >= {MIN_STRICTNESS} AND {{1}}strictness > {{2}}strictness"
        f" AND (NOT ({{1}}action IN {listed(USAGE)} AND {{2}}action IN {listed(USAGE)}) OR ({{1}}purpose <> '' AND {{1}}purpose = {{2}}purpose)))"
    ),
    "forever": "({1}temporality = 'specific_duration' AND {2}temporality = 'indefinite')",
    "longer": "({1}temporality = 'specific_duration' AND {2}temporality <> 'indefinite' AND coalesce({1}days > 0 AND {2}days > {1}days, false))",
    "prohibition": "({1}prohibitive AND ({1}purpose = '' OR {1}blanket OR ({2}purpose <> '' AND {1}purpose = {2}purpose)))",
}
MISMATCH = f"({{1}}prohibitive AND {{1}}action <> {{2}}action AND NOT ({COVERS} OR {SAME_GROUP}))"
STRONG = f"({{2}}action IN {listed(SHARING)} AND ({{2}}purpose IN ('advertising','marketing','targeted advertising') OR {{2}}recipient <> '' OR {{2}}temporality <> 'unspecified'))"
COMMITTED = f"({{1}}action IN {listed(SHARING)} AND ({{1}}condition <> 'unspecified' OR {{1}}limited))"
N_ARMS = " + ".join(f"CAST(arm_{k} AS INT)" for k in ARMS)
BROAD_ONLY = f"(n_violations = 1 AND arm_condition AND {{1}}broad AND {{2}}broad AND NOT ({COMMITTED} AND {STRONG}))"
VERDICT = "CASE WHEN arm_forever OR (arm_prohibition AND {2}condition IN ('by_default','unless_opted_out')) THEN 'inconsistent' ELSE 'underspecified' END"
EXPLANATION = (
    "trim(CASE WHEN arm_purpose THEN 'The site keeps to ' || {1}purpose || ', the vendor uses it for ' || {2}purpose || '. ' ELSE '' END"
    " || CASE WHEN arm_condition THEN 'The site asks ' || {1}condition || ', the vendor ' || {2}condition || '. ' ELSE '' END"
    " || CASE WHEN arm_forever THEN 'The site keeps it ' || {1}temporality_value || ', the vendor without end. ' ELSE '' END"
    " || CASE WHEN arm_longer THEN 'The site keeps it ' || {1}temporality_value || ', the vendor ' || {2}temporality_value || '. ' ELSE '' END"
    " || CASE WHEN arm_prohibition THEN 'The site does not ' || {1}action || ' ' || {1}data_type || ', the vendor does. ' ELSE '' END)"
)


#: What conditions on a pair ask of one side alone: worked out before statements meet, so that a meeting looks at bits.
ALONE = {"site_eligible": SITE_ELIGIBLE, "vendor_eligible": VENDOR_ELIGIBLE, "strong": STRONG, "committed": COMMITTED}
ACT = {a: k for k, a in enumerate(o.ACTIONS)}
FITS = f"({RELATED_ACTIONS} AND NOT {MISMATCH})"


def act() -> Column:
    """A statement's action by its place in the list, 63 if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, o.ACTIONS)), F.col("action")), F.lit(0)).cast("int") - 1, F.lit(63))


def fitting() -> Column:
    """The actions of a vendor that a site's statement bears on, as bits: what FITS says of the two."""
    covers = set(o.action_closure())
    same = lambda a, b: any(a in g and b in g for g in (SHARING, USAGE))
    bits = lambda test: F.array(*[F.lit(sum(1 << ACT[b] for b in ACT if test(a, b))) for a in ACT])
    fits = bits(lambda a, b: (a, b) in covers or (b, a) in covers or same(a, b))
    strict = bits(lambda a, b: a == b or (a, b) in covers or same(a, b))
    return F.coalesce(F.when(F.col("prohibitive"), F.get(strict, F.col("act"))).otherwise(F.get(fits, F.col("act"))), F.lit(0)).cast("long")


def lean(expr: str) -> str:
    """A condition on a meeting (w_, v_) with what ALONE and FITS have worked out put in."""
    expr = expr.replace(on(FITS), "((shiftright(w_fits, v_act) & 1) = 1)")
    for k, e in ALONE.items():
        for p in ("w_", "v_"):
            expr = expr.replace(on(e, p, p), p + k)
    return expr


_CHECKED = lean(on(f"{CROSS_SCOPE} AND {NAMES_VENDOR} AND {FITS}"))
_ARMED = {f"arm_{k}": on(e) for k, e in ARMS.items()}
_BROKEN = lean(on(f"n_violations > 0 AND NOT {BROAD_ONLY}"))


def _modality_check(met: DataFrame) -> DataFrame:
    df = met.where(_CHECKED).withColumns({k: F.expr(e) for k, e in _ARMED.items()}).withColumn("n_violations", F.expr(N_ARMS))
    return df.where(_BROKEN)


def finding(df: DataFrame, pattern: str, first: Column, second: Column, verdict: str, severity: str, n: str, explanation: str, *more: str) -> DataFrame:
    return df.select(
        F.lit(pattern).alias("pattern"), "site", "vendor", first.alias("statement_1"), second.alias("statement_2"), F.expr(verdict).alias("verdict"), F.expr(severity).alias("severity"),
        F.expr(n).cast("int").alias("n_violations"), F.expr(explanation).alias("explanation"), *more,
    )


_MODALITY_USES = (_CHECKED, *_ARMED.values(), _BROKEN, on(VERDICT), on(EXPLANATION), "v_sid")


def modality_cross(sites: DataFrame, vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Website commitments that a vendor's practice breaks (flat)."""
    met = meet(flagged(sites).where("site_eligible"), flagged(vendors).where("vendor_eligible"), pairs, *_MODALITY_USES)
    return finding(_modality_check(met), "modality", F.col("w_sid"), F.col("v_sid"), on(VERDICT), "CASE WHEN n_violations >= 2 THEN 'CRITICAL' ELSE 'HIGH' END", "n_violations", on(EXPLANATION))


def with_statements(ctes: str) -> str:
    from ..plans.synth import STATEMENTS_SQL

    return f"{STATEMENTS_SQL} fw AS ({flagged_sql('sites')}), fv AS ({flagged_sql('vendors')}){ctes}"


def _checked_sql(extra: str = "true", columns: str = "") -> str:
    where = on(f"{SITE_ELIGIBLE} AND {VENDOR_ELIGIBLE} AND {CROSS_SCOPE} AND {NAMES_VENDOR} AND {RELATED_ACTIONS} AND NOT {MISMATCH}", "w.", "v.")
    arms = ", ".join(f"{on(e, 'w.', 'v.')} AS arm_{k}" for k, e in ARMS.items())
    w, v = (", ".join(f"{x}.{c} AS {x}_{c}" for c in [*COLUMNS, *DERIVED, *FLAGS]) for x in "wv")
    return (
        f"armed AS (SELECT site, vendor, {w}, {v}, {arms} FROM {MEET_SQL} WHERE {where} AND {extra}), counted AS (SELECT *, {N_ARMS} AS n_violations FROM armed), "
        f"checked AS (SELECT * FROM counted WHERE {on(f'n_violations > 0 AND NOT {BROAD_ONLY}')})"
    )


_MODALITY_COLUMNS = f"'modality' AS pattern, site, vendor, w_sid AS statement_1, v_sid AS statement_2, {on(VERDICT)} AS verdict, CASE WHEN n_violations >= 2 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CAST(n_violations AS INTEGER) AS n_violations, {on(EXPLANATION)} AS explanation"


def modality_cross_sql() -> str:
    return with_statements(f", {_checked_sql()} SELECT {_MODALITY_COLUMNS} FROM checked")


#: In the graph, a broad type of a site counts only for plain prohibitions of what spreads data.
GRAPH_RULE = f"(NOT {{1}}broad OR ({{1}}prohibitive AND NOT {{1}}hedged AND {{1}}action IN {listed([*SHARING, 'process'])}))"
BRIDGE_OUT = f"({{1}}action IN {listed(SHARING)} AND NOT {{1}}prohibitive)"


def modality_graph(sites: DataFrame, vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same check within aligned neighbourhoods of the two graphs: the claimed type is that neighbourhood's, and `bridged` says
    whether the site sends data of such a type to the vendor at all."""
    f = flagged(sites)
    sent = f.where(on(BRIDGE_OUT, "")).select(F.col("policy").alias("site"), F.col("data_type").alias("s")).distinct()
    sent = sent.join(related_frame(sites), F.col("s") == F.col("a")).select(F.col("site").alias("policy"), F.col("b").alias("data_type"), F.lit(True).alias("bridged")).distinct()
    f = f.where("site_eligible").where(on(GRAPH_RULE, "")).join(sent, ["policy", "data_type"], "left").withColumn("bridged", F.coalesce("bridged", F.lit(False)))
    df = _modality_check(meet(f, flagged(vendors).where("vendor_eligible"), pairs, *_MODALITY_USES, "v_data_type")).withColumn("bridged", F.col("w_bridged"))
    df = df.withColumn("neighbourhood", F.when(F.col("w_data_type").isin(o.ROOT), F.col("v_data_type")).otherwise(F.col("w_data_type")))
    return finding(df, "modality", F.col("w_sid"), F.col("v_sid"), on(VERDICT), "CASE WHEN n_violations >= 2 THEN 'CRITICAL' ELSE 'HIGH' END", "n_violations", on(EXPLANATION), "bridged", "neighbourhood")


def modality_graph_sql() -> str:
    sent = f"sent AS (SELECT DISTINCT policy AS site, b AS kind FROM fw JOIN related ON a = data_type WHERE {on(BRIDGE_OUT, 'fw.')})"
    return with_statements(
        f", {sent}, {_checked_sql(on(GRAPH_RULE, 'w.'))} SELECT {_MODALITY_COLUMNS.replace('site, vendor', 'checked.site, vendor')}, sent.kind IS NOT NULL AS bridged, CASE WHEN w_data_type = '{o.ROOT}' THEN v_data_type ELSE w_data_type END AS neighbourhood "
        "FROM checked LEFT JOIN sent ON sent.site = checked.site AND sent.kind = w_data_type"
    )


def within(statements: DataFrame, same: list[str]) -> DataFrame:
    """Pairs of statements (a_, b_) of one policy with equal columns `same` and related types."""
    f = flagged(statements)
    a = prefixed(f, "a_").join(related_frame(statements).select(F.col("a").alias("ra"), F.col("b").alias("rb")), F.col("a_data_type") == F.col("ra"))
    cond = (F.col("a_policy") == F.col("b_policy")) & (F.col("rb") == F.col("b_data_type"))
    for c in same:
        cond = cond & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(prefixed(f, "b_"), cond).withColumn("site", F.col("a_policy")).withColumn("vendor", F.col("a_policy"))


WITHIN_SQL = "fw w JOIN related r ON r.a = w.data_type JOIN fw v ON v.policy = w.policy AND v.data_type = r.b"

MODALITY_WITHIN = f"({{1}}prohibitive AND NOT {{1}}hedged AND NOT {{1}}at_user AND {{2}}permissive AND {COVERS} AND {SCOPE} AND {{1}}source_text <> {{2}}source_text)"


def modality_within(statements: DataFrame) -> DataFrame:
    """A policy's prohibitions against its own permissions."""
    df = within(statements, ["actor_key"]).where(on(MODALITY_WITHIN, "a_", "b_"))
    return finding(df, "modality", F.col("a_sid"), F.col("b_sid"), "'inconsistent'", "'CRITICAL'", "1", "'The policy does not ' || a_action || ' ' || a_data_type || ' here and does there.'")


def modality_within_sql() -> str:
    return with_statements(
        " SELECT 'modality' AS pattern, w.policy AS site, w.policy AS vendor, w.sid AS statement_1, v.sid AS statement_2, 'inconsistent' AS verdict, 'CRITICAL' AS severity, CAST(1 AS INTEGER) AS n_violations, "
        f"'The policy does not ' || w.action || ' ' || w.data_type || ' here and does there.' AS explanation FROM {WITHIN_SQL} AND v.actor_key = w.actor_key WHERE {on(MODALITY_WITHIN, 'w.', 'v.')}"
    )


USABLE = "(NOT {1}prohibitive AND {1}purpose <> '' AND {1}exclusive AND NOT {1}self_reference AND NOT {1}only_retain)"
OTHER = "(NOT {2}prohibitive AND {2}purpose <> '' AND NOT ({2}grounds AND {2}cited))"
#: Statements that both have categories share one.
ONE_CATEGORY = "({overlap}({1}categories, {2}categories) OR {size}({1}categories) = 0 OR {size}({2}categories) = 0)"
SQL_CATEGORY = ONE_CATEGORY.replace("{overlap}", "list_has_any").replace("{size}", "len")
#: The same with categories as bits.
SPARK_CATEGORY = "(({1}shown & {2}shown) <> 0 OR {1}shown = 0 OR {2}shown = 0)"
#: The two sides of such a conflict, each asked of one statement.
_SIDES = {"usable": on(USABLE, ""), "other": on(OTHER, "", "")}


def with_sides(df: DataFrame, more: dict[str, str] = {}) -> DataFrame:
    return df.withColumns({k: F.expr(e) for k, e in (_SIDES | more).items()})


CONFLICT = "({1}purpose <> {2}purpose AND ({1}family = '' OR {2}family = '' OR {1}family <> {2}family))"
EXCLUSIVITY_TEXT = "{1}data_type || ' is kept to ' || {1}purpose || ' but also used for ' || {2}purpose || '.'"


def _capped(df: DataFrame, text: Column, order: list) -> DataFrame:
    """First finding of each (clause, other purpose), and the first purposes of each clause."""
    by = Window.partitionBy("site", "vendor", text, "other_purpose").orderBy(*order)
    df = df.withColumn("k", F.row_number().over(by)).where("k = 1")
    return df.withColumn("k", F.row_number().over(Window.partitionBy("site", "vendor", text).orderBy(*order))).where(F.col("k") <= PURPOSES_PER_CLAUSE)


def exclusivity_cross(sites: DataFrame, vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exclusive purposes of either side against other purposes of the other; the sites' exclusive clauses come first."""
    w, v = (with_sides(flagged(x)) for x in (sites, vendors))
    turns = [(0, "w_", "v_"), (1, "v_", "w_")]
    tests = {k: on(f"{{1}}usable AND {{2}}other AND {CROSS_SCOPE} AND {CONFLICT} AND {SPARK_CATEGORY}", a, b) for k, a, b in turns}
    columns = {"excl": "{1}sid", "other": "{2}sid", "clause": "{1}said", "other_purpose": "{2}purpose", "explanation": EXCLUSIVITY_TEXT}
    columns = {c: "CASE turn " + " ".join(f"WHEN {k} THEN {on(e, a, b)}" for k, a, b in turns) + " END" for c, e in columns.items()}
    met = meet(w.where("usable OR other"), v.where("usable OR other"), pairs, *tests.values(), *columns.values())
    both = met.withColumn("turn", F.explode(F.array_compact(F.array(*[F.when(F.expr(e), k) for k, e in tests.items()]))))
    df = _capped(both.select("site", "vendor", "turn", *[F.expr(e).alias(c) for c, e in columns.items()]), F.col("clause"), ["turn", "excl", "other"])
    return finding(df, "exclusivity", F.col("excl"), F.col("other"), "'inconsistent'", "'HIGH'", "1", "explanation")


def _capped_sql(source: str) -> str:
    return (
        f"once AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY site, vendor, clause, other_purpose ORDER BY turn, excl, other) = 1), "
        f"kept AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY site, vendor, clause ORDER BY turn, excl, other) <= {PURPOSES_PER_CLAUSE}) "
        "SELECT 'exclusivity' AS pattern, site, vendor, excl AS statement_1, other AS statement_2, 'inconsistent' AS verdict, 'HIGH' AS severity, CAST(1 AS INTEGER) AS n_violations, explanation FROM kept"
    )


def exclusivity_cross_sql() -> str:
    def directed(a: str, b: str, turn: int) -> str:
        p = a + "."
        return (
            f"SELECT site, vendor, {turn} AS turn, {p}sid AS excl, {b}.sid AS other, trim({p}source_text) AS clause, {b}.purpose AS other_purpose, {on(EXCLUSIVITY_TEXT, p, b + '.')} AS explanation "
            f"FROM {MEET_SQL} WHERE {on(f'{USABLE} AND {OTHER} AND {CROSS_SCOPE} AND {CONFLICT} AND {SQL_CATEGORY}', p, b + '.')}"
        )

    return with_statements(f", both_ways AS ({directed('w', 'v', 0)} UNION ALL {directed('v', 'w', 1)}), {_capped_sql('both_ways')}")


WITHIN_TEXTS = "(trim({1}source_text) <> trim({2}source_text) AND NOT (length(trim({1}source_text)) > 50 AND substr(trim({1}source_text), 1, 200) = substr(trim({2}source_text), 1, 200)))"


def exclusivity_within(statements: DataFrame) -> DataFrame:
    """A policy's exclusive purposes against its own other ones."""
    df = within(statements, []).where(on(f"{USABLE} AND {OTHER} AND {SCOPE} AND {CONFLICT} AND {SPARK_CATEGORY} AND {WITHIN_TEXTS} AND {{1}}sid <> {{2}}sid", "a_", "b_"))
    df = df.select("site", "vendor", F.lit(0).alias("turn"), F.col("a_sid").alias("excl"), F.col("b_sid").alias("other"), F.trim("a_source_text").alias("clause"), F.col("b_purpose").alias("other_purpose"), F.expr(on(EXCLUSIVITY_TEXT, "a_", "b_")).alias("explanation"))
    return finding(_capped(df, F.col("clause"), ["turn", "excl", "other"]), "exclusivity", F.col("excl"), F.col("other"), "'inconsistent'", "'HIGH'", "1", "explanation")


def exclusivity_within_sql() -> str:
    where = on(f"{USABLE} AND {OTHER} AND {SCOPE} AND {CONFLICT} AND {SQL_CATEGORY} AND {WITHIN_TEXTS} AND {{1}}sid <> {{2}}sid", "w.", "v.")
    return with_statements(
        f", hits AS (SELECT w.policy AS site, w.policy AS vendor, 0 AS turn, w.sid AS excl, v.sid AS other, trim(w.source_text) AS clause, v.purpose AS other_purpose, {on(EXCLUSIVITY_TEXT, 'w.', 'v.')} AS explanation FROM {WITHIN_SQL} WHERE {where}), {_capped_sql('hits')}"
    )


CONDITIONED = "(NOT {1}is_negative AND {1}condition <> 'unspecified' AND NOT {2}is_negative AND {2}condition <> 'unspecified')"
GAP = f"(abs({{1}}strictness - {{2}}strictness) >= {MIN_GAP} AND NOT ({{1}}source_section <> '' AND {{1}}source_section = {{2}}source_section))"
STRICTER = "CASE WHEN {1}strictness >= {2}strictness THEN {1}sid ELSE {2}sid END"
LOOSER = "CASE WHEN {1}strictness >= {2}strictness THEN {2}sid ELSE {1}sid END"
GAP_TEXT = "'The same practice needs ' || CASE WHEN {1}strictness >= {2}strictness THEN {1}condition ELSE {2}condition END || ' in one place and ' || CASE WHEN {1}strictness >= {2}strictness THEN {2}condition ELSE {1}condition END || ' in the other.'"


def _widest(df: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    rank = F.struct(F.abs(F.col(f"{first}strictness") - F.col(f"{second}strictness")).alias("gap"), (F.col(f"{first}size") + F.col(f"{second}size")).alias("size"), F.expr(on(STRICTER, first, second)).alias("stricter"), F.expr(on(LOOSER, first, second)).alias("looser"))
    best = df.groupBy(*by).agg(F.max_by(F.struct(F.expr(on(STRICTER, first, second)).alias("stricter"), F.expr(on(LOOSER, first, second)).alias("looser"), F.expr(on(GAP_TEXT, first, second)).alias("explanation")), rank).alias("best"))
    return finding(best.select("site", "vendor", "best.*").distinct(), "condition", F.col("stricter"), F.col("looser"), "'underspecified'", "'HIGH'", "1", "explanation")


def condition_cross(sites: DataFrame, vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """The widest gap of strictness between the sides for each action and types."""
    usable = "NOT is_negative AND condition <> 'unspecified'"
    gap = on(f"{{1}}action = {{2}}action AND {CROSS_SCOPE} AND {GAP}")
    met = meet(flagged(sites).where(usable), flagged(vendors).where(usable), pairs, gap, on(GAP_TEXT), "v_sid v_size v_data_type").where(gap)
    return _widest(met, ["site", "vendor", "w_action", "w_data_type", "v_data_type"], "w_", "v_")


def _widest_sql(by: str, source: str, where: str) -> str:
    x = ("w.", "v.")
    return with_statements(
        f", hits AS (SELECT {by}, abs(w.strictness - v.strictness) AS gap, length(w.source_text) + length(v.source_text) AS size, {on(STRICTER, *x)} AS stricter, {on(LOOSER, *x)} AS looser, {on(GAP_TEXT, *x)} AS explanation FROM {source} WHERE {where}), "
        f"best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY site, vendor, k1, k2, k3 ORDER BY gap DESC, size DESC, stricter DESC, looser DESC) = 1) "
        "SELECT DISTINCT 'condition' AS pattern, site, vendor, stricter AS statement_1, looser AS statement_2, 'underspecified' AS verdict, 'HIGH' AS severity, CAST(1 AS INTEGER) AS n_violations, explanation FROM best"
    )


def condition_cross_sql() -> str:
    return _widest_sql("site, vendor, w.action AS k1, w.data_type AS k2, v.data_type AS k3", MEET_SQL + " AND v.action = w.action", on(f"{CONDITIONED} AND {CROSS_SCOPE} AND {GAP}", "w.", "v."))


def condition_within(statements: DataFrame) -> DataFrame:
    """The widest gap within a policy for each actor, action and type."""
    df = within(statements, ["actor_key", "action", "data_type"]).where(on(f"{CONDITIONED} AND {SCOPE} AND {GAP} AND {{1}}sid < {{2}}sid", "a_", "b_"))
    return _widest(df, ["site", "vendor", "a_actor_key", "a_action", "a_data_type"], "a_", "b_")


def condition_within_sql() -> str:
    same = " AND v.actor_key = w.actor_key AND v.action = w.action AND v.data_type = w.data_type"
    return _widest_sql("w.policy AS site, w.policy AS vendor, w.actor_key AS k1, w.action AS k2, w.data_type AS k3", WITHIN_SQL + same, on(f"{CONDITIONED} AND {SCOPE} AND {GAP} AND {{1}}sid < {{2}}sid", "w.", "v."))


RETAINING = "({1}action = 'retain' OR {1}temporality <> 'unspecified')"
COMPARABLE = "({1}actor_key = {2}actor_key OR {1}actor_key IN ('firstparty','thirdparty') OR {2}actor_key IN ('firstparty','thirdparty'))"
_ONE_ENDLESS = "(({1}temporality = 'indefinite' AND {2}temporality = 'specific_duration') OR ({2}temporality = 'indefinite' AND {1}temporality = 'specific_duration'))"
_PURPOSE_BOUND = "(({1}temporality = 'indefinite' AND {2}open_ended) OR ({2}temporality = 'indefinite' AND {1}open_ended))"
_RATIO = f"coalesce(least({{1}}days, {{2}}days) > 0 AND {{1}}days IS NOT NULL AND {{2}}days IS NOT NULL AND greatest({{1}}days, {{2}}days) >= {RATIO} * least({{1}}days, {{2}}days), false)"
TEMPORAL = f"({COMPARABLE} AND {SCOPE} AND NOT {_PURPOSE_BOUND} AND ({_ONE_ENDLESS} OR {_RATIO}))"
TEMPORAL_TEXT = f"CASE WHEN {_ONE_ENDLESS} THEN {{1}}data_type || ' is kept without end in one place.' ELSE {{1}}data_type || ' is kept ' || {{1}}temporality_value || ' and ' || {{2}}temporality_value || '.' END"


def retention_cross(sites: DataFrame, vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Retention periods of the two sides that contradict each other."""
    keep = on(RETAINING, "")
    df = meet(flagged(sites).where(keep), flagged(vendors).where(keep), pairs, on(TEMPORAL), on(TEMPORAL_TEXT), "v_sid").where(on(TEMPORAL))
    return finding(df, "retention", F.col("w_sid"), F.col("v_sid"), "'inconsistent'", "'HIGH'", "1", on(TEMPORAL_TEXT))


def _retention_sql(site: str, source: str, more: str) -> str:
    where = on(f"{RETAINING} AND {TEMPORAL}", "w.", "v.") + " AND " + on(RETAINING, "v.") + more
    return with_statements(
        f" SELECT 'retention' AS pattern, {site}, w.sid AS statement_1, v.sid AS statement_2, 'inconsistent' AS verdict, 'HIGH' AS severity, CAST(1 AS INTEGER) AS n_violations, {on(TEMPORAL_TEXT, 'w.', 'v.')} AS explanation FROM {source} WHERE {where}"
    )


def retention_cross_sql() -> str:
    return _retention_sql("site, vendor", MEET_SQL, "")


def retention_within(statements: DataFrame) -> DataFrame:
    """Retention periods of one policy that contradict each other."""
    df = within(statements, []).where(on(f"{RETAINING} AND {TEMPORAL} AND {{1}}sid < {{2}}sid", "a_", "b_") + " AND " + on(RETAINING, "b_"))
    return finding(df, "retention", F.col("a_sid"), F.col("b_sid"), "'inconsistent'", "'HIGH'", "1", on(TEMPORAL_TEXT, "a_", "b_"))


def retention_within_sql() -> str:
    return _retention_sql("w.policy AS site, w.policy AS vendor", WITHIN_SQL, " AND w.sid < v.sid")


PRIORITY = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"
PATTERN_RANK = {"modality": 0, "retention": 1, "condition": 1, "exclusivity": 1}
VERDICT_RANK = {"inconsistent": 0, "underspecified": 1, "non_conflict": 2}
#: What a finding's text adds to the evidence of its two statements; the verdict counts too.
WEIGHT = "({1}evidence + {2}evidence + CASE verdict WHEN 'inconsistent' THEN 3 WHEN 'underspecified' THEN 2 ELSE 1 END + CASE WHEN contains(explanation, 'advertising') THEN 3 ELSE 0 END + CASE WHEN contains(explanation, 'keeps it') OR contains(explanation, 'without end') THEN 2 ELSE 0 END)"

def _ends(first: str, second: str, **parts: str) -> dict[str, str]:
    """What a finding is made of, as SQL over a meeting. r1 to r3 and down_1 and down_2 are ranks, largest first; `up` comes least first. Texts are
    told apart by a hash of 64 bits, within a pair."""
    base = {
        "statement_1": "{1}sid", "statement_2": "{2}sid", "said_1": "{1}said", "said_2": "{2}said", "text_1": "trim({1}source_text)", "text_2": "trim({2}source_text)", "data_type": "{1}data_type", "severity": "'HIGH'",
        "n_violations": "1", "k1": "0L", "k2": "''", "r1": "0", "r2": "0", "r3": "0", "up_1": "CAST(NULL AS STRING)", "up_2": "CAST(NULL AS STRING)", "down_1": "CAST(NULL AS STRING)", "down_2": "CAST(NULL AS STRING)",
    }
    return {k: on(e, first, second) for k, e in (base | parts).items()}


_EXCLUSIVE = {"pattern": "'exclusivity'", "verdict": "'inconsistent'", "explanation": EXCLUSIVITY_TEXT, "k1": "{1}said", "k2": "{2}purpose", "up_1": "{1}sid", "up_2": "{2}sid"}
KINDS: dict[str, dict[str, str]] = {
    "modality": _ends(
        "w_", "v_", pattern="'modality'", verdict=VERDICT, severity="CASE WHEN n_arms >= 2 THEN 'CRITICAL' ELSE 'HIGH' END", n_violations="n_arms", explanation=EXPLANATION, k1="{1}said",
        r1="CASE WHEN n_arms >= 2 THEN 1 ELSE 0 END", r2="n_arms", r3="{2}size", up_1="{1}sid", up_2="{2}sid",
    ),
    "site keeps to": _ends("w_", "v_", r1="1", **_EXCLUSIVE),
    "vendor keeps to": _ends("v_", "w_", **_EXCLUSIVE),
    "condition": _ends(
        "w_", "v_", pattern="'condition'", verdict="'underspecified'", explanation=GAP_TEXT, k2="{1}action || '/' || {1}data_type || '/' || {2}data_type", r1="abs({1}strictness - {2}strictness)",
        r2="{1}size + {2}size", statement_1=STRICTER, statement_2=LOOSER, down_1=STRICTER, down_2=LOOSER,
        **{c: STRICTER.replace("sid", e) for c, e in (("said_1", "said"), ("text_1", "source_text"), ("data_type", "data_type"))},
        **{c: LOOSER.replace("sid", e) for c, e in (("said_2", "said"), ("text_2", "source_text"))},
    ),
    "retention": _ends("w_", "v_", pattern="'retention'", verdict="'inconsistent'", explanation=TEMPORAL_TEXT, k2="{1}sid || ' ' || {2}sid"),
}
for _k in ("text_1", "text_2"):
    KINDS["condition"][_k] = f"trim({KINDS['condition'][_k]})"


def all_cross(sites: DataFrame, vendors: DataFrame, pairs: DataFrame, texts: bool = False) -> DataFrame:
    """Findings of the four detectors across policies, each with its caps, exact repeats dropped; with `texts` also the trimmed texts of both
    statements and the first one's type. `shown` has the categories of both as bits.

    Statements meet once; every meeting is tried by all detectors.  Meetings are partitioned by site, and so are the caps, the removal of
    repeats and the order within the pair: what is found isn't shuffled."""
    w, v = (with_sides(flagged(x), {"conditioned": "NOT is_negative AND condition <> 'unspecified'", "retaining": on(RETAINING, "")}) for x in (sites, vendors))
    exclusive = f"{{1}}usable AND {{2}}other AND {CROSS_SCOPE} AND {CONFLICT} AND {SPARK_CATEGORY}"
    tests = {
        "modality": lean(on(f"w_site_eligible AND v_vendor_eligible AND {FITS} AND n_arms > 0 AND {CROSS_SCOPE} AND {NAMES_VENDOR} AND NOT {BROAD_ONLY.replace('n_violations', 'n_arms')}")),
        "site keeps to": on(exclusive), "vendor keeps to": on(exclusive, "v_", "w_"), "condition": on(f"w_conditioned AND v_conditioned AND {{1}}action = {{2}}action AND {CROSS_SCOPE} AND {GAP}"),
        "retention": on(f"w_retaining AND v_retaining AND {TEMPORAL}"),
    }
    columns = {c: "CASE kind " + " ".join(f"WHEN '{k}' THEN {parts[c]}" for k, parts in KINDS.items()) + " END" for c in KINDS["modality"] if texts or c not in ("text_1", "text_2", "data_type")}
    met = meet(w, v, pairs, *tests.values(), *_ARMED.values(), *columns.values(), "v_evidence v_shown")
    met = met.withColumns({k: F.expr(e) for k, e in _ARMED.items()}).withColumn("n_arms", F.expr(N_ARMS))
    hits = met.withColumn("kind", F.explode(F.array_compact(F.array(*[F.when(F.expr(e), k) for k, e in tests.items()]))))
    more = [F.col("w_evidence").alias("e1"), F.col("v_evidence").alias("e2"), F.col("w_shown").bitwiseOR(F.col("v_shown")).alias("shown")]
    found = hits.select("site", "vendor", *[F.expr(e).alias(c) for c, e in columns.items()], *more)
    found = found.withColumn("evidence", F.expr(WEIGHT.replace("{1}evidence", "e1").replace("{2}evidence", "e2")).cast("int")).drop("e1", "e2")
    order = [F.desc("r1"), F.desc("r2"), F.desc("r3"), F.asc("up_1"), F.asc("up_2"), F.desc("down_1"), F.desc("down_2")]
    pair = ["site", "vendor", "pattern"]
    found = found.withColumn("k", F.row_number().over(Window.partitionBy(*pair, "k1", "k2").orderBy(*order)))
    found = found.where(f"k <= CASE pattern WHEN 'modality' THEN {PER_SENTENCE} ELSE 1 END")
    found = found.withColumn("k", F.row_number().over(Window.partitionBy(*pair, "k1").orderBy(*order))).where(f"pattern <> 'exclusivity' or k <= {PURPOSES_PER_CLAUSE}")
    return repeats_dropped(found).select(*FINDINGS, "evidence", "shown", *(["text_1", "text_2", "data_type"] if texts else []))


def repeats_dropped(findings: DataFrame) -> DataFrame:
    """The first finding of each pattern and two texts within a pair: the gravest, then the one of least ids."""
    w = Window.partitionBy("site", "vendor", "pattern", "said_1", "said_2").orderBy(F.expr(PRIORITY), F.desc("n_violations"), "statement_1", "statement_2")
    return findings.withColumn("k", F.row_number().over(w)).where("k = 1")


def prioritised(findings: DataFrame) -> DataFrame:
    """Findings with their place within the pair: by severity, pattern, evidence."""
    order = [F.expr(PRIORITY), F.expr(o.case("pattern", PATTERN_RANK, 9)), F.desc("evidence"), "pattern", "statement_1", "statement_2"]
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("site", "vendor").orderBy(*order)))
