"""Predicates and scalar functions over the text of clauses.

A predicate is one regular expression, written for what Java's and DuckDB's engines have in common, so that it runs within
generated code and has an oracle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_phrase(*joined: str) -> str:
    return "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-").replace("\\'", "'") for x in joined for p in x.split("|"))


@dataclass(frozen=True)
class Predicate:
    pattern: str
    across_lines: bool = False

    def __call__(self, text: Column) -> Column:
        return F.coalesce(text.rlike(f"(?i{'s' if self.across_lines else ''}){self.pattern}"), F.lit(False))

    def sql(self, text: str) -> str:
        return f"coalesce(regexp_matches({text}, '{self.pattern.replace(chr(39), chr(39) * 2)}', '{'is' if self.across_lines else 'i'}'), false)"

    def python(self, text: str) -> bool:
        return bool(re.search(self.pattern, text, re.I | (re.S if self.across_lines else 0)))


_OUT = "disclose|rent|sell|share|trade|transfer"

BLANKET = Predicate(
    rf"\b(((will )?never|(do|does|shall|will|would)\s+not)\s+({_OUT})|will\s+never\s+use|(forbidden|prohibited)\s+(from|to)\s+(sell|share|transfer)"
    r"|in\s+no\s+event|under\s+no\s+circumstances|strictly\s+prohibit(ed|ing|s)?|(no|zero)\s+(disclosure|exchange|sale|sharing|transfer)\s+of\s+(personal\s+)?(data|information)"
    r"|to\s+any\s+third\s+part(ies|y)|with\s+no\s+exception)\b"
)
PUBLIC = Predicate(
    r"\b(public(ly)?\s+(personal\s+)?(content|data|information|profile|review)|(content|data|information|review)\s+(you\s+)?(chose\s+to\s+make|made|voluntarily)\s+public"
    r"|publicly\s+(accessible|available|posted|published|shared|visible))"
)
AT_USER = Predicate(
    r"\byou\s+(agree\s+to|can|may|must|shall|should|will)\s+(not\s+)?(collect|disclose|distribute|sell|share|transfer|use)|\byou\s+(are\s+(forbidden|not|prohibited)|(can|must|shall)\s+not)\s"
    r"|\byou\s+will\s+not\b|\bcan\s+you\s+disclose\b"
)
NOT_PERSONAL = Predicate(any_phrase("aggregate|anonymised|anonymized|de-identified|deidentified|non personal information|non-personal information|non personally identif|non-personally identif|non-personally-identifying|not personally identif|pseudonymised|pseudonymized"))
CHILDREN = Predicate(
    r"children\s+(below|under)\s+(the age of\s+)?\d+|(do not|does not)\s+(knowingly\s+)?(collect|solicit).*(children|minors|under\s+\d+)|coppa|children'?s online privacy"
    r"|not\s+(designed|directed|intended)\s+(for|to)\s+(children|minors)|(individuals?|persons?|users?)\s+under\s+(the age of\s+)?\d+"
)
CHILDREN_AT_EXTRACTION = Predicate(
    r"children\s+(below|under|younger than)\s+(the age of\s+)?\d+|(below|under)\s+(the age of\s+)?\d+\s+years?\s+(of age|old)|(child|children|minors?)\s+(are not|do not|must not|should not)"
    r"|(do not|does not)\s+(knowingly\s+)?(collect|solicit|target)\b.*(children|minors|under\s+\d+)|coppa|children'?s online privacy|(individuals?|persons?|users?)\s+under\s+(the age of\s+)?\d+"
    r"|not\s+(designed|directed|intended)\s+(for|to)\s+(children|individuals?\s+under|minors)"
)
HEDGED = Predicate(
    any_phrase("as a rule|generally|in most cases|normally|typically|where applicable|where possible", "anonymous|anonymized|pseudonymized", "child|minors|under 13|under 16|under the age", "cooperat|court order|judicial|law enforcement|legal process|required by law|subpoena", "knowingly")
)
SAFEGUARD = Predicate(
    any_phrase(
        "about how we collect|adequate level of protection|adequate safeguards|alternative mechanism approved by the european commission|appropriate safeguards|change of control|change of ownership|changes to the policy",
        "corporate transaction|countries outside|data portability|describes how we collect|different data protection standards|from public sources|have obtained their necessary consent|how we collect, use|less stringent data protection",
        "materially alter your privacy rights|merger or acquisition|merger, acquisition|necessary safeguards|publicly accessible sources|publicly available information|publicly available sources|publish or send a notice|safeguard transfers",
        "safeguards are in place|safeguards in place|sale of assets|standard contractual clauses|this privacy policy describes|to another controller|updated policy|we value your privacy",
    )
)
RESTRICTIVE = Predicate(r"(exclusively|only|solely) (to|with)|only (disclose|share|transfer)")
LIMITED = Predicate(any_phrase("limited circumstances|only be shared|only with your consent|required by law"))
CONTEXT = Predicate(any_phrase("judicial or administrative order|law enforcement|limited circumstances|required by law|subpoena"))
OPEN_ENDED = Predicate(r"\bas\s+(long\s+as|necessary|needed|permitted|required)\b|\buntil\s+(no\s+longer\s+needed|(such\s+)?time\s+as)\b|\bfor\s+(as\s+long\s+as|the\s+duration\s+of)\b|\bongoing\b|\bperpetual(ly)?\b")
EXCLUSIVE = Predicate(r"\b(only (collect|process|retain|share|use)|(exclusively|solely|strictly) for|for the sole purpose)\b")
SELF_REFERENCE = Predicate(any_phrase("as described herein|described in this|in accordance with this|purposes of this|pursuant to this|set forth herein|set forth in this"))
ONLY_RETAIN = Predicate(r"only\s+retain")
LEGAL_GROUNDS = Predicate(r"contract performance|legal (basis|ground|obligation)|legitimate interest|vital interest")
GROUNDS_CITED = Predicate(r"comply with|consent|performance of")
SALE = Predicate(r"sell |sells |selling|sold| sale | sales |sales platform|sales proceeds|sale price|monetise|monetisation|monetize|monetization")
RIGHTS = Predicate(r"(you have |your )(the )?right to|right to (access|correct|delete|erase|object|port|rectif|restrict|withdraw)|(consumer|data subject|user) rights?\b|you (can|may) (exercise|request|submit)")
DISCLOSURE = Predicate(
    r"the following categories|categories (described|listed) in|as defined (by|in|under)|personal information (does not include|includes|means)|this (privacy (notice|policy|statement)|section) describes"
    r"|we (collect|may collect|process|use) the following|california customer records|protected classification characteristics|categories of (personal )?(data|information) (that|we)|publicly available information"
    r"|^(how (do|does) we|what (do|does) we|why do we)|^this (chart|section|table) (above |below )?(describes|lists|summarizes)|^\*{0,2}[\"']?(collection|disclosure|sale|sharing|use)[\"']?\*{0,2}\s*$"
)
LEGAL_BASIS = Predicate(
    r"\b(lawful\s+basis|legal\s+(basis|ground|obligation)|legitimate\s+interest|vital\s+interest|contract(ual)?\s+(necessity|performance)|performance\s+of\s+(a\s+|the\s+)?contract|do(es)?\s+not\s+require\s+(your\s+)?consent)\b"
)
DELETION = Predicate(
    r"\b(we|you can)\s+(will\s+)?(anonymi[sz]e|de-?identify|delete|destroy|erase|remove)\b|\b(deleted|removed)\s+(after|once|when|within)\b|\bwill\s+(be\s+)?(anonymi[sz]ed|deleted|destroyed|removed)\b|\bwhen\s+(no\s+longer\s+needed|you\s+(close|delete))\b"
)
RETENTION = Predicate(
    r"\b(hold|keep|retain|retained|store|we)\b[^.]*\b(for (as\s+)?(long\s+as|the\s+(duration|period|time))|up\s+to\s+\d+\s*(day|hour|month|week|year)|no\s+longer\s+than|only\s+as\s+long\s+as|\d+\s*(day|hour|month|week|year)s?|until\s+(no\s+longer|the|you))"
)
SCOPED_NEGATION = Predicate(
    r"\b(aggregated\s+data|analytics|insights?|logs?|metrics|reports?|statistics)\s+(do|does|shall|will)\s+not\s+(contain|identify|include|reveal)\b|\bdo(es)?\s+not\s+apply\s+(in|to|when|where)\b"
    r"|\bdoes\s+not\s+identify\s+(any\s+)?(individual|natural\s+person|specific)|\bnon[-\s]?personally[-\s]identif|\b(do|does|shall|will)\s+not\s+\w+\s+(any\s+)?(personal\s+)?(data|information)\s+in\s+this\s+(case|context|regard)\b"
)
GLOSSARY = Predicate(r"\b(\w+\s+){0,3}(is\s+defined\s+as|means|refers\s+to|shall\s+mean)\b|\"[^\"]{2,30}\"\s+means\b|^[a-z][a-z\s]{2,40}:\s")
HEADING = Predicate(
    r"^\s*\*{0,2}[\"']?(how\s+(do|does)\s+we|what\s+(do|does)\s+we|why\s+do\s+we|when\s+do\s+we|who\s+(do\s+we|we))[^.?!]*[?:]?\*{0,2}\s*$"
    r"|^\s*(categories|collection|cookies?|disclosure|retention|sale|security|sharing|use|your\s+rights?)(\s+of\s+[\w\s]+)?\s*:?\s*$"
)

#: Why a clause states no practice; the first that holds counts.
REASONS = [
    ("rights", RIGHTS), ("disclosure", DISCLOSURE), ("children", CHILDREN_AT_EXTRACTION), ("legal_basis", LEGAL_BASIS), ("deletion_process", DELETION),
    ("retention_process", RETENTION), ("scoped_negation", SCOPED_NEGATION), ("glossary", GLOSSARY),
]


def non_practice_reason(text: Column) -> Column:
    out = None
    for name, p in REASONS:
        out = F.when(p(text), name) if out is None else out.when(p(text), name)
    trimmed = F.trim(text)
    return out.when((F.length(trimmed) < 120) & HEADING(trimmed), "section_header").otherwise("")


def non_practice_reason_sql(text: str) -> str:
    whens = " ".join(f"WHEN {p.sql(text)} THEN '{name}'" for name, p in REASONS)
    return f"CASE {whens} WHEN length(trim({text})) < 120 AND {HEADING.sql(f'trim({text})')} THEN 'section_header' ELSE '' END"


_MUST, _MAY, _MIGHT, _USUAL = (Predicate(p) for p in (r"\b(must|required to|shall)\b", r"\b(allowed to|can|may)\b", r"\b(could|might)\b", r"\b(generally|typically|usually)\b"))
_NO_CONSENT, _RIGHT_TO = Predicate(r"do not require (your )?consent"), Predicate(r"right to (access|correct|delete|erase|limit|object|port|rectif|restrict|withdraw)")
_BASIS_WORD, _BASIS_KIND = Predicate(r"(lawful|legal) basis|legal ground"), Predicate(r"consent|contract performance|legitimate interest|vital interest")

MODALITY_STEPS = [
    (lambda t, n, s: s(_NO_CONSENT, t), "COMMITMENT"),
    (lambda t, n, s: s(_RIGHT_TO, t), "PERMISSION"),
    (lambda t, n, s: (s(RIGHTS, t), s(_MAY, t)), "PERMISSION"),
    (lambda t, n, s: s(RIGHTS, t), "COMMITMENT"),
    (lambda t, n, s: s(CHILDREN_AT_EXTRACTION, t), "COMMITMENT"),
    (lambda t, n, s: (s(_BASIS_WORD, t), s(_BASIS_KIND, t)), "COMMITMENT"),
    (lambda t, n, s: s(DISCLOSURE, t), "COMMITMENT"),
    (lambda t, n, s: n, "PROHIBITION"),
    (lambda t, n, s: s(_MUST, t), "OBLIGATION"),
    (lambda t, n, s: s(_MAY, t), "PERMISSION"),
    (lambda t, n, s: s(_MIGHT, t), "POSSIBILITY"),
    (lambda t, n, s: s(_USUAL, t), "HEDGED"),
]


def infer_modality(text: Column, negative: Column) -> Column:
    out = None
    for step, name in MODALITY_STEPS:
        test = step(text, negative, lambda p, t: p(t))
        test = test[0] & test[1] if isinstance(test, tuple) else test
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("COMMITMENT")


def infer_modality_sql(text: str, negative: str) -> str:
    whens = []
    for step, name in MODALITY_STEPS:
        test = step(text, negative, lambda p, t: p.sql(t))
        whens.append(f"WHEN {' AND '.join(test) if isinstance(test, tuple) else test} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'COMMITMENT' END"


#: Conditions in order of precedence.
CONDITION_STEPS = [
    ("upon_consent", Predicate(r"\bconsent\b")),
    ("if_opted_in", Predicate(r"\b(opt-in|if (opted in|you opt in))\b")),
    ("unless_opted_out", Predicate(r"\bopt[- ]out\b|\bunless opted out\b")),
    ("when_required", Predicate(r"\b(legal obligation|required by (applicable )?law|when required)\b")),
    ("by_default", Predicate(r"\b(automatically|by default|no additional user consent)\b")),
]


def infer_condition(text: Column) -> Column:
    out = None
    for name, p in CONDITION_STEPS:
        out = F.when(p(text), name) if out is None else out.when(p(text), name)
    return out.otherwise("unspecified")


def infer_condition_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {p.sql(text)} THEN '{n}'" for n, p in CONDITION_STEPS) + " ELSE 'unspecified' END"


DAYS = {"hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
_DURATION = r"(\d+(?:\.\d+)?)\s*(hour|day|week|month|year)s?"


def duration_days(value: Column) -> Column:
    """Days of the first duration in a text, null without one."""
    number = F.regexp_extract(F.lower(value), _DURATION, 1)
    unit = F.regexp_extract(F.lower(value), _DURATION, 2)
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in DAYS.items() for x in kv]), unit)
    return F.when(number != "", number.cast("double") * scale)


def duration_days_sql(value: str) -> str:
    n, u = f"regexp_extract(lower({value}), '{_DURATION}', 1)", f"regexp_extract(lower({value}), '{_DURATION}', 2)"
    scale = "CASE " + u + " WHEN 'hour' THEN CAST(1 AS DOUBLE) / 24 " + " ".join(f"WHEN '{k}' THEN CAST({int(v)} AS DOUBLE)" for k, v in DAYS.items() if k != "hour") + " END"
    return f"CASE WHEN {n} <> '' THEN CAST({n} AS DOUBLE) * {scale} END"


def normal_text(value: Column) -> Column:
    """Trimmed, lower case, underscores and signs as single spaces."""
    x = F.regexp_replace(F.lower(F.trim(value)), "_", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s/-]+", " "), r"(?U)\s+", " "))


def word_count(value: Column) -> Column:
    return F.coalesce(F.regexp_count(value, F.lit(r"\S+")), F.lit(0))


_ABSOLUTE = Predicate(r"\b(do\s+not\s+(sell|share)|full\s+stop|in\s+no\s+event|is\s+never\s+(disclosed|shared|sold|transferred)|never\s+(sell|share)|prohibited\s+under\s+this\s+policy|strictly\s+prohibited|under\s+no\s+circumstances|will\s+never)\b")
_PRODUCTS = r"\b(ai\s+chat|aria|canva\s+education|disney\+|edge|gamemaker|gx\.gear|hulu|outlook|swiftkey|teams|vpn\s+pro|xbox)\b"

#: Scopes in order of precedence, after absolute statements (global) and named products.
SCOPES = [
    ("donation_processing", Predicate(r"contribution|donat(e|ion)")),
    ("community_sharing", Predicate(r"figma\s+community|link\s+sharing|posting\s+to\s+\w+\s+community|to\s+the\s+general\s+public")),
    ("account_creation", Predicate(r"(creat(e|ing)|sign(ing)?\s+up\s+for)\s+(a|an|your)\s+\w+\s*account|you\s+(can|may)\s+access\s+(some\s+of\s+)?(our|these)\s+services?\s+by")),
    ("newsletter", Predicate(r"newsletter\s+subscription|(sign\s+up\s+for|subscribe\s+to)\s+(our\s+)?newsletter")),
    ("payment_processing", Predicate(r"credit\s+card\s+(details|information|number)|make\s+a\s+purchase|payment\s+(information|method|processing|processor)|paypal|stripe")),
    ("promotional_campaign", Predicate(r"contest|giveaway|promotional\s+campaign|survey|sweepstake")),
    ("children_under_13", Predicate(r"children'?s\s+online\s+privacy|children\s+under\s+(the\s+age\s+of\s+)?1[36]|coppa|minors")),
    ("california_residents", Predicate(r"cal\.\s*civ|california\s+residents?|ccpa|cpra")),
    ("eu_residents", Predicate(r"(eea|eu)\s+residents?|european\s+(economic\s+area|union)|gdpr")),
    ("enterprise_dpa", Predicate(r"b2b|business\s+customers?|data\s+processing\s+(addendum|agreement)|dpa\b|enterprise")),
]


def infer_scope(text: Column) -> Column:
    product = F.regexp_extract(text, f"(?i){_PRODUCTS}", 0)
    out = F.when(_ABSOLUTE(text), "global").when(product != "", F.regexp_replace(F.replace(F.lower(product), F.lit(" "), F.lit("_")), r"\\.", ""))
    for name, p in SCOPES:
        out = out.when(p(text), name)
    return out.otherwise("global")


def infer_scope_sql(text: str) -> str:
    product = f"regexp_extract({text}, '{_PRODUCTS}', 0, 'i')"
    whens = " ".join(f"WHEN {p.sql(text)} THEN '{n}'" for n, p in SCOPES)
    return f"CASE WHEN {_ABSOLUTE.sql(text)} THEN 'global' WHEN {product} <> '' THEN replace(replace(lower({product}), ' ', '_'), '.', '') {whens} ELSE 'global' END"


NEGATION = Predicate(r"\b(can\s*not|never|(do|does|shall|will)\s+not|not\s+(collect|disclose|process|rent|retain|sell|share|store|transfer|use))\b")
#: What takes a prohibition back to a commitment, once it has its negation.
ESCAPES = [
    Predicate(
        r"\b(unless\s+(the\s+user|they|you)\s+((explicitly|expressly|specifically)\s*)?\s*(agree|choose|consent|decide|log|opt|sign)|except\s+(as|in|when|where)\s+(described|noted|outlined|permitted|required|specified|stated)"
        r"|in\s+(that|this)\s+(case|context|regard)|(only|solely)\s+(if|when|where)\s+(it|the\s+user|they|we|you)|to\s+the\s+extent\s+(necessary|permitted|required|that)|does\s+not\s+apply\s+(in|to|when|where))\b"
    ),
    Predicate(r"(to\s+(access|use)\s+\w+|when\s+(you\s+)?(access|use)\s+\w+).*((do|does|will)\s+not\s+(send|share|transfer|transmit))", True),
    Predicate(r"does\s+not\s+(handle|process|receive|store).*(but|instead)\s+(relies|rely|use|uses)", True),
    Predicate(
        any_phrase(
            "handled by our payment|instead uses a third|instead we use|rely on trusted third", "automatically deleted|automatically removed|generated dynamically|is not retained|not stored in",
            "is defined as|means information that|personal data means|personal information means|refers to information", "governed by their privacy|not controlled by us|this policy does not apply|this privacy policy does not cover",
            "the mobile operator|the telecom operator|your internet service provider|your telecom operator", "do not sell my personal|do not sell or share my personal|opt out of our sharing|opt out of the sale|opt-out of our sharing|opt-out of the sale|shine the light",
            "we encourage you not to|we prefer you|we recommend you do not|we suggest you|we would prefer", "children under|knowingly collect|knowingly sell|knowingly share|minors under|student data|student information|students using",
        )
    ),
]


def keeps_prohibition(text: Column) -> Column:
    out = NEGATION(text)
    for p in ESCAPES:
        out = out & ~p(text)
    return out


def keeps_prohibition_sql(text: str) -> str:
    return f"({NEGATION.sql(text)} AND NOT ({' OR '.join(p.sql(text) for p in ESCAPES)}))"


#: Why a website statement is no ground for comparison, beyond its kind of action.
_ELIGIBILITY = [
    ("user_interaction", Predicate(r"\b((fellow|other)\s+users?|(collaborate|communicate|interact)\s+with\s+(fellow|other)?\s*(members?|people|users?)|user[- ]to[- ]user|(display|share|show)\s+(your\s+)?(email|information|name|profile)\s+(to|with)\s+(fellow|other)\s+(members?|participants?|people|users?))\b")),
    ("legal_table", Predicate(r"\b(cal(ifornia)?\.?\s+civ(il)?\.?\s+code|ccpa\s+categor|categor(ies|y)?\s+(of\s+)?(personal\s+)?(data|information)\s+(defined|described|listed)|(the\s+company|we)\s+(have\s+)?(collected|disclosed|shared|sold)\s+the\s+following\s+categor)\b")),
    ("feature_disclaimer", Predicate(r"\b(to\s+(access|use)\s+\w+|when\s+(you\s+)?(access|use)\s+\w+).*((do|does|will)\s+not\s+(send|share|transfer|transmit)\s+(your\s+)?(\w+\s+)?(account|login|sign[- ]in)\s+(data|information))", True)),
    ("third_party_disclaimer", Predicate(any_phrase("governed by their own privacy|governed by their privacy|not controlled by us|not responsible for the privacy|subject to their own privacy|this notice does not cover|this policy does not apply to|this privacy policy does not cover"))),
    ("delegation", Predicate(any_phrase("does not handle your payment|does not process your credit card|does not receive or store your payment|does not store credit card|does not store your credit card|handled by our payment processor|instead uses a third party|instead we use|processed by our payment partner|relies on a third-party|rely on trusted third-party"))),
    ("education", Predicate(any_phrase("coppa|education product|educational purpose|ferpa|student data|student information|student personal|students using"))),
    ("glossary", Predicate(any_phrase("includes information such as|is defined as|means information that|personal data means|personal information means|refers to information|shall mean"))),
    ("third_party_actor", Predicate(any_phrase("the mobile operator|the network operator|the telecom operator|your internet service provider|your isp |your telecom operator"))),
    ("technical_field", Predicate(any_phrase("does not capture password|exclude password|excluding password|not include password|password field|password input"))),
]
IDENTIFIERS = "advertising id|credit card|device id|email address|full name|ip address|name|password|payment information|phone number|postal address|social security number".split("|")


def website_reject(s: dict[str, Column]) -> Column:
    """Why a website statement isn't compared with vendors' ('' if it is); s: its columns by name."""
    text = s["source_text"]
    negative = s["is_negative"] | (s["modality"] == "PROHIBITION")
    out = (
        F.when(~s["action"].isin("collect use process share sell transfer retain access_right deletion_right optout_right portability_right".split()), "no_practice")
        .when(CHILDREN(text), "children")
        .when(s["action"].isin("access_right deletion_right optout_right portability_right".split()), "rights_action")
        .when(negative & AT_USER(text), "user_directed")
        .when(NOT_PERSONAL(text) & ~s["data_type"].isin(IDENTIFIERS), "not_personal")
    )
    for name, p in _ELIGIBILITY:
        out = out.when(p(text), name)
    return out.otherwise("")


#: All of these in one expression, for where the reason doesn't matter.
INELIGIBLE = Predicate("|".join([CHILDREN.pattern, *(f"(?s:{p.pattern})" if p.across_lines else p.pattern for _, p in _ELIGIBILITY)]))


def website_reject_sql(a: str) -> str:
    q = lambda xs: ",".join(f"'{x}'" for x in xs)
    text, action = f"{a}.source_text", f"{a}.action"
    rights = q("access_right deletion_right optout_right portability_right".split())
    whens = " ".join(f"WHEN {p.sql(text)} THEN '{n}'" for n, p in _ELIGIBILITY)
    return (
        f"CASE WHEN {action} NOT IN ('collect','use','process','share','sell','transfer','retain',{rights}) THEN 'no_practice' WHEN {CHILDREN.sql(text)} THEN 'children' WHEN {action} IN ({rights}) THEN 'rights_action' "
        f"WHEN ({a}.is_negative OR {a}.modality = 'PROHIBITION') AND {AT_USER.sql(text)} THEN 'user_directed' WHEN {NOT_PERSONAL.sql(text)} AND {a}.data_type NOT IN ({q(IDENTIFIERS)}) THEN 'not_personal' {whens} ELSE '' END"
    )


#: Disclosure categories that a clause's words give away.
RULES = {
    "Source of Data": Predicate(r"\b(collected from|gather.*from|obtained from|provided by|received from|sourced from)\b"),
    "Right to Restrict": Predicate(r"\b(limit.*processing|restrict processing|restriction of processing)\b"),
    "Withdraw Consent": Predicate(r"unsubscribe|withdraw consent"),
    "Lodge Complaint": Predicate(r"\b((file|lodge) a complaint|(data protection|supervisory) authority)\b"),
    "Provision Requirement": Predicate(r"\b(contractual necessity|legal (basis|obligation)|legitimate interests|obligation to provide|required by (applicable )?law|vital interests)\b"),
    "Adequacy Decision": Predicate(r"\b(adequacy decision|adequate level of protection|binding corporate rules|standard contractual clauses)\b"),
    "Profiling": Predicate(r"\b(automated (decision-making|processing)|create user segments|machine learning|predict user interests|profiling)\b"),
    "DPO Contact": Predicate(r"\b(contact our dpo|data protection officer|dpo|privacy officer)\b"),
    "Controller Contact": Predicate(r"\b(contact.*controller|controller.*contact|data controller|identity of the controller)\b"),
    "Safeguards Copy": Predicate(r"\b(data security|encryption|industry-standard security|(organizational|technical).*measures|protect.*data|safeguards|secure servers|security measures)\b"),
}
