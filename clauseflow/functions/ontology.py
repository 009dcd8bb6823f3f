"""What the analysis knows: data types and their tree, purposes, actions, conditions, disclosure categories, as tables.

Everything here is small and fixed, so the frames built from it may be broadcast whatever the size of the corpus.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of each data type.
TREE = {
    "account data": "account settings|password|user preferences|username",
    "behavioral data": "app usage|browsing history|clickstream data|interaction data|purchase history|search queries",
    "communication data": "call records|email content|sms data",
    "contact information": "email address|name|phone number|postal address",
    "demographic data": "age|date of birth|gender|race or ethnicity",
    "device information": "advertising id|browser type|device id|device type|ip address|language settings|operating system|screen resolution|timezone",
    "financial data": "bank account|payment information|transaction history",
    "geolocation": "coarse geolocation|country|precise geolocation",
    "government id": "driver license|passport number|ssn|tax id",
    "health data": "medical conditions|medical records",
    "personal data": "account data|behavioral data|biometric data|communication data|contact information|demographic data|device information|financial data|geolocation|government id|health data|professional data|tracking technology|user-generated content",
    "professional data": "education information|employment information",
    "tracking technology": "browser fingerprint|cookie id|pixel|session id",
    "user-generated content": "feedback|message|photo|review|video",
}

SENSITIVITY = {
    "CRITICAL": "biometric data|health data|medical conditions|medical records|race or ethnicity",
    "HIGH": "bank account|call records|contact information|driver license|email address|email content|financial data|geolocation|government id|passport number|password|payment information|personal data|phone number|postal address|precise geolocation|ssn|tax id",
    "LOW": "account settings|app usage|browser type|coarse geolocation|device type|feedback|gender|language settings|operating system|review|screen resolution|timezone|user preferences|user-generated content",
    "MEDIUM": "account data|advertising id|age|behavioral data|browser fingerprint|browsing history|clickstream data|communication data|cookie id|country|date of birth|demographic data|device id|device information|education information|employment information|interaction data|ip address|message|name|photo|pixel|professional data|purchase history|search queries|session id|sms data|tracking technology|transaction history|username|video",
}

#: How needed a purpose is for the service, 1 to 5.
NECESSITY = {"advertising": 1, "analytics": 3, "authentication": 5, "fraud prevention": 4, "legal compliance": 4, "marketing": 1, "personalization": 2, "product improvement": 3, "recommendations": 2, "research": 3, "security": 4, "service delivery": 5, "targeted advertising": 1}

#: Other names of data types; the number is the phrase's place in the order of precedence.
DATA_PHRASES = {
    "account data": "account#136|account data#131|account information#135|accounts#137|user account data#133|your account data#132|your user account information#134",
    "advertising id": "ad id#79|advertising ids#78|gaid#82|idfa#81|mobile advertising id#80",
    "age": "age#142",
    "app usage": "usage data#113|usage information#114",
    "bank account": "bank account details#41|bank account information#40|bank account number#42|bank details#39",
    "behavioral data": "profiling information#262|user behavior#263",
    "biometric data": "biometric information#128|facial recognition data#130|fingerprint data#129",
    "browser fingerprint": "browser fingerprint#214|device fingerprint#216|digital fingerprint#215",
    "browser type": "browser#89|browser characteristics#95|browser data#92|browser details#87|browser information#86|browser language#91|browser settings type of browser#93|browser type and settings#94|browser version#90|user agent#88",
    "browsing history": "aggregate information from server logs#233|aggregate statistics about our visitors#224|analytics tracking#76|browsing activity#110|browsing data#108|date/time stamp#229|duration of page and site visits#226|google analytics tracking#77|information server logs#235|log file data#231|navigation paths#227|number of visits#225|online activity#111|page views#112|page visits#219|referring/exit pages#228|server logs#232|site visits#220|temporary server logs#234|time and date of your visit#230|visit information#221|visitor data#222|visitor data and information#223|web browsing history#109",
    "call records": "call recordings#196|call recordings inbound and outbound telephone or video calls#197|call records#195",
    "clickstream data": "click data#117|click history#118|user interaction data#119",
    "coarse geolocation": "approximate location#105|general location#106",
    "communication data": "your communication#257",
    "contact information": "contact and identity information#31|contact data#248|contact details#28|contact info#29|contact information for follow-up#32|other contact details#30",
    "cookie id": "advertising cookies#240|aggregate site analytics cookies#242|analytics cookies#241|authentication cookies#75|cookie data#67|cookie ids#64|cookies#65|cookies browser cookies#239|cookies on your device#236|functional cookies#238|session cookies#74|stored cookies#237|tracking cookies#66",
    "country": "country#165|country location#101|country of residence#166",
    "date of birth": "date of birth#141",
    "device id": "device identification number udid#246|device identifier#59|device identifiers#58|device unique identifier#61|udid#62|unique device identifier#60|unique identifiers#245",
    "device information": "device characteristics#63|device information#57|internet service provider isp#243|isp#244",
    "driver license": "driver s license#175|driver s license number#176|drivers license#177|driving license#178",
    "education information": "education data#194|education history#193|education information#192",
    "email address": "e-mail#2|e-mail address#3|email#1|email account#4|emails#5|your email#0",
    "email content": "email communications#204|email content#201|email content you receive#202|email content you write#203",
    "employment information": "employer#191|employment data#188|employment history#187|employment information#186|job title#190|professional or employment-related information#189",
    "feedback": "all data from surveys#256|feedback#153|responses to surveys#255|survey information#254",
    "financial data": "financial information#38",
    "gender": "gender#143",
    "geolocation": "geo-location#100|geolocation information#107|location data#98|location information#99",
    "government id": "government issued id#184|government-issued identification#185|national id#183",
    "health data": "health#125|health information#122|medical data#123|medical information#124|patient-related information#218",
    "interaction data": "engagement data#261|interaction data#167|interaction with our marketing emails#171|interaction with our platform#170|interactions#168|interactions with our services#169",
    "ip address": "internet protocol address#85|ip#83|ip addresses#84",
    "language settings": "browser settings browser language#161|language#159|language preference#160|language settings#158",
    "medical conditions": "health conditions#217|medical conditions#127",
    "medical records": "medical records#126",
    "message": "message#151|messages#152",
    "name": "company name#10|first name#8|full name#7|last name#9|your name#6",
    "operating system": "operating system version#97|os#96",
    "passport number": "passport#179|passport number#180",
    "payment information": "billing information#34|credit card#35|credit card information#36|donations#264|other payment method#37|payment details#33",
    "personal data": "information about you#56|personal data about you#48|personal data directly provided by users#52|personal data held by us#51|personal data we hold about you#50|personal data you provide#49|personal info#45|personal information#44|personally identifiable information#46|pii#47|private personal data#53|user data#247|your data#55|your information#54",
    "phone number": "mobile number#27|phone#25|telephone number#26",
    "photo": "photo#149|photos#150",
    "pixel": "beacons#71|pixels#70|tags#72",
    "postal address": "billing address#18|company address#24|home address#21|mailing address#23|physical address#22|shipping address#19|street address#20|your postal address#17",
    "precise geolocation": "exact location#104|precise location#103|specific location#102",
    "purchase history": "buying history#121|purchase data#120",
    "race or ethnicity": "ethnic origin#208|ethnicity#207|information revealing ethnic origin#209|race#206|race or ethnicity#205|racial origin#210",
    "review": "replies to reviews#253|replies to reviews by businesses#252|review#144|review content#251|reviews#145|the reviews you write#148|your review#146|your reviews#147",
    "screen resolution": "display resolution#157|screen resolution#156",
    "search queries": "search data#116|search history#115",
    "session id": "session id#154|session id chrome extension#155",
    "sms data": "sms data#198|sms messages#258|sms routing information#199|text message#259|text messages#200",
    "ssn": "social security#173|social security number#172|ssn#174",
    "tax id": "tax id#182|tax identification number#181",
    "timezone": "browser settings time zone#162|time zone#164|timezone#163",
    "tracking technology": "cookies and similar technologies#68|scripts#73|similar technologies#69",
    "transaction history": "details of transactions you carry out through our sites#266|information about your transactions#267|online transactions#265|transaction data#43",
    "user preferences": "consent#260|preferences#138|settings#139|user settings#140",
    "user-generated content": "user contributions#250|your content#249",
    "username": "code repository username#14|login name#15|login name history#16|username#11|usernames#12|your username#13",
    "video": "video#211|videos#212|videos submitted with your reviews#213",
}

#: Other names of purposes, likewise; among purposes the first that matches counts.
PURPOSE_PHRASES = {
    "advertising": "ad serving#20|ads#18|advertisement#19|advertising purposes#22|to advertise#21",
    "analytics": "analysis#34|analytics purposes#38|data analytics#32|reporting#39|reporting for the website operator#40|statistical analysis#33|to analyze#35|to understand website traffic patterns#41|usage analytics#36|web analytics#37|website traffic patterns#42",
    "authentication": "access your account#74|account recovery#71|help you access your account#75|identity verification#69|password recovery#72|recover your account#73|to authenticate#68|user verification#70",
    "fraud prevention": "anti-fraud#60|fraud detection#59|prevent fraud#58",
    "legal compliance": "changes to this policy#87|comply with legal requirements#64|legal obligation#62|material changes#86|materially alter your privacy rights#85|notify users of changes#84|notify you of changes#83|regulatory compliance#63|to comply with law#61",
    "marketing": "email marketing#31|promotional purposes#30|to market#29",
    "personalization": "content personalization#54|customization#53|tailored experience#52|to improve your shopping experience#17|to personalize#51",
    "product improvement": "enhancing our services#50|improve our products#47|product development#49|service improvement#48|to improve our services#46",
    "recommendations": "content recommendations#89|suggested content#90|to recommend#88",
    "research": "internal research#66|research and development#67|research purposes#44|scientific research#65|trend analysis#43|trend analysis and research purposes#45",
    "security": "security purposes#57|to protect#56|to secure#55",
    "service delivery": "account creation#11|account management#12|add to your account#13|booking service#80|care and treatment#16|complete the transaction#81|core functionality#5|create an account#10|deliver our services#2|functionality#4|make a reservation#79|order confirmations#8|payment processing#76|process payment#77|process payments#78|provide care and treatment#15|provide our services#1|save to your account#14|to process transactions#6|to process your orders#7|to provide services#0|to provide the service#3|to send order confirmations#9|transaction fulfillment#82",
    "targeted advertising": "ad personalization#23|behavioral advertising#26|interest-based advertising#25|personalized ads#24|remarketing#27|retargeting#28",
}

ROOT = "personal data"

ACTIONS = "access_right collect delete deletion_right optout_right portability_right process retain sell share transfer use".split()

#: An action and the broader one above it.
BROADER = {"collect": "process", "retain": "process", "sell": "share", "share": "transfer", "transfer": "process", "use": "process"}

STRICTNESS = {"by_default": 1, "if_opted_in": 4, "jurisdictional": 3, "unless_opted_out": 3, "unspecified": 0, "upon_consent": 5, "when_required": 2}

MODALITIES = ["PROHIBITION", "OBLIGATION", "COMMITMENT", "PERMISSION", "POSSIBILITY", "HEDGED", "UNSPECIFIED"]
CONDITIONS = ["by_default", "upon_consent", "if_opted_in", "unless_opted_out", "when_required", "jurisdictional", "unspecified"]
TEMPORALITIES = ["specific_duration", "until_purpose", "until_account_deletion", "indefinite", "unspecified"]

#: Disclosure categories in their order, by family.
DISCLOSURES = {
    "Data Handling": {0: "Processing Purpose", 1: "Data Categories", 2: "Data Recipients", 3: "Source of Data", 4: "Storage Period"},
    "Data Subject Rights": {5: "Right to Access", 6: "Right to Erase", 7: "Right to Object", 8: "Right to Portability", 9: "Right to Restrict", 10: "Withdraw Consent", 17: "Lodge Complaint"},
    "Legal / Organisational": {11: "Provision Requirement", 12: "Adequacy Decision", 13: "Profiling", 14: "DPO Contact", 15: "Controller Contact", 16: "Safeguards Copy"},
}
CATEGORIES = [c for _, c in sorted(x for f in DISCLOSURES.values() for x in f.items())]
FAMILY_OF = {c: f for f, cs in DISCLOSURES.items() for c in cs.values()}

#: Purposes too close to each other to conflict.
PURPOSE_GROUPS = {
    "analysis": "analytics|research",
    "law": "legal compliance",
    "promotion": "advertising|marketing|targeted advertising",
    "safety": "authentication|fraud prevention|security",
    "service": "personalization|product improvement|recommendations|service delivery",
}

BROAD_TYPES = ["behavioral data", "biometric data", "contact information", "device information", "financial data", "geolocation", "health data", "personal data"]


def edges() -> list[tuple[str, str]]:
    return [(p, c) for p, cs in TREE.items() for c in cs.split("|")]


@cache
def types() -> list[str]:
    return sorted({x for e in edges() for x in e})


@cache
def closure() -> list[tuple[str, str, int]]:
    """(type, type below it or itself, steps between)."""
    up = {c: p for p, c in edges()}
    out = []
    for t in types():
        a, k = t, 0
        while a:
            out.append((a, t, k))
            a, k = up.get(a), k + 1
    return sorted(out)


@cache
def related() -> list[tuple[str, str]]:
    """Pairs of types that are equal or of which one subsumes the other."""
    return sorted({(a, b) for a, b, _ in closure()} | {(b, a) for a, b, _ in closure()})


@cache
def siblings() -> list[tuple[str, str]]:
    return sorted((a, b) for cs in TREE.values() for a in cs.split("|") for b in cs.split("|") if a != b)


@cache
def action_closure() -> list[tuple[str, str]]:
    """(action, action that it covers)."""
    out = []
    for a in ACTIONS:
        b = a
        while b:
            out.append((b, a))
            b = BROADER.get(b)
    return sorted(out)


def phrases(of: dict[str, str]) -> list[tuple[str, str, int]]:
    """(phrase, canonical name, place)."""
    out = []
    for canonical, joined in of.items():
        for x in joined.split("|"):
            phrase, place = x.rsplit("#", 1)
            out.append((phrase, canonical, int(place)))
    return sorted(out, key=lambda x: x[2])


def group_of() -> dict[str, str]:
    return {p: g for g, ps in PURPOSE_GROUPS.items() for p in ps.split("|")}


def mapped(column, of: dict, default=None):
    """The value of a fixed dictionary for a column."""
    pairs = [F.lit(x) for kv in of.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A fixed table as literal rows of the plan, marked for broadcast: none here grows with the data."""

    def quoted(x):
        return "NULL" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else repr(x)

    columns = [c.strip().split(" ") for c in schema.split(",")]
    body = ",".join("(" + ",".join(map(quoted, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in columns)
    return F.broadcast(spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(c for c, _ in columns)})"))


def values(rows: list, columns: str) -> str:
    """A fixed table for SQL."""

    def quoted(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ",".join("(" + ",".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


def case(column: str, of: dict, default="NULL") -> str:
    """SQL for the value of a fixed dictionary."""
    q = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in of.items()) + f" ELSE {default} END"
