"""Crawl analytics over pages: links and their scores, hubs, what a page is, policies accepted, resources, addresses.

All queries read the table of pages and a few fixture pages that have the signs which the made-up pages lack (footers, walls, policies,
third parties).  Pages are parsed by regular expressions that both engines read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as o
from . import synth
from .synth import table

_WORDS = "This privacy policy says which personal data we process and under the gdpr why. Data protection matters to us and to you. "
#: (page_id, url, html)
FIXTURES = [
    (-1, "https://shop.example.com/", '<html><body><a href="/about-us">About us</a><p>Welcome</p><a href="news.html">News</a><footer><a href="/privacy?x=1#top">Privacy  Policy</a> <a href="//legal.example.com/terms">Terms</a>'
     '<a href="mailto:x@example.com">Privacy mail</a><a href="https://www.iubenda.com/privacy/1">Datenschutz</a><a href="/cookies">Cookie notice</a></footer></body></html>'),
    (-2, "https://shop.example.com/privacy", "<html><body><h1>Privacy policy</h1><p>" + _WORDS * 40 + "</p></body></html>"),
    (-3, "https://wall.example.org/", "<html><title>Just a moment...</title><body>Checking your browser before accessing wall.example.org</body></html>"),
    (-4, "https://denied.example.org/", "<html><body><h1>Access denied</h1> You don't have permission.</body></html>"),
    (-5, "https://thin.example.net/", "<html><body>coming soon</body></html>"),
    (-6, "https://media.example.net/a/b", '<html><head><link rel="stylesheet" href="/s.css"><script src="https://cdn.tracker.com/t.js"></script></head><body><img src="i.png" srcset="i2.png 2x, https://img.pics.io/i3.png 3x"><iframe src="//ads.partner.co.uk/f"></iframe>'
     '<video poster="p.jpg" src="v.mp4"></video><a href="https://other.org/x">x</a><a href="https://login.other.org/privacy">Your privacy choices</a>' + "<p>Plenty of words stand here so that the page counts as content. </p>" * 8 + "</body></html>"),
    (-7, "https://cdn.cookielaw.org/policy", "<html><body><h2>Cookies</h2>" + "We set a cookie here and there. " * 30 + "</body></html>"),
    (-8, "https://consent.example.net/", "<html><body>Manage cookies or accept all cookies</body></html>"),
    (-9, "https://robot.example.net/", "<html><body>recaptcha: verify you are human</body></html>"),
]

PRIVACY = "privacy|data protection|datenschutz|confidentialit|données personnelles|privacidad|protección de datos|informativa sulla privacy|protezione dei dati|privacidade|proteção de dados|privacybeleid|privacyverklaring|integritet|personuppgifter|personvern|persondatapolitik|polityka prywatności|ochrona danych|ochrana osobních údajů|confidențialitate|protecția datelor"
IN_URL = "privacy|datenschutz|confidential|privacidad|privacidade"
SIGNAL = "privacy|data-protection|data_protection|gdpr|rgpd|datenschutz|confidential|privacidad"
NO_POLICY = "account|cart|checkout|login|signin"
HUB_TEXT = "about|aviso legal|company|conditions|impressum|imprint|legal|mentions légales|note legali|rechtliches|terms"
HUB_URL = "about|impressum|imprint|legal|terms"
HOSTERS = ["cookiebot.com", "iubenda.com", "onetrust.com", "privacypolicies.com", "termly.io", "termsfeed.com", "trustarc.com"]
WALL_MAKERS = ["akamai.com", "cloudflare.com", "datadome.com", "distilnetworks.com", "f5.com", "humansecurity.com", "imperva.com", "incapsula.com", "kasada.com", "perimeterx.com", "sucuri.net"]
WIDGETS = ["amazon.com", "apple.com", "facebook.com", "google.com", "linkedin.com", "meta.com", "microsoft.com", "twitter.com", "x.com"]
FULL_SCAN = ["cookielaw.org", "cookiepro.com", "onetrust.com"]
POLICY_TERMS = ["privacy", "personal data", "data protection", "gdpr", "datenschutz", "personenbez", "confidentialit", "données", "privacidad", "datos personales", "protezione dei dati", "polityka prywat", "ochrona danych", "rgpd"]
#: Walls in the order in which they are tried: signs in the page, in lower case.
WALLS = [
    ("cloudflare_challenge", r"cf-chl-|__cf_chl_|challenges\.cloudflare\.com|cf_clearance|just a moment\.\.\.|checking your browser before accessing|cloudflare ray id"),
    ("datadome_challenge", r"datadome|captcha-delivery\.com"), ("akamai_challenge", r"akamai reference|_abck|ak_bmsc|bm_sv"), ("imperva_challenge", r"incapsula|incap_ses|_incap_|visid_incap"),
    ("perimeterx_challenge", r"px-captcha|perimeterx|_px3|human-security"), ("sucuri_challenge", r"sucuri website firewall"), ("kasada_challenge", r"kasada"),
    ("shape_challenge", r"jstracker|_shape_|shape-security"), ("distil_challenge", r"distil_r|distil-"),
]
ERROR_TEXT = r"access denied|forbidden|request blocked|service unavailable|temporarily unavailable|bad gateway|error\s*404|page not found"

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
FOOTER = r"(?is)<footer\b.*?</footer>"
TAG = r"(?s)<[^>]*>"
HIDDEN = r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>"
HOST = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)"
_Q = lambda s: s.replace("'", "''")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = o.frame(spark, FIXTURES, "page_id long, url string, html string")
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).union(fixtures)


PAGES_SQL = f"p AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, coalesce(html, '') AS html FROM pages UNION ALL SELECT * FROM {o.values(FIXTURES, 'page_id, url, html')})"


def site_of(url: Column) -> Column:
    """The last two labels of an address's host."""
    return F.substring_index(F.lower(F.regexp_extract(url, HOST, 1)), ".", -2)


def site_sql(url: str) -> str:
    return f"array_to_string(string_split(lower(regexp_extract({url}, '{HOST}', 1)), '.')[-2:], '.')"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(html: Column) -> Column:
    """Words of a page without its markup."""
    return squeezed(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " "))


def plain_sql(html: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({html}, '{HIDDEN}', ' ', 'g'), '{TAG}', ' ', 'g'), '\\s+', ' ', 'g'))"


def joined(base: Column, href: Column) -> Column:
    """An address as a page at `base` means it."""
    origin, scheme = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1), F.regexp_extract(base, r"^([a-zA-Z]+:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z]+://[^/]+)$", "$1/")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(F.concat(F.regexp_replace(folder, r"[^/]*$", ""), href))
    )


def joined_sql(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, '^([a-zA-Z]+://[^/?#]+)', 1)"
    folder = f"regexp_replace(regexp_replace({base}, '[?#].*$', ''), '^([a-zA-Z]+://[^/]+)$', '\\1/')"
    return f"CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([a-zA-Z]+:)', 1) || {href} WHEN starts_with({href}, '/') THEN {origin} || {href} ELSE regexp_replace({folder}, '[^/]*$', '') || {href} END"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page, source, place, url, anchor): links that lead to web addresses, the footers' first."""
    p = pages(spark, sf_dir)
    footer = F.array_join(F.regexp_extract_all("html", F.lit(FOOTER), F.lit(0)), " ")
    parts = p.select("page_id", F.col("url").alias("page"), F.explode(F.array(F.struct(F.lit("footer").alias("source"), footer.alias("part")), F.struct(F.lit("body").alias("source"), F.regexp_replace("html", FOOTER, " ").alias("part")))).alias("x")).select("page_id", "page", "x.*")
    found = F.arrays_zip(F.regexp_extract_all("part", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("part", F.lit(ANCHOR), F.lit(2)).alias("text"))
    rows = parts.select("page_id", "page", "source", F.posexplode(found).alias("place", "x")).select("page_id", "page", "source", "place", F.trim("x.href").alias("href"), squeezed(F.regexp_replace("x.text", TAG, " ")).alias("anchor"))
    rows = rows.where(~F.col("href").rlike("^(mailto:|tel:|javascript:|#)") & (F.col("href") != ""))
    return rows.withColumn("url", joined(F.col("page"), F.col("href"))).where(F.col("url").rlike("(?i)^https?://")).drop("href")


LINKS_SQL = (
    f"{PAGES_SQL}, parts AS (SELECT page_id, url AS page, 'footer' AS source, array_to_string(regexp_extract_all(html, '{FOOTER}'), ' ') AS part FROM p UNION ALL SELECT page_id, url, 'body', regexp_replace(html, '{FOOTER}', ' ', 'g') FROM p), "
    f"zipped AS (SELECT page_id, page, source, regexp_extract_all(part, '{_Q(ANCHOR)}', 1) AS h, regexp_extract_all(part, '{_Q(ANCHOR)}', 2) AS t FROM parts), "
    f"raw AS (SELECT page_id, page, source, unnest(range(len(h))) AS place, trim(unnest(h)) AS href, trim(regexp_replace(regexp_replace(unnest(t), '{TAG}', ' ', 'g'), '\\s+', ' ', 'g')) AS anchor FROM zipped), "
    f"links AS (SELECT page_id, page, source, CAST(place AS INTEGER) AS place, anchor, {joined_sql('page', 'href')} AS url FROM raw WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)') AND regexp_matches({joined_sql('page', 'href')}, '^(?i)https?://'))"
).replace("'^(?i)https?://'", "'(?i)^https?://'")


def scored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page that may lead to its policy, each address once with its best score."""
    rows = links(spark, sf_dir)
    t, u, own, site = F.lower("anchor"), F.lower("url"), site_of(F.col("page")), site_of(F.col("url"))
    same = own == site
    score = (
        F.when(u.rlike(IN_URL), 5.0).otherwise(0.0) - F.when(F.contains(u, F.lit("cookie")), 1.0).otherwise(0.0) + F.when(t.rlike(PRIVACY), 4.0).otherwise(0.0) - F.when(F.contains(t, F.lit("cookie")), 0.5).otherwise(0.0)
        - F.when(u.rlike(NO_POLICY), 2.0).otherwise(0.0) + F.when(same, 0.8).otherwise(-0.8)
    )
    label, text, address = F.substring_index(own, ".", 1), t.rlike(PRIVACY), u.rlike(SIGNAL)
    allowed = (site != "") & (same | site.isin(HOSTERS) | ((label != "") & F.contains(u, label)) | F.when(F.col("source") == "footer", text | address).otherwise(text & address))
    path = F.lower(F.regexp_extract("url", r"(?i)^https?://[^/?#]+([^?#]*)", 1))
    low = ((F.lower(F.regexp_extract("url", HOST, 1)) == F.lower(F.regexp_extract("page", HOST, 1))) & path.isin("", "/")) | F.endswith(path, F.lit(".xml")) | path.rlike(r"sitemap|robots\.txt|/feed|/rss") | (~same & site.isin(WALL_MAKERS + WIDGETS))
    rows = rows.select("page_id", "url", "anchor", "source", score.alias("score"), allowed.alias("allowed"), low.alias("low")).where("allowed")
    best = rows.groupBy("page_id", "url").agg(F.max("score").alias("score"), F.max_by(F.struct("anchor", "source"), F.struct("score", "source", "anchor")).alias("x"), F.bool_or("low").alias("low_value"))
    return best.select("page_id", "url", F.round("score", 4).alias("score"), "x.anchor", "x.source", "low_value")


_IN = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"
SCORED_SQL = (
    f"{LINKS_SQL}, seen AS (SELECT *, lower(anchor) AS t, lower(url) AS u, {site_sql('page')} AS own, {site_sql('url')} AS site FROM links), "
    f"marked AS (SELECT *, CASE WHEN regexp_matches(u, '{IN_URL}') THEN 5 ELSE 0 END - CASE WHEN contains(u, 'cookie') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '{PRIVACY}') THEN 4 ELSE 0 END - CASE WHEN contains(t, 'cookie') THEN 0.5 ELSE 0 END "
    f"- CASE WHEN regexp_matches(u, '{NO_POLICY}') THEN 2 ELSE 0 END + CASE WHEN own = site THEN 0.8 ELSE -0.8 END AS points, lower(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1)) AS path FROM seen "
    f"WHERE site <> '' AND (own = site OR site IN {_IN(HOSTERS)} OR (string_split(own, '.')[1] <> '' AND contains(u, string_split(own, '.')[1])) OR CASE WHEN source = 'footer' THEN regexp_matches(t, '{PRIVACY}') OR regexp_matches(u, '{SIGNAL}') ELSE regexp_matches(t, '{PRIVACY}') AND regexp_matches(u, '{SIGNAL}') END)), "
    f"judged AS (SELECT *, (lower(regexp_extract(url, '{HOST}', 1)) = lower(regexp_extract(page, '{HOST}', 1)) AND path IN ('', '/')) OR ends_with(path, '.xml') OR regexp_matches(path, 'sitemap|robots\\.txt|/feed|/rss') OR (own <> site AND site IN {_IN(WALL_MAKERS + WIDGETS)}) AS low FROM marked), "
    "scored AS (SELECT page_id, url, CAST(points AS DOUBLE) AS score, anchor, source, bool_or(low) OVER (PARTITION BY page_id, url) AS low_value FROM judged QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY points DESC, source DESC, anchor DESC) = 1)"
)


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six links of each page that are tried first."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "url")
    return scored_links(spark, sf_dir).where("not low_value").withColumn("place", F.row_number().over(w)).where("place <= 6").select("page_id", "url", "score", "place")


def hub_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three links of each page, best score first, to pages where a policy may be linked."""
    hub = F.lower("anchor").rlike(HUB_TEXT) | F.lower("url").rlike(HUB_URL)
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "url")
    return scored_links(spark, sf_dir).where(hub).withColumn("place", F.row_number().over(w)).where("place <= 3").select("page_id", "url", "place")


def likeliness(text: Column) -> Column:
    """How much a text looks like a privacy policy."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(x)).cast("int") for x in POLICY_TERMS[1:]), F.contains(low, F.lit(POLICY_TERMS[0])).cast("int"))
    words = F.when(F.trim(low) == "", 0).otherwise(F.size(F.split(F.trim(low), r"\s+")))
    cookie = F.contains(low, F.lit("cookie")) & ~low.rlike("privacy|datenschutz|confidential")
    return F.when(low == "", -10.0).otherwise(F.round(F.least(words / 400.0, F.lit(6.0)) + F.least(hits, F.lit(6)) * 1.2 - F.when(cookie, 1.5).otherwise(0.0), 6))


def likeliness_sql(text: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({text}), '{x}') AS INTEGER)" for x in POLICY_TERMS)
    return (
        f"CASE WHEN {text} = '' THEN -10.0::DOUBLE ELSE round(least(len(string_split({text}, ' ')) / 400.0::DOUBLE, 6.0::DOUBLE) + least({hits}, 6) * 1.2::DOUBLE - "
        f"CASE WHEN contains(lower({text}), 'cookie') AND NOT regexp_matches(lower({text}), 'privacy|datenschutz|confidential') THEN 1.5::DOUBLE ELSE 0 END, 6) END"
    )


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", "url", "html", plain(F.col("html")).alias("text"))
    return p.withColumn("likely", likeliness(F.col("text"))).withColumn("n", F.length("text"))


_READ_SQL = f"{PAGES_SQL}, texts AS (SELECT page_id, url, html, {plain_sql('html')} AS text FROM p), read AS (SELECT *, {likeliness_sql('text')} AS likely, length(text) AS n FROM texts)"


def policy_likeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's score, and whether a homepage that it is would pass for the policy itself."""
    path = F.lower(F.regexp_extract("url", r"(?i)^https?://[^/?#]+([^?#]*)", 1))
    own = (F.col("n") >= 1000) & (F.col("likely") >= 8.0) & (path.rlike("privacy|policy|notice|datenschutz") | F.lower("text").rlike("privacy policy|privacy notice"))
    return _read(spark, sf_dir).select("page_id", "likely", own.alias("is_policy"))


def accepted_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each site, the page accepted as its policy: long and likely enough, or else the best with some likelihood."""
    tier = F.when(F.expr("(likely >= 5 and n >= 300) or (likely >= 4 and n >= 500) or (likely >= 3 and n >= 800)"), 0).when(F.expr("likely >= 3 and n >= 200"), 1)
    p = _read(spark, sf_dir).select("page_id", site_of(F.col("url")).alias("site"), "likely", "n", tier.alias("tier")).where("tier is not null")
    return p.groupBy("site").agg(F.max_by(F.struct("page_id", "tier"), F.struct(-F.col("tier"), "likely", "n", -F.col("page_id"))).alias("x")).select("site", "x.page_id", "x.tier")


def page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a page from being read, by the first sign that holds: a wall, an error, too little on it; else it is content."""
    p = _read(spark, sf_dir).withColumn("body", F.lower("html")).withColumn("anchors", F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref"), F.lit(0))))
    kind = None
    for name, signs in WALLS:
        kind = F.when(F.col("body").rlike(signs), name) if kind is None else kind.when(F.col("body").rlike(signs), name)
    has = lambda *xs: F.col("body").rlike("|".join(xs))
    kind = kind.when((has("recaptcha") & has("verify you are human", "i'm not a robot")) | (has("hcaptcha") & has("human")), "captcha_wall").when(has("accept all cookies", "manage cookies") & (F.col("n") < 500), "consent_wall")
    kind = kind.when(has("access denied", "403 forbidden", "you don't have permission"), "access_denied").when(F.lower("text").rlike(ERROR_TEXT), "error_page_text")
    kind = kind.when((F.col("n") < 200) & (F.col("anchors") == 0), "no_links_short_text").when((F.col("n") < 80) & (F.col("anchors") <= 1), "very_sparse_page").otherwise("content")
    return p.select("page_id", kind.alias("kind"))


PAGE_CLASS_SQL = (
    f"WITH {_READ_SQL}, b AS (SELECT *, lower(html) AS body, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref')) AS anchors FROM read) SELECT page_id, CASE "
    + " ".join(f"WHEN regexp_matches(body, '{x}') THEN '{k}'" for k, x in WALLS)
    + " WHEN (contains(body, 'recaptcha') AND (contains(body, 'verify you are human') OR contains(body, 'i''m not a robot'))) OR (contains(body, 'hcaptcha') AND contains(body, 'human')) THEN 'captcha_wall'"
    " WHEN (contains(body, 'accept all cookies') OR contains(body, 'manage cookies')) AND n < 500 THEN 'consent_wall' WHEN contains(body, 'access denied') OR contains(body, '403 forbidden') OR contains(body, 'you don''t have permission') THEN 'access_denied'"
    f" WHEN regexp_matches(lower(text), '{ERROR_TEXT}') THEN 'error_page_text' WHEN n < 200 AND anchors = 0 THEN 'no_links_short_text' WHEN n < 80 AND anchors <= 1 THEN 'very_sparse_page' ELSE 'content' END AS kind FROM b"
)

#: Tags and the attributes that name what a page loads.
RESOURCE = r"""(?is)<(?:script|img|iframe|frame|embed|source|video|audio|track|input|link|object)\b[^>]*?\s(?:src|href|data|poster)\s*=\s*["']([^"']+)["']"""
SRCSET = r"""(?is)<(?:img|source)\b[^>]*?\ssrcset\s*=\s*["']([^"']+)["']"""


def static_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a page loads from, each once."""
    sets = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(SRCSET), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda x: F.regexp_extract(F.trim(x), r"^(\S+)", 1))))
    p = pages(spark, sf_dir).select("page_id", F.col("url").alias("page"), F.explode(F.concat(F.regexp_extract_all("html", F.lit(RESOURCE), F.lit(1)), sets)).alias("href"))
    return p.select("page_id", "page", joined(F.col("page"), F.trim("href")).alias("url")).where(F.col("url").rlike("(?i)^https?://")).distinct()


RESOURCES_SQL = (
    f"{PAGES_SQL}, named AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '{_Q(RESOURCE)}', 1)) AS href FROM p UNION ALL SELECT page_id, page, regexp_extract(trim(unnest(string_split(s, ','))), '^(\\S+)', 1) FROM (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '{_Q(SRCSET)}', 1)) AS s FROM p)), "
    f"resources AS (SELECT DISTINCT page_id, page, {joined_sql('page', 'trim(href)')} AS url FROM named WHERE regexp_matches({joined_sql('page', 'trim(href)')}, '(?i)^https?://'))"
)


def third_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other sites that each page loads from, sorted."""
    found = static_resources(spark, sf_dir).select("page_id", site_of(F.col("page")).alias("own"), site_of(F.col("url")).alias("site")).where("site <> own and site <> ''")
    return found.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("site")), " ").alias("third_parties"))


def third_party_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct third parties all pages have, and those whose own page could be read."""
    found = static_resources(spark, sf_dir).select("page_id", site_of(F.col("page")).alias("own"), site_of(F.col("url")).alias("site")).where("site <> own and site <> ''")
    kinds = page_class(spark, sf_dir)
    return found.join(kinds, "page_id").agg(F.countDistinct("site").alias("domains"), F.countDistinct(F.when(F.col("kind") == "content", F.col("site"))).alias("domains_of_read_pages"))


def ordered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that each page links to, each once, in the order in which they come first."""
    rows = links(spark, sf_dir).withColumn("at", F.when(F.col("source") == "footer", F.col("place")).otherwise(F.col("place") + 1_000_000_000))
    first = rows.groupBy("page_id", "url").agg(F.min("at").alias("at"))
    return first.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]), " ").alias("urls"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's name for each page, archive addresses of three years, and whether its host's policies are read in full."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    full = F.lit(False)
    for d in FULL_SCAN:
        full = full | (host == d) | F.endswith(host, F.lit("." + d))
    years = F.array_join(F.transform(F.array(*map(F.lit, (2025, 2024, 2023))), lambda y: F.concat(F.lit("https://web.archive.org/web/"), y.cast("string"), F.lit("/"), F.col("url"))), " ")
    return pages(spark, sf_dir).select("page_id", F.substring(F.regexp_replace("url", r"[^A-Za-z0-9._-]+", "_"), 1, 200).alias("folder"), years.alias("archived"), full.alias("full_scan"))


SAFE_SQL = (
    f"WITH {PAGES_SQL} SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 200) AS folder, array_to_string(list_transform([2025, 2024, 2023], lambda y: 'https://web.archive.org/web/' || y || '/' || url), ' ') AS archived, "
    f"regexp_matches(lower(regexp_extract(url, '{HOST}', 1)), '(^|\\.)({'|'.join(x.replace('.', chr(92) + '.') for x in FULL_SCAN)})$') AS full_scan FROM p"
)

PATHS = [f"/{x}" for x in "privacy privacy-policy privacy_policy privacy-notice privacy_notice legal/privacy legal/privacy-policy policies/privacy datenschutz datenschutzerklaerung datenschutzerklärung politique-de-confidentialite politique-de-confidentialité politica-privacidad politica-de-privacidad politica-privacidade polityka-prywatnosci polityka-prywatności privacy-statement gdpr rgpd".split()]


def fallback_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a policy may lie on each host."""
    paths = o.frame(spark, [(x,) for x in PATHS], "path string")
    hosts = pages(spark, sf_dir).select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).distinct()
    return hosts.crossJoin(paths).select("host", F.concat(F.lit("https://"), "host", "path").alias("url"), F.lit(2.8).alias("score"))


def heading_chunks(spark: SparkSession, sf_dir: str, most: int = 6000) -> DataFrame:
    """(page_id, place, breadcrumb, text): a page cut at its headings, each part with the headings above it; parts are cut on at `most`
    characters, at a space where there is one."""
    import re

    head = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1>", re.I | re.S)
    clean = lambda s: " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style|noscript)\b.*?</\1>", " ", s, flags=re.I | re.S)).split())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b.page_id, b.html):
                trail: dict[int, str] = {}
                at, place = 0, 0
                marks = [*head.finditer(html), None]
                for m in marks:
                    text = clean(html[at : m.start() if m else len(html)])
                    while text:
                        end = len(text) if len(text) <= most else (text.rfind(" ", 1, most + 1) if text.rfind(" ", 1, most + 1) > 0 else most)
                        rows.append((page, place, " > ".join(trail[k] for k in sorted(trail)), text[:end]))
                        text, place = text[end:].strip(), place + 1
                    if m:
                        level = int(m[1])
                        trail = {k: v for k, v in trail.items() if k < level} | {level: clean(m[2])}
                        at = m.end()
            yield pd.DataFrame(rows, columns=["page_id", "place", "breadcrumb", "text"])

    return pages(spark, sf_dir).select("page_id", "html").mapInPandas(cut, "page_id long, place int, breadcrumb string, text string")


def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each site: its pages, those read, those in English, what it loads of its own and of others."""
    p = _read(spark, sf_dir).select("page_id", site_of(F.col("url")).alias("site"), "text", "n").join(page_class(spark, sf_dir), "page_id")
    from .textual import is_english

    g = p.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.col("kind") == "content").alias("fetched_ok"), F.count_if((F.col("kind") == "content") & is_english(F.col("text"))).alias("english_ok"))
    own = static_resources(spark, sf_dir).groupBy(site_of(F.col("page")).alias("site")).agg(F.count_if(site_of(F.col("url")) == site_of(F.col("page"))).alias("own_resources"), F.count_if(site_of(F.col("url")) != site_of(F.col("page"))).alias("other_resources"))
    return g.join(own, "site", "left").fillna(0, ["own_resources", "other_resources"])


def crawl_counters_sql() -> str:
    from .textual import is_english_sql

    kinds = PAGE_CLASS_SQL[len("WITH ") + len(_READ_SQL) + 2 :]
    return (
        f"WITH {_READ_SQL}, {kinds.replace(' SELECT page_id, CASE ', ', kinds AS (SELECT page_id, CASE ', 1)}), {RESOURCES_SQL[len(PAGES_SQL) + 2 :]}, "
        f"r AS (SELECT {site_sql('page')} AS site, count_if({site_sql('url')} = {site_sql('page')}) AS a, count_if({site_sql('url')} <> {site_sql('page')}) AS b FROM resources GROUP BY 1), "
        f"g AS (SELECT {site_sql('url')} AS site, count(*) AS pages, count_if(kind = 'content') AS fetched_ok, count_if(kind = 'content' AND {is_english_sql('text')}) AS english_ok FROM read JOIN kinds USING (page_id) GROUP BY 1) "
        "SELECT site, pages, CAST(fetched_ok AS BIGINT) AS fetched_ok, CAST(english_ok AS BIGINT) AS english_ok, CAST(coalesce(a, 0) AS BIGINT) AS own_resources, CAST(coalesce(b, 0) AS BIGINT) AS other_resources FROM g LEFT JOIN r USING (site)"
    )


def timeout_breaker(spark: SparkSession, sf_dir: str, after: int = 3) -> DataFrame:
    """Events of each user up to the third failure in a row, in order of time; what comes after it isn't tried. Here an event fails if its value is under 15."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.coalesce(F.col("value") < 15, F.lit(False)).alias("failed"))
    e = e.withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("in_row", F.when(F.col("failed"), F.sum(F.col("failed").cast("int")).over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    broken = F.max(F.col("in_row") >= after).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("broken", F.coalesce(broken, F.lit(False))).where("not broken").groupBy("user_id").agg(F.count("*").alias("tried"), F.max("in_row").cast("int").alias("longest_run"))


BREAKER_SQL = (
    "WITH e AS (SELECT user_id, event_id, ts, coalesce(value < 15, false) AS failed FROM events), a AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), "
    "b AS (SELECT *, CASE WHEN failed THEN count_if(failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS in_row FROM a), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, min(CASE WHEN in_row >= 3 THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken FROM b) "
    "SELECT user_id, count(*) AS tried, CAST(max(in_row) AS INTEGER) AS longest_run FROM c WHERE broken IS NULL GROUP BY user_id"
)

QUERIES = {
    "page_links": (lambda s, d: links(s, d).drop("page"), f"WITH {LINKS_SQL} SELECT page_id, source, place, anchor, url FROM links"),
    "scored_links": (scored_links, f"WITH {SCORED_SQL} SELECT * FROM scored"),
    "link_candidates": (link_candidates, f"WITH {SCORED_SQL} SELECT page_id, url, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER) AS place FROM scored WHERE NOT low_value QUALIFY place <= 6"),
    "hub_links": (hub_links, f"WITH {SCORED_SQL} SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER) AS place FROM scored WHERE regexp_matches(lower(anchor), '{HUB_TEXT}') OR regexp_matches(lower(url), '{HUB_URL}') QUALIFY place <= 3"),
    "policy_likeliness": (policy_likeliness, f"WITH {_READ_SQL} SELECT page_id, likely, n >= 1000 AND likely >= 8 AND (regexp_matches(lower(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1)), 'privacy|policy|notice|datenschutz') OR regexp_matches(lower(text), 'privacy policy|privacy notice')) AS is_policy FROM read"),
    "accepted_policies": (accepted_policies, f"WITH {_READ_SQL}, tiers AS (SELECT page_id, {site_sql('url')} AS site, likely, n, CASE WHEN (likely >= 5 AND n >= 300) OR (likely >= 4 AND n >= 500) OR (likely >= 3 AND n >= 800) THEN 0 WHEN likely >= 3 AND n >= 200 THEN 1 END AS tier FROM read) SELECT site, page_id, tier FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY tier, likely DESC, n DESC, page_id) = 1"),
    "page_class": (page_class, PAGE_CLASS_SQL),
    "static_resources": (lambda s, d: static_resources(s, d).drop("page"), f"WITH {RESOURCES_SQL} SELECT page_id, url FROM resources"),
    "third_parties": (third_parties, f"WITH {RESOURCES_SQL} SELECT page_id, string_agg(DISTINCT {site_sql('url')}, ' ' ORDER BY {site_sql('url')}) AS third_parties FROM resources WHERE {site_sql('url')} NOT IN ('', {site_sql('page')}) GROUP BY page_id"),
    "third_party_domains": (third_party_domains, lambda: f"WITH {RESOURCES_SQL}, kinds AS (SELECT * FROM ({PAGE_CLASS_SQL})) SELECT count(DISTINCT {site_sql('url')}) AS domains, count(DISTINCT CASE WHEN kind = 'content' THEN {site_sql('url')} END) AS domains_of_read_pages FROM resources JOIN kinds USING (page_id) WHERE {site_sql('url')} NOT IN ('', {site_sql('page')})"),
    "ordered_links": (ordered_links, f"WITH {LINKS_SQL} SELECT page_id, string_agg(url, ' ' ORDER BY pos, url) AS urls FROM (SELECT page_id, url, min(CASE WHEN source = 'footer' THEN place ELSE place + 1000000000 END) AS pos FROM links GROUP BY ALL) GROUP BY page_id"),
    "safe_names": (safe_names, SAFE_SQL),
    "fallback_urls": (fallback_urls, f"WITH {PAGES_SQL} SELECT DISTINCT host, 'https://' || host || path AS url, 2.8::DOUBLE AS score FROM (SELECT lower(regexp_extract(url, '{HOST}', 1)) AS host FROM p), {o.values([(x,) for x in PATHS], 'path')}"),
    "heading_chunks": (heading_chunks, None),
    "crawl_counters": (crawl_counters, crawl_counters_sql),
    "timeout_breaker": (timeout_breaker, BREAKER_SQL),
}
