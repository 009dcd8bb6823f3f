"""Queries over pages: addresses, plain text, cookies."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ontology as o
from .synth import table

_HOST = r"^[a-z][a-z0-9+.-]*://([^/?#:]+)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, f"(?i){_HOST}", 1))


def site_of(host_: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host_, ".", -2)


def normalised(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no parameters, no fragment, no slash at the end."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)", 1))
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", "")
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(head, F.regexp_replace(path, r"/+$", ""))


NORMALISED_SQL = (
    "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)', 1)), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') "
    "|| regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+', ''), '/+$', '')"
)
HOST_SQL = f"lower(regexp_extract(url, '{_HOST}', 1, 'i'))"
SITE_SQL = f"array_to_string(string_split({HOST_SQL}, '.')[-2:], '.')"


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    h = host(F.col("url"))
    return p.select("page_id", normalised(F.col("url")).alias("normal"), h.alias("host"), site_of(h).alias("site"))


def url_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writer of each normalised address."""
    p = table(spark, sf_dir, "pages").select("page_id", normalised(F.col("url")).alias("normal"))
    return p.groupBy("normal").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(" ".join(data.split()))


def strip_tags(page: str | None) -> str:
    p = _Text()
    p.feed(page or "")
    p.close()
    return "\n".join(p.out)


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each page without its markup, script and style."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b.page_id, "text": [strip_tags(h) for h in b.html]})

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, text string")


COOKIES = ["sid=abc; Path=/; HttpOnly; Secure", "t=1; Domain=ads.example.com; Max-Age=3600; SameSite=None", "plain=value", "empty=", "x=y=z; secure"]


def cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set-Cookie headers, parsed."""
    c = spark.createDataFrame([(x,) for x in COOKIES], "header string")
    parts = F.transform(F.split("header", ";"), lambda x: F.trim(x))
    attr = F.map_from_entries(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("k"), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("v"))))
    c = c.withColumn("first", parts[0]).withColumn("a", attr)
    get = lambda k: F.element_at("a", k)
    has = lambda k: F.array_contains(F.map_keys("a"), k)
    return c.select(
        F.substring_index("first", "=", 1).alias("name"), F.regexp_replace("first", "^[^=]*=", "").alias("value"), F.coalesce(get("domain"), F.lit("")).alias("domain"), F.coalesce(get("path"), F.lit("/")).alias("path"),
        F.coalesce(get("max-age").cast("int"), F.lit(-1)).alias("max_age"), has("secure").alias("secure"), has("httponly").alias("http_only"), F.coalesce(get("samesite"), F.lit("")).alias("same_site"),
    )


COOKIES_SQL = (
    f"SELECT regexp_extract(header, '^([^=;]*)', 1) AS name, regexp_extract(header, '^[^=]*=([^;]*)', 1) AS value, regexp_extract(header, ';\\s*domain=([^;]*)', 1, 'i') AS domain, CASE WHEN regexp_matches(header, ';\\s*path=', 'i') THEN regexp_extract(header, ';\\s*path=([^;]*)', 1, 'i') ELSE '/' END AS path, "
    "CAST(coalesce(try_cast(nullif(regexp_extract(header, ';\\s*max-age=([^;]*)', 1, 'i'), '') AS INTEGER), -1) AS INTEGER) AS max_age, regexp_matches(header, ';\\s*secure\\s*(;|$)', 'i') AS secure, regexp_matches(header, ';\\s*httponly\\s*(;|$)', 'i') AS http_only, regexp_extract(header, ';\\s*samesite=([^;]*)', 1, 'i') AS same_site "
    f"FROM {o.values([(x,) for x in COOKIES], 'header')}"
)


QUERIES = {
    "url_normalize": (url_normalize, f"SELECT page_id, {NORMALISED_SQL} AS normal, {HOST_SQL} AS host, {SITE_SQL} AS site FROM pages"),
    "url_registry": (url_registry, f"SELECT {NORMALISED_SQL} AS normal, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1"),
    "plain_text": (plain_text, None),
    "cookies": (cookies, COOKIES_SQL),
}
