"""Indicator expressions: kinds of indicator, tokens in free text, URL hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.network import _col, is_ip

# Patterns that decide an indicator's kind, in order.
DOMAIN_PATTERN = "^[a-zA-Z0-9][-a-zA-Z0-9.]*\\.[a-zA-Z]{2,}$"
URL_PATTERN = "^(http|https|ftp)://"
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}

# Fixed value: punctuation cut from both ends of a token.
TOKEN_PUNCTUATION = ".,:;()[]{}\"'"


def indicator_type(value: str | Column) -> Column:
    """ip, domain, url, md5, sha1, sha256 or unknown; the first that fits."""
    value = _col(value)
    kind = F.when(is_ip(value), "ip").when(value.rlike(DOMAIN_PATTERN), "domain").when(value.rlike(URL_PATTERN), "url")
    for name, digits in HASH_LENGTHS.items():
        kind = kind.when(value.rlike(f"^[a-fA-F0-9]{{{digits}}}$"), name)
    return kind.otherwise("unknown")


def text_indicators(text: str | Column) -> Column:
    """Array of struct(type, value): domain- and URL-like tokens of a text."""
    tokens = F.split(_col(text), "\\s+")

    def strip(token: Column) -> Column:
        return F.btrim(token, F.lit(TOKEN_PUNCTUATION))

    def kind(token: Column) -> Column:
        is_url = token.startswith("http://") | token.startswith("https://")
        is_domain = token.contains(".") & ~token.startswith("http") & strip(token).contains(".")
        return F.when(is_url & (strip(token) != ""), "url").when(is_domain, "domain")

    found = F.filter(tokens, lambda t: kind(t).isNotNull())
    return F.transform(found, lambda t: F.struct(kind(t).alias("type"), strip(t).alias("value")))


def extract_indicators(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct (row, type, value); ``text`` itself is dropped."""
    rest = [c for c in df.columns if c != text]
    found = df.select(*rest, F.explode(F.array_distinct(text_indicators(text))).alias("_found"))
    return found.select(*rest, F.col("_found.type").alias("indicator_type"), F.col("_found.value").alias("value"))


def url_host(url: str | Column) -> Column:
    """Network location of a URL (with user and port, as written); empty when there is none."""
    return F.regexp_extract(_col(url), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
