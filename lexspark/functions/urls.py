"""URL identity and guards over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host in small letters; null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def parameters(url: Column) -> Column:
    """The query's (name in small letters, value) pairs, in order."""
    q = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), F.coalesce(F.try_url_decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)), F.lit("")).alias("value")))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, whatever its letters' case; null if there is none or it is empty."""
    found = F.filter(parameters(url), lambda p: (p["name"] == name.lower()) & (p["value"] != ""))
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(1))["value"])


def lsid(url: Column) -> Column:
    return F.upper(parameter(url, "lsid"))


def source_key(url: Column, prefix: str = "lsid:", ids: Sequence[str] = ("id", "no", "lawid", "uid", "sn", "lawno")) -> Column:
    """A page's identity: its LSID, else its path with the first of its other ids, else the URL with sorted parameters."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    named = [F.concat(F.lower(path), F.lit(f"?{i}="), parameter(url, i)) for i in ids]
    pairs = F.transform(F.array_sort(parameters(url)), lambda p: F.concat(encoded(p["name"]), F.lit("="), encoded(p["value"])))
    plain = F.concat(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit(""))), F.lit("://"), F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))
    return F.coalesce(F.concat(F.lit(prefix), lsid(url)), *named, plain)


def encoded(c: Column) -> Column:
    """A parameter's name or value as it stands in an address."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def print_url(url: Column, page: str = "print.aspx") -> Column:
    """The print view of the law that a URL shows, of the same date where it names one (ldate); null without an LSID."""
    date = parameter(url, "ldate")
    place = F.concat(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("https")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.concat(place, F.lit(f"/{page}?lsid="), encoded(lsid(url)), F.coalesce(F.concat(F.lit("&ldate="), encoded(date)), F.lit("")))


def category_urls(codes: Sequence[str], known: dict[str, str]) -> list[str]:
    """The addresses of category codes, each once, in order; blank codes are left out, unknown ones an error, and so are none at all."""
    wanted = list(dict.fromkeys(c.strip().upper() for c in codes if c.strip()))
    if not wanted:
        raise ValueError("no category code")
    if strange := [c for c in wanted if c not in known]:
        raise ValueError(f"unknown category {strange[0]}; known: {', '.join(sorted(known))}")
    return [known[c] for c in wanted]


def is_detail_url(url: Column) -> Column:
    """Whether a URL looks like one law's page."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.when(lsid(url).isNotNull(), path.contains("law") | path.rlike("/print")).otherwise(path.rlike("law|detail|content|show|view"))


def allowed(url: Column, domains: Sequence[str]) -> Column:
    """Whether a URL is https, without user information, and on one of the domains or below."""
    h = F.coalesce(host(url), F.lit(""))
    on = F.exists(F.array(*(F.lit(d.lower()) for d in domains)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lit(False)) & F.try_parse_url(url, F.lit("USERINFO")).isNull() & on
