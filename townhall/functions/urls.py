"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townhall.config import DOCUMENT_URL_WORDS
from townhall.functions.text import contains_any, trim_all

HTTP = "^https?://"


def scheme(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))


def authority(c: Column) -> Column:
    """Host and port."""
    return F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit(""))


def path(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def query(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def absolute_url(url: Column, base: Column | None, strict: bool = False) -> Column:
    """Resolve against the page it was found on.

    Without a usable base the URL stays as it is, or becomes null when ``strict``.
    """
    base = F.lit(None).cast("string") if base is None else base
    u = trim_all(url)
    no_base = F.lit(None).cast("string") if strict else u
    site = F.concat(scheme(base), F.lit("://"), authority(base))
    has_site = scheme(base).isNotNull() & authority(base).isNotNull()
    folder = F.regexp_replace(F.coalesce(path(base), F.lit("/")), "/[^/]*$", "/")
    return (
        F.when(u.isNull() | (F.length(u) == 0), F.lit(None).cast("string"))
        .when(u.rlike(HTTP), u)
        .when(u.startswith("//"), F.concat(F.coalesce(scheme(base), F.lit("https")), F.lit(":"), u))
        .when(~F.coalesce(has_site, F.lit(False)), no_base)
        .when(u.startswith("/"), F.concat(site, u))
        .otherwise(F.concat(site, folder, u))
    )


def sorted_query(c: Column) -> Column:
    q = F.coalesce(query(c), F.lit(""))
    return F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda p: F.length(p) > 0)), "&")


def url_equal(left: Column, right: Column) -> Column:
    """Same scheme, host, path and query, whatever the parameter order."""
    host = lambda c: F.regexp_replace(F.coalesce(authority(c), F.lit("")), ":[0-9]+$", "")
    same = (
        scheme(left).eqNullSafe(scheme(right))
        & (host(left) == host(right))
        & path(left).eqNullSafe(path(right))
        & (sorted_query(left) == sorted_query(right))
    )
    return F.coalesce(same & left.isNotNull() & right.isNotNull(), F.lit(False))


def strip_query(c: Column) -> Column:
    return F.split_part(c, F.lit("?"), F.lit(1))


def query_params(c: Column) -> Column:
    """Query string as a map of decoded values; a repeated key keeps the last one."""
    pairs = F.filter(F.split(F.coalesce(query(c), F.lit("")), "&"), lambda p: F.length(p) > 0)
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("key"),
            F.url_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value"),
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def is_document_url(c: Column) -> Column:
    """Extension or endpoint words of a document link."""
    return contains_any(F.lower(c), DOCUMENT_URL_WORDS)


def usable_url(c: Column) -> Column:
    """Trimmed URL; blank and the word null count as none."""
    t = trim_all(c)
    return F.when((F.length(t) > 0) & (F.lower(t) != "null"), t)


def calendar_link(starts_utc: Column, ends_utc: Column, title: Column, location: Column, details: Column) -> Column:
    """Add-to-calendar URL; a missing end is one hour after the start."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    enc = lambda t: F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    end = F.coalesce(ends_utc, F.timestamp_add("HOUR", F.lit(1), starts_utc))
    dates = F.concat(stamp(starts_utc), F.lit("/"), stamp(end))
    params = F.concat_ws(
        "&",
        F.lit("action=TEMPLATE"),
        F.concat(F.lit("text="), enc(title)),
        F.concat(F.lit("dates="), enc(dates)),
        F.concat(F.lit("details="), enc(details)),
        F.concat(F.lit("location="), enc(location)),
    )
    return F.when(starts_utc.isNotNull(), F.concat(F.lit("https://www.google.com/calendar/render?"), params))
