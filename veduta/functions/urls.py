"""URL canonicalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(c: Column) -> Column:
    """http(s) urls with scheme and authority lower-cased, repeated and trailing slashes of the path
    dropped (an empty path becomes ``/``), without query and fragment. Other schemes and malformed
    urls give null."""
    c = F.trim(c)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"/$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(scheme.isin("http", "https") & (authority != ""), F.concat(scheme, F.lit("://"), authority, path))


def resolved(base: Column, href: Column) -> Column:
    """The url that ``href`` names on a page at ``base``, by RFC 3986: with its own scheme or host, from
    the root, or beside the page; ``.`` and ``..`` are resolved. An empty href is the page itself."""
    href = F.trim(F.coalesce(href, F.lit("")))
    scheme, origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    page = F.regexp_extract(F.substring(base, F.length(origin) + 1, F.length(base)), r"^[^?#]*", 0)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    tail = F.regexp_extract(href, r"[?#].*$", 0)
    own = F.regexp_extract(href, r"^[^?#]*", 0)
    folder = F.regexp_replace(page, r"[^/]*$", "")
    path = F.when(own == "", page).when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    step = lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    ends = F.element_at(parts, -1).isin(".", "..")
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    clean = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(ends & (F.size(walked) > 0), F.lit("/")).otherwise(F.lit("")))
    beside = F.concat(origin, F.when(own == "", page).otherwise(clean), F.when((own == "") & ~tail.startswith("?"), F.concat(query, tail)).otherwise(tail))
    return F.when(href == "", base).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).otherwise(beside)


def canonical_keeping_query(c: Column, host: str) -> Column:
    """Canonical url of one host with its query, which identifies pages there; null on other hosts."""
    query = F.regexp_extract(F.trim(c), r"^[^?#]*(\?[^#]+)", 1)
    return F.when(url_host(F.trim(c)) == host, F.concat(F.regexp_replace(canonical_url(c), r"^([a-z]+)://[^/]*", f"$1://{host}"), query))


def safe_link(c: Column, fallback: str = "#") -> Column:
    """An http(s) url as it is; ``fallback`` for anything else."""
    trimmed = F.trim(F.coalesce(c, F.lit("")))
    return F.when(trimmed.rlike(r"(?i)^https?:"), trimmed).otherwise(F.lit(fallback))


def url_host(c: Column) -> Column:
    """Host, lower-cased, without user info and port."""
    authority = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(authority)


def without_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


#: Countries told by a top-level domain, and languages told by a tag.
COUNTRY_DOMAINS = {"de": "de", "fr": "fr", "es": "es", "it": "it", "at": "at", "ch": "ch", "pt": "pt", "uk": "gb"}
COUNTRY_LANGUAGES = ("de", "fr", "es", "it", "pt")


def country_of(c: Column) -> Column:
    """Country code of a host's top-level domain, ``other`` for all domains not listed."""
    host = url_host(c)
    named = F.when(host.contains("."), F.create_map(*[F.lit(x) for kv in COUNTRY_DOMAINS.items() for x in kv])[F.substring_index(host, ".", -1)])
    return F.coalesce(named, F.lit("other"))


def country_of_language(c: Column) -> Column:
    """Country code by the first part of a language tag such as ``pt_BR``; ``other`` if not listed."""
    code = F.substring_index(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-")), "-", 1)
    return F.when(code.isin(*COUNTRY_LANGUAGES), code).otherwise(F.lit("other"))
