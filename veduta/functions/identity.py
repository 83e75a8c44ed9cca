"""Stable identities and identity shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veduta.functions.text import title_key

#: The shapes of an identity, in the order of its tests.
SHAPES = ("numeric", "uuid", "source_prefixed", "url_like", "date_composite", "slug_or_text", "other")
#: Version 1 to 5, variant 8 to b.
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def event_key(source: Column, source_id: Column) -> Column:
    """source:first 24 hex digits of the SHA-256 of source, NUL and id."""
    return F.concat(source, F.lit(":"), F.substring(F.sha2(F.concat(source, F.lit("\u0000"), source_id).cast("binary"), 256), 1, 24))


def stable_identity(prefix: str, *parts: Column) -> Column:
    """prefix:first 24 hex digits of the SHA-256 of the parts joined by ``|``; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 24))


def named_identity(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.md5(F.lower(name).cast("binary")))


def work_identity(composer_id: Column, title: Column) -> Column:
    """``work:`` and the MD5 of composer and title key; no composer counts as empty."""
    joined = F.concat_ws("|", F.coalesce(composer_id.cast("string"), F.lit("")), title_key(title))
    return F.concat(F.lit("work:"), F.md5(joined.cast("binary")))


def short_digest(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, digits)


def identity_shape(value: Column, source: Column) -> Column:
    """The first of SHAPES that fits the trimmed value.

    A prefix needs something after it, a date no digit on either side, and a text at least one letter
    among letters, digits, spaces and the marks of titles."""
    v = F.trim(F.coalesce(value, F.lit("")))
    prefix = F.concat(source, F.lit(":"))
    tests = (
        v.rlike(r"^\p{Nd}+$"),
        v.rlike(_UUID),
        v.startswith(prefix) & (F.length(v) > F.length(prefix)),
        v.rlike(r"(?i)^(?:https?:)?//|(?i)^www\."),
        v.rlike(r"(?<![0-9])\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}(?![0-9])"),
        v.rlike(r"^[\p{L}\p{N}_][\p{L}\p{N}_ .:/+'()–—-]*$") & v.rlike(r"\p{L}"),
    )
    out = F.when(tests[0], SHAPES[0])
    for test, shape in zip(tests[1:], SHAPES[1:], strict=False):
        out = out.when(F.coalesce(test, F.lit(False)), shape)
    return out.otherwise(SHAPES[-1])


#: Fixed value: the namespace of url names, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat_ws("-", *parts)
