"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column, most: int = 4000) -> Column:
    """Without white space (of any script) at the ends, cut to `most` characters; null if nothing is left."""
    return F.nullif(F.substring(F.regexp_replace(text.cast("string"), "(?U)^\\s+|\\s+$", ""), 1, most), F.lit(""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.\\-\\u0600-\\u06FF]", "_")


def safe_prefix(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_\\-/]", "")


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^https?://"), F.lit(False))


def escape_html(text: Column) -> Column:
    for one, other in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(one), F.lit(other))
    return text


def uri_encode(text: Column) -> Column:
    """Percent encoding of all but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(text)
    for one, other in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def uri_decode(text: Column) -> Column:
    """What uri_encode() encoded; null if it isn't well-formed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def one_of(value: Column, allowed: list[str], fallback: Column | str | None) -> Column:
    """value if it is allowed, else the fallback."""
    return F.when(value.isin(*allowed), value).otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback))


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The key's label, or the key itself, or a dash if it is null or empty."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)
    return F.coalesce(found, F.nullif(key, F.lit("")), F.lit("—"))


def ticket_number(year: Column, sequence: Column) -> Column:
    """TKT-2026-0001; sequences above 9999 take the digits they need."""
    return F.format_string("TKT-%d-%04d", year, sequence)


def overdue_badge(days: Column) -> Column:
    """The overdue days in words, with the plural that the number takes; empty for none."""
    word = F.when(days == 1, "يوم").when(days == 2, "يومان").when(days <= 10, "أيام").otherwise("يومًا")
    return F.when(days > 0, F.concat_ws(" ", F.lit("متأخرة"), days.cast("string"), word)).otherwise("")
