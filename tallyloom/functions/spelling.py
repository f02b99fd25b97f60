"""Canonical forms of keys, tags, units and dates that sources spell in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of public reporting taxonomies that may stand before a tag.
TAXONOMIES = ("us-gaap", "ifrs-full", "dei", "srt", "invest")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def real_date(c: Column | str) -> Column:
    """A DATE from the spellings in use (ISO with or without a time part, compact, slashes either way round with the
    month first, ``01-Apr-2009`` and ``Apr 1, 2009``); NULL for anything that is no real calendar date.

    Each pattern is tested before it is parsed, so the usual ISO rows take one cast and no failed parse.
    """
    s = F.trim(_col(c))
    iso = F.substring(s, 1, 10)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), iso.try_cast("date"))
        .when(s.rlike(r"^\d{8}$"), F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2)).try_cast("date"))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(s, "/", "-").try_cast("date"))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.regexp_replace(s, r"^(\d+)/(\d+)/(\d+)$", "$3-$1-$2").try_cast("date"))
        .when(s.rlike(r"(?i)^\d{1,2}[- ][a-z]{3}[a-z]*\.?[- ]\d{4}$"), _named_month(s, r"(?i)^(\d+)[- ]([a-z]{3})[a-z]*\.?[- ](\d+)$", 3, 2, 1))
        .when(s.rlike(r"(?i)^[a-z]{3}[a-z]*\.? \d{1,2}, ?\d{4}$"), _named_month(s, r"(?i)^([a-z]{3})[a-z]*\.? (\d+), ?(\d+)$", 3, 1, 2))
    )


def _named_month(s: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda i: F.regexp_extract(s, pattern, i)
    place = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(part(month)))
    number = F.when((place > 0) & (place % 3 == 1), ((place + 2) / 3).cast("int"))
    return F.concat_ws("-", part(year), number.cast("string"), part(day)).try_cast("date")


def iso_text(c: Column | str) -> Column:
    """``yyyy-MM-dd`` of a real date, else NULL."""
    return F.date_format(real_date(c), "yyyy-MM-dd")


def tag_name(c: Column | str) -> Column:
    """A tag without its taxonomy, case, blanks and separators: ``us-gaap:SalesNetTotal`` and ``sales_net_total`` agree."""
    bare = F.regexp_replace(F.lower(F.trim(_col(c))), rf"^(?:[a-z][a-z0-9-]*:|(?:{'|'.join(TAXONOMIES)})_)", "")
    return F.regexp_replace(bare, r"[^a-z0-9]", "")


def unit_name(c: Column | str) -> Column:
    """A unit without namespaces, case and blanks: ``iso4217:USD/xbrli:shares`` and ``USD-per-shares`` agree."""
    low = F.regexp_replace(F.lower(_col(c)), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(low, r"(?:iso4217|xbrli)[:_]", ""), r"[-_]?per[-_]", "/")


def item_name(c: Column | str) -> Column:
    """An item key in lower case with single underscores."""
    return F.regexp_replace(F.lower(F.trim(_col(c))), r"[\s_-]+", "_")
