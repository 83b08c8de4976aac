"""Revision times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import col, is_blank

MIN_TIME = "0001-01-01 00:00:00"

# accepted besides ISO 8601, in order: RFC 1123 without its weekday, month-first with slashes, day-first with dots
_FORMATS = (
    "d MMM yyyy HH:mm:ss XX",
    "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy",
)


def min_time() -> Column:
    return F.lit(MIN_TIME).cast("timestamp")


def try_revision_time(c) -> Column:
    """UTC time of a revision mark; blank is year 1, a mark without zone is UTC, unreadable is null."""
    text = F.trim(col(c))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}"), text.try_cast("timestamp"))
    plain = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""), " GMT$", " +0000")
    others = [F.try_to_timestamp(plain, F.lit(f)) for f in _FORMATS]
    return F.when(is_blank(c), min_time()).otherwise(F.coalesce(iso, *others))


def revision_time(c, place=None) -> Column:
    """As ``try_revision_time`` but unreadable marks end the job with the offending text."""
    where = F.lit("") if place is None else F.concat(F.lit(" in "), col(place))
    failure = F.raise_error(F.concat(F.lit("revision time cannot be read"), where, F.lit(": "), col(c)))
    return F.coalesce(try_revision_time(c), failure.cast("timestamp"))


def whole_second(c) -> Column:
    return F.date_trunc("second", col(c))
