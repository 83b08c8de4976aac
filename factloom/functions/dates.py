"""Partial dates: display text and sort key of values such as ``1983``, ``1983-01`` or ``1983янв7``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import col, is_blank, let

# fixed month names
MONTHS = ("Январь", "Февраль", "Март", "Апрель", "Май", "Июнь",
          "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь")
MONTHS_GENITIVE = ("января", "февраля", "марта", "апреля", "мая", "июня",
                   "июля", "августа", "сентября", "октября", "ноября", "декабря")
# fixed month abbreviations
MONTH_KEYS = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "авг": 8,
              "сен": 9, "сент": 9, "окт": 10, "ноя": 11, "дек": 12}

# fixed shapes, matched on lower-case text without white space
_NUMERIC = r"^(\d{4})(?:[-./]?(\d{1,2})(?:[-./]?(\d{1,2}))?)?$"
_NAMED = r"^(\d{4})([а-яё]{3,4})(\d{1,2})?$"
_LEADING = r"^(\d{4})"

# full dates, matched on the trimmed source: year first with a time, day first, day first with a month name
_ISO_TIME = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ]+\d{1,2}:\d{2}"
_DAY_FIRST = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})(?:\s.*)?$"
_DAY_NAMED = r"^(\d{1,2})\s+([А-Яа-яё]+)\s+(\d{4})(?:\s.*)?$"


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("int"))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Struct of the parts when they form a calendar date; month and day may be absent."""
    def checked(x: Column) -> Column:
        m, d = F.coalesce(x["m"], F.lit(1)), F.coalesce(x["d"], F.lit(1))
        # the clamps keep make_date inside its domain; the bounds test rejects what they changed
        first = F.make_date(F.greatest(x["y"], F.lit(1)), F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1))
        return F.when(x["y"].between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= F.dayofmonth(F.last_day(first))), x)

    return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), checked)


def _table(pairs) -> str:
    return "map(" + ", ".join(f"'{k}', {n}" for k, n in pairs) + ")"


def _read(t: Column) -> Column:
    """Parts (y, m, d) of a text given as source and compact form."""
    source, compact = t["source"], t["compact"]
    months, genitive = F.expr(_table(MONTH_KEYS.items())), F.expr(_table((n, i) for i, n in enumerate(MONTHS_GENITIVE, 1)))
    absent = F.lit(None).cast("int")

    def parts(text: Column, pattern: str, *groups: int):
        return [_part(text, pattern, g) for g in groups]

    def named(month: Column, year: Column, day: Column) -> Column:
        return let(month, lambda m: F.when(m.isNotNull(), _date(year, m, day)))

    leading = let(_part(compact, _LEADING, 1), lambda y: F.when(
        y.isNotNull(), F.struct(y.alias("y"), absent.alias("m"), absent.alias("d"))))
    return F.coalesce(
        _date(*parts(compact, _NUMERIC, 1, 2, 3)),
        named(F.try_element_at(months, F.regexp_extract(compact, _NAMED, 2)), *parts(compact, _NAMED, 1, 3)),
        _date(*parts(source, _ISO_TIME, 1, 2, 3)),
        _date(*parts(source, _DAY_FIRST, 3, 2, 1)),
        _date(*parts(source, _DAY_FIRST, 3, 1, 2)),
        named(F.try_element_at(genitive, F.lower(F.regexp_extract(source, _DAY_NAMED, 2))), *parts(source, _DAY_NAMED, 3, 1)),
        leading)


def _show(found: Column) -> Column:
    y, m, d = found["y"], found["m"], found["d"]
    year_text = F.concat(y.cast("string"), F.lit(" г."))
    names, genitives = (F.expr("array(" + ", ".join(f"'{n}'" for n in group) + ")") for group in (MONTHS, MONTHS_GENITIVE))
    display = (F.when(m.isNull(), year_text)
               .when(d.isNull(), F.concat_ws(" ", F.get(names, m - 1), year_text))
               .otherwise(F.concat_ws(" ", d.cast("string"), F.get(genitives, m - 1), year_text)))
    sort = F.format_string("%04d-%02d-%02d", y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)))
    return F.when(found.isNotNull(), F.struct(display.alias("display"), sort.alias("sort")))


# year, month and day in full, as most dates are stored; compiled by Spark, unlike the lambdas that read the other shapes
_PLAIN = r"^(?!0000)\d{4}(-\d{2}(-\d{2})?)?\z"


def _show_plain(c: Column) -> Column:
    """``parse_date`` of a valid text of the shape ``_PLAIN``."""
    def number(at: int, size: int) -> Column:
        return F.substring(c, at, size).try_cast("int")  # what is shared by branches is computed for texts of other shapes too

    names, genitives = (F.expr("array(" + ", ".join(f"'{n}'" for n in group) + ")") for group in (MONTHS, MONTHS_GENITIVE))
    year_text, size, month = F.concat(number(1, 4).cast("string"), F.lit(" г.")), F.length(c), number(6, 2) - 1
    display = (F.when(size == 4, year_text).when(size == 7, F.concat_ws(" ", F.get(names, month), year_text))
               .otherwise(F.concat_ws(" ", number(9, 2).cast("string"), F.get(genitives, month), year_text)))
    sort = F.when(size == 4, F.concat(c, F.lit("-01-01"))).when(size == 7, F.concat(c, F.lit("-01"))).otherwise(c)
    return F.struct(display.alias("display"), sort.alias("sort"))


def parse_date(c) -> Column:
    """Struct (display, sort) of a partial date, or null."""
    c = col(c)
    return F.when(c.rlike(_PLAIN) & c.try_cast("date").isNotNull(), _show_plain(c)).otherwise(_parse_any(c))


def _parse_any(c: Column) -> Column:
    source = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    compact = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    texts = F.struct(source.alias("source"), compact.alias("compact"))
    return F.when(~is_blank(c), let(texts, lambda t: let(_read(t), _show)))
