"""Choice of localized texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import col


def pick_label(labels, language) -> Column:
    """Preferred language, then no language, ru, en, then the first entry; null for no entries."""
    labels = col(labels)
    wanted = language if isinstance(language, Column) else F.lit(language)

    def first(test) -> Column:
        return F.get(F.filter(labels, test), 0)["value"]

    def lang_is(text: Column):
        return lambda x: F.lower(x["lang"]) == F.lower(text)

    return F.coalesce(
        first(lang_is(wanted)), first(lambda x: x["lang"].isNull()),
        first(lang_is(F.lit("ru"))), first(lang_is(F.lit("en"))), F.get(labels, 0)["value"])


def language_rank(lang, language: str) -> Column:
    """Order of name languages: preferred 0, none 1, ru 2, en 3, other 4."""
    low = F.lower(col(lang))
    return (F.when(low == language.lower(), 0).when(low.isNull() | (low == ""), 1)
            .when(low == "ru", 2).when(low == "en", 3).otherwise(4))
