"""Search text: folding, tokens, prefix keys and alternative spellings. All but the non-ASCII fold stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .ids import col

# fixed set of word delimiters
DELIMITERS = " \r\n\t,.:-!?\"'=\\|/()[]{};*<>"

# fixed keyboard rows, position by position
ENGLISH_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,./`"
RUSSIAN_KEYS = "йцукенгшщзхъфывапролджэячсмитьбю.ё"

# fixed Cyrillic to Latin letters
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i",
    "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya",
}

# fixed Latin sequences and letters to Cyrillic; the first sequence that fits wins
LATIN_TO_CYRILLIC = {
    "shch": "щ", "sch": "щ", "yur": "юр", "yo": "ё", "jo": "ё", "io": "ё", "zh": "ж", "kh": "х", "ts": "ц",
    "ch": "ч", "sh": "ш", "yu": "ю", "ju": "ю", "iu": "ю", "ya": "я", "ja": "я", "ia": "я", "ye": "е", "je": "е",
    "iy": "ий", "ii": "ий", "ei": "ей", "ey": "ей", "ay": "ай", "oy": "ой", "uy": "уй",
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й",
    "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т",
    "u": "у", "v": "в", "w": "в", "x": "кс", "y": "ы", "z": "з",
}

# ranks of the spellings of a query
RANK_ORIGINAL, RANK_KEYBOARD, RANK_TRANSLITERATION = 300, 220, 160


def _normalizer(upper: bool):
    # letters whose upper case would grow, such as the sharp s, stay as they are
    growing = re.compile("([" + "".join(ch for n in range(0x80, 0x10000) if not 0xD800 <= n < 0xE000 and len((ch := chr(n)).upper()) > 1) + "])")

    # built here so that the function travels to the executors by value, whatever they can import
    def normalize(values: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            text = unicodedata.normalize("NFKC", text)
            if not upper:
                return text
            parts = growing.split(text)
            parts[::2] = [part.upper() for part in parts[::2]]
            return "".join(parts)

        return values.map(one, na_action="ignore")

    return F.pandas_udf(normalize, StringType())


def _ascii(c: Column) -> Column:
    return c.rlike(r"^\p{ASCII}*$")


def nfkc(c) -> Column:
    """Compatibility composition; ASCII text, which it cannot change, is not sent to Python."""
    c = col(c)
    return F.when(_ascii(c), c).otherwise(_normalizer(False)(F.when(~_ascii(c), c)))


def fold(c) -> Column:
    """NFKC, then simple upper case."""
    c = col(c)
    return F.when(_ascii(c), F.upper(c)).otherwise(_normalizer(True)(F.when(~_ascii(c), c)))


def split_words(folded) -> Column:
    """Non-blank words of folded text, in order, repeats kept."""
    folded = col(folded)
    words = F.split(F.translate(folded, DELIMITERS, " " * len(DELIMITERS)), " ")
    # other white space is rare, and only its words need trimming
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"(?U)^\s+|\s+$", ""))
    return F.filter(F.when(folded.rlike(r"(?U)[\s&&[^ \r\n\t]]"), trimmed).otherwise(words), lambda w: w != "")


def tokens(c) -> Column:
    return split_words(fold(c))


def _silent_class() -> str:
    """Character class of everything that normalizes to delimiters and white space only."""
    silent = [chr(n) for n in range(0x10000) if not 0xD800 <= n < 0xE000
              and all(ch.isspace() or ch in DELIMITERS for ch in unicodedata.normalize("NFKC", chr(n)))]
    return "".join(f"\\u{ord(ch):04x}" for ch in silent)


_SPEAKING = f"[^{_silent_class()}]"


def has_words(c) -> Column:
    """True if the text holds at least one word; decided without normalizing it."""
    return col(c).rlike(_SPEAKING)


def phrase(c) -> Column:
    """Normalized form of a name or query: its words joined by one blank."""
    return F.array_join(tokens(c), " ")


def prefixes(c) -> Column:
    """All non-empty prefixes by code point."""
    c = col(c)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(c, n))).otherwise(
        F.array().cast("array<string>"))


def prefix_keys(words) -> Column:
    """Distinct prefixes of the whole phrase and of every word."""
    words = col(words)
    return F.array_distinct(F.flatten(F.concat(
        F.array(prefixes(F.array_join(words, " "))), F.transform(words, prefixes))))


def _keyboard_table() -> tuple[str, str]:
    table: dict[str, str] = {}
    for english, russian in zip(ENGLISH_KEYS, RUSSIAN_KEYS):
        for source, target in ((russian, english), (english, russian)):
            if source == russian and source in ENGLISH_KEYS:
                continue  # keys of the English row are looked up there first
            table[source] = target
            if source.upper() != source:
                table[source.upper()] = target.upper()
    return "".join(table), "".join(table.values())


def swap_keyboard(c) -> Column:
    """The text as typed on the other keyboard layout; letter case is kept."""
    return F.translate(col(c), *_keyboard_table())


def cyrillic_to_latin(c) -> Column:
    text = nfkc(c)
    single = {k: t for k, t in CYRILLIC_TO_LATIN.items() if len(t) == 1}
    keep = "".join(single) + "".join(single).upper()
    drop = "".join(k + k.upper() for k, t in CYRILLIC_TO_LATIN.items() if t == "")
    text = F.translate(text, keep + drop, "".join(single.values()) * 2)
    for letter, latin in CYRILLIC_TO_LATIN.items():
        if len(latin) > 1:
            text = F.regexp_replace(text, f"[{letter}{letter.upper()}]", latin)
    return text


def latin_to_cyrillic(c) -> Column:
    """Left to right, longest listed sequence rules first, then single letters; other characters stay."""
    pieces = F.regexp_extract_all(
        F.lower(nfkc(c)), F.lit("(?s)(" + "|".join(LATIN_TO_CYRILLIC) + "|.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in LATIN_TO_CYRILLIC.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def spellings(query) -> Column:
    """Array of (text, rank): the query, its keyboard swap and its transliterations where they apply."""
    q = col(query)

    def one(text: Column, rank: int, applies: Column) -> Column:
        return F.when(applies, F.struct(text.alias("text"), F.lit(rank).alias("rank")))

    swapped = swap_keyboard(q)
    return F.filter(
        F.array(
            one(q, RANK_ORIGINAL, q.isNotNull()),
            one(swapped, RANK_KEYBOARD, swapped != q),
            one(cyrillic_to_latin(q), RANK_TRANSLITERATION, q.rlike("[\u0400-\u04ff]")),
            one(latin_to_cyrillic(q), RANK_TRANSLITERATION, q.rlike("[A-Za-z]"))),
        lambda s: s.isNotNull())


def name_score(value_phrase, key) -> Column:
    """3 whole name, 2 beginning of the name, 1 beginning of a word."""
    p, k = col(value_phrase), col(key)
    return F.when(p == k, 3).when(F.startswith(p, k), 2).otherwise(1)


def label_form(c) -> Column:
    """Form in which class labels are compared: NFKC, trimmed, lower case, ё as е, single blanks."""
    text = F.translate(F.lower(nfkc(c)), "ё", "е")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def terminal_name(c) -> Column:
    """Last part of an IRI after ``/`` or ``#``; the whole text when that part is empty."""
    tail = F.regexp_extract(col(c), r"(?s)([^/#]*)$", 1)
    return F.when(tail == "", col(c)).otherwise(tail)
