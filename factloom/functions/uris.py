"""Document addresses of the form ``iiss://folder-name@host/.../0001/0002``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import col, is_blank

SCHEME = "iiss"
HOST = "iis.nsk.su"

# scheme, authority with user part, path; query and fragment are ignored
_SHAPE = r"(?i)^iiss://([^@/?#]*)@([^/?#]*)([^?#]*)"


def _decoded(c: Column) -> Column:
    # a plus sign is an ordinary character in this part of an address
    return F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))


def document_cassette(c) -> Column:
    """Name before the ``@``, decoded; null if the text is no such address."""
    user = _decoded(F.regexp_extract(F.trim(col(c)), _SHAPE, 1))
    return F.when(~is_blank(user), user)


def _parts(c) -> Column:
    path = _decoded(F.regexp_extract(F.trim(col(c)), _SHAPE, 3))
    trimmed = F.transform(F.split(path, "/"), lambda p: F.trim(p))
    return F.filter(trimmed, lambda p: p != "")


def document_folder(c) -> Column:
    return F.try_element_at(_parts(c), F.lit(-2))


def document_number(c) -> Column:
    return F.try_element_at(_parts(c), F.lit(-1))


def safe_part(c) -> Column:
    """Exactly four characters, none of which a file name may not hold."""
    return col(c).rlike(r"^[^/\\\x00]{4}$")


def is_document_uri(c) -> Column:
    return F.coalesce(
        col(c).rlike(r"(?i)^\s*iiss://") & document_cassette(c).isNotNull() & safe_part(document_folder(c)) & safe_part(document_number(c)), F.lit(False))


def document_uri(cassette_name, folder, number) -> Column:
    """Address of a document slot; the folder name is percent-encoded."""
    encoded = F.regexp_replace(F.url_encode(col(cassette_name)), r"\+", "%20")
    return F.concat(F.lit(f"{SCHEME}://"), encoded, F.lit(f"@{HOST}/"), col(folder), F.lit("/"), col(number))
