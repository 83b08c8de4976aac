"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab as v


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def is_blank(c) -> Column:
    """Null, empty or white space only."""
    c = col(c)
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def clean_id(c) -> Column:
    """Identifiers never keep the pipe character."""
    return F.translate(col(c), "|", "")


def iri(local_name) -> Column:
    """Term IRI of an element name; the element's own namespace plays no part."""
    return F.concat(F.lit(v.NS), col(local_name))


def stable_id(*parts) -> Column:
    """128-bit id of the parts: SHA-256 over the parts joined by U+001F, nulls as U+0000.

    The text form follows the GUID layout (first three fields little-endian), 32 hex digits.
    """
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p), F.lit("\x00")) for p in parts])
    # pieces of bytes are copied, pieces of text would be searched character by character
    digest = F.sha2(joined, 256).cast("binary")
    # fixed byte order of a GUID's text form
    order = (3, 2, 1, 0, 5, 4, 7, 6)
    head = [F.substring(digest, 2 * i + 1, 2) for i in order]
    return F.concat(*head, F.substring(digest, 17, 16)).cast("string")


def logical_path(path) -> Column:
    """File identity that does not change when a folder tree is moved: upper-cased part from the last
    ``originals`` (else ``meta``) folder on, else the file name."""
    norm = F.regexp_replace(F.translate(col(path), "\\", "/"), "/+$", "")
    originals = F.regexp_extract(norm, r"(?is)^.*/(originals/.*)$", 1)
    meta = F.regexp_extract(norm, r"(?is)^.*/(meta/.*)$", 1)
    name = F.regexp_extract(norm, r"(?s)([^/]*)$", 1)
    return F.upper(F.when(originals != "", originals).when(meta != "", meta).otherwise(name))


def anonymous_id(cassette_id, db_id, path, ordinal, element, prefix: str) -> Column:
    """Repeatable id of a record that names none. ``prefix`` is the deployment's URN prefix."""
    text = F.concat_ws(
        "\n", F.upper(col(cassette_id)), F.coalesce(F.trim(col(db_id)), F.lit("")), logical_path(path),
        col(ordinal).cast("string"), col(element))
    return F.concat(F.lit(prefix), F.sha2(text, 256))
