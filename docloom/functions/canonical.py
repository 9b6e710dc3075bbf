"""Canonical forms of texts, paths and hashes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_only(text: Column) -> Column:
    """The letters of ``text`` in order, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def letters_digits(text: Column) -> Column:
    """The letters and digits of ``text`` in order, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def site_of(source_path: Column) -> Column:
    """First component of a path, after any scheme or ``./``, whatever its case and slashes; blank gives null."""
    path = F.translate(F.lower(F.trim(source_path)), "\\", "/")
    path = F.regexp_replace(path, r"^(?:[a-z][a-z0-9+.\-]*:/*|\./+|/+)+", "")
    return F.nullif(F.regexp_extract(path, r"^[^/]*", 0), F.lit(""))


def sha256_digits(file_hash: Column) -> Column:
    """The 64 hexadecimal digits a hash denotes, in lower case; null where it has another number of digits.

    Prefixes (``sha256:``, ``SHA256=``, ``0x``), separators, blanks and case don't count.
    """
    bare = F.regexp_replace(F.lower(file_hash), r"^\s*(?:sha-?_?256\s*[:=]?\s*)?(?:0x)?", "")
    bare = F.regexp_replace(bare, r"[\s:_\-]+", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of ``cols``: a key of 128 bits in two longs."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *reversed(cols))]
