"""Scalar helpers: encodings, dt spellings, validators, identity tokens.

All are compositions of built-in expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DT_RAW_PATTERN, RUN_ID_PATTERN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_encode_key(key) -> Column:
    """form encoding of an object key (space to '+', '*' kept, '~' to %7E),
    the encoding manifests and the dedup table share."""
    return F.url_encode(_c(key))


def url_decode_key(key) -> Column:
    """inverse of F1; '+' decodes to a space."""
    return F.url_decode(_c(key))


def path_part(path, index: int, sep: str = "/") -> Column:
    """path segment, 0-based from the start, or from the end for a negative
    index (-1 is the last); NULL where there is none."""
    return F.try_element_at(F.split(_c(path), sep), F.lit(index if index < 0 else index + 1))


def is_valid_raw_dt(dt) -> Column:
    """delivery dt in YYYY-MM-DDThh-mmZ form, whole string."""
    return F.coalesce(_c(dt).rlike(DT_RAW_PATTERN), F.lit(False))


def is_valid_run_id(run_id) -> Column:
    """1 to 64 hex digits, whole string (no trailing newline)."""
    return F.coalesce(_c(run_id).rlike(RUN_ID_PATTERN), F.lit(False))


def raw_dt_to_dashed(dt) -> Column:
    """2026-07-18T01-00Z -> 2026-07-18-01-00."""
    return F.regexp_replace(F.translate(_c(dt), "T", "-"), "Z+$", "")


def identity_token(*parts) -> Column:
    """SHA-256 of the '/'-joined parts; the idempotency key of a decision."""
    return F.sha2(F.concat_ws("/", *[_c(p) for p in parts]), 256)


def plural_s(n) -> Column:
    """'s' unless the count is exactly 1."""
    return F.when(_c(n) != 1, F.lit("s")).otherwise(F.lit(""))


def fmt(template: str, *cols) -> Column:
    """Fill a printf-style fixed text format with columns."""
    return F.format_string(template, *[_c(c) for c in cols])


def plural(n, word: str) -> Column:
    """'1 version' / '2 versions'."""
    n = _c(n)
    return F.concat(n.cast("string"), F.lit(" " + word),
                    F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def thousands(n) -> Column:
    """F8: integer with thousands separators."""
    return F.format_number(_c(n).cast("bigint"), 0)
