"""Normal forms of keys, paths, digests and times."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def key(column: Column | str) -> Column:
    """Trimmed, lower-cased key."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.trim(c))


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(column: Column) -> Column:
    """NFC form; only texts with characters that NFC may change leave the JVM as values."""
    other = F.when(column.rlike(r"[^\x00-\u02FF\u2010-\u2027\u2030-\u205E\u20AC\uFEFF]"), column)
    return F.coalesce(_nfc(other), column)


def rel_path(column: Column | str) -> Column:
    """NFC, ``/`` as the only separator, none doubled, no leading ``./``."""
    c = F.col(column) if isinstance(column, str) else column
    p = F.regexp_replace(F.translate(nfc(c), "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(p, "^(\\./)+", "")


def digest(column: Column | str) -> Column:
    """Bare lower-case hex digest of ``sha256:AB..``, `` AB..`` and the like; blank is null."""
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(key(c), "^[a-z0-9-]+:", "")
    return F.when(bare != "", bare)


def instant(column: Column | str) -> Column:
    """Microseconds since the epoch of a time in any delivered notation.

    ISO with ``T`` or blank, with ``Z``, offset or no zone (UTC), and whole or
    fractional epoch seconds (13 digits and more: milliseconds). Null if none fits.
    """
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    zoned = F.when(c.rlike("(?i)(z|[+-]\\d{2}:?\\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    zoned = F.regexp_replace(zoned, "([+-]\\d{2})(\\d{2})$", "$1:$2")
    iso = F.unix_micros(F.upper(zoned).try_cast("timestamp"))
    number = c.try_cast("decimal(30,6)")
    scale = F.when(F.abs(number) >= 100_000_000_000, 1_000).otherwise(1_000_000)
    return F.when(c.rlike("^[+-]?\\d+(\\.\\d+)?$"), (number * scale).try_cast("bigint")).otherwise(iso)
