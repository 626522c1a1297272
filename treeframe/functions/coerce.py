"""Text to typed values, strictly: what cannot be read in full is null. All of it is Spark expressions.

Spark's own casts are more lenient (they trim, and read "t" as true), so patterns guard them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?)$"
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_LOCAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?$"
_INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def coerce(x: Column, kind: T.DataType, fmt: str | None = None) -> Column:
    """The text x as a value of that kind; null if it is none. fmt is a pattern of Spark's, for times and decimals."""
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.when(x.rlike(_INTEGER), x.try_cast(kind))
    if isinstance(kind, T.DoubleType):
        t = F.regexp_replace(x, _ENDS, "")
        return F.when(t.rlike(_FLOAT), F.regexp_replace(t, r"(?<=[0-9.])[fFdD]$", "").try_cast(kind))
    if isinstance(kind, T.BooleanType):
        t = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
        return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))
    if isinstance(kind, T.DecimalType):
        return _decimal(x, kind, fmt)
    if isinstance(kind, T.DateType):
        return F.try_to_date(x, fmt) if fmt else F.when(x.rlike(_DATE), x.try_cast(kind))
    if isinstance(kind, T.TimestampNTZType):
        if not fmt:
            return F.when(x.rlike(_LOCAL), x.try_cast(kind))
        # Read as of UTC and counted from the epoch, so the session's time zone plays no part.
        utc = F.try_to_timestamp(F.concat(x, F.lit(" +00:00")), F.lit(f"{fmt} XXX"))
        return F.timestamp_add("MICROSECOND", F.unix_micros(utc), F.lit("1970-01-01T00:00:00").cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType):
        if not fmt:
            return F.when(x.rlike(_INSTANT), x.try_cast(kind))
        # A pattern without a zone says no instant.
        return F.try_to_timestamp(x, F.lit(fmt)) if re.search(r"[VzOXxZ]", re.sub(r"'[^']*'", "", fmt)) else F.lit(None).cast(kind)
    raise TypeError(f"no scalar kind: {kind}")


def _decimal(x: Column, kind: T.DecimalType, fmt: str | None) -> Column:
    """A pattern like #,##0.00 allows signs of grouping and may have words before and after the number."""
    if not fmt:
        return F.when(x.rlike(_DECIMAL), x.try_cast(kind))
    m = re.fullmatch(r"((?:'[^']*'|[^#0,.'])*)([#0,.]+)((?:'[^']*'|[^#0,.'])*)", fmt.split(";")[0])
    if not m:
        raise ValueError(f"no decimal pattern: {fmt!r}")
    before, digits, after = re.escape(m[1].replace("'", "")), m[2], re.escape(m[3].replace("'", ""))
    whole = "[0-9][0-9,]*" if "," in digits.split(".")[0] else "[0-9]+"
    number = rf"^(-?){before}({whole}(?:\.[0-9]*)?|\.[0-9]+){after}$"
    plain = F.concat(F.regexp_extract(x, number, 1), F.regexp_replace(F.regexp_extract(x, number, 2), ",", ""))
    value = plain.try_cast(kind)
    return F.when(x.rlike(number), (value / 100).try_cast(kind) if "%" in m[3] else value)
