"""Text to typed values. Every parse is guarded by an anchored pattern, so that engines cannot disagree on odd spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.fields import BOOLEAN, DURATION, FLOAT, INTEGER, TIME

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+$"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")
#: Seconds from year 1 to 1970: buckets count from the former.
YEAR_ONE = 62_135_596_800


def number(text: Column) -> Column:
    """A finite double, or null."""
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def whole(text: Column) -> Column:
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def boolean(text: Column) -> Column:
    return F.when(text.isin(*TRUE), F.lit(True)).when(text.isin(*FALSE), F.lit(False))


def moment(text: Column) -> Column:
    return F.when(text.rlike(MOMENT), text.try_cast("timestamp"))


def typed(text: Column, kind: str) -> Column:
    """A text field's value in its descriptor's type; what does not parse is null."""
    if kind == INTEGER:
        return whole(text)
    if kind in (FLOAT, DURATION):
        return number(text)
    if kind == BOOLEAN:
        return boolean(text)
    return moment(text) if kind == TIME else text


def bucket_start(at: Column, nanos: int) -> Column:
    """Start of the tumbling bucket that holds ``at``; buckets are aligned to the year 1, like a calendar week's Monday."""
    micros = F.unix_micros(at)
    if nanos % 1_000:
        raise ValueError("buckets are whole microseconds")
    width, origin = nanos // 1_000, YEAR_ONE * 1_000_000
    return F.timestamp_micros(micros - F.pmod(micros + F.lit(origin % width), F.lit(width)))


def utc_date(at: Column) -> Column:
    """The UTC day of a time, whatever the session's zone: writers and readers of a partition must agree on it."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int"))


def cut_bytes(text: Column, most: int) -> Column:
    """The text, cut to at most ``most`` bytes at the end of a whole character (replacement characters there go as well)."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(head, "\uFFFD+$", ""))


def sized(value: Column) -> Column:
    """Length-prefixed text, or -1: for null; joined, such texts tell any two keys apart."""
    text = value.cast("string")
    return F.when(text.isNull(), "-1:").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
