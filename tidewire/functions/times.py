"""Time expressions: ISO text, epoch numbers, UTC days."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ISO-8601 as the usual Python reader accepts it: calendar or week dates, extended or
# compact, any one separator character, optional fraction and offset.
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
_TIME = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?)"
_OFFSET = r"([+-]\d{2}(?::?\d{2})?)(?::?\d{2})?"
_ISO = rf"(?s)^{_DATE}(?:.{_TIME}(?:{_OFFSET})?)?$"
# Digits only, filled up to yyyyMMdd HHmmss.ffffff +HHmm, and with the marks that a cast reads.
_DIGITS = r"^(?!0000)(\d{4})(\d{2})(\d{2}) (\d{2})(\d{2})(\d{2})([.]\d{1,6})\d* ([+-]\d{2})(\d{2})$"
_MARKED = "$1-$2-$3 $4:$5:$6$7$8:$9"

# The common forms, which a plain cast reads as well.
_PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:[+-]\d{2}:\d{2})?)?$"
_HAS_OFFSET = r"[+-]\d{2}:\d{2}$"
_DAY_LENGTH = 10

# Where a news item may hold its time.
TIME_FIELDS = ("providerPublishTime", "pubDate", "published")
NESTED_TIME_FIELDS = ("pubDate", "displayTime")

# First second of the year 10000: a larger number is not a time in seconds.
_EPOCH_LIMIT = 253402300800


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text as an instant; NULL where it is not ISO. Text without an offset is UTC."""
    text = _utc_mark(text)
    return F.when(text.rlike(_PLAIN), _plain(text)).when(text.rlike(_ISO), _by_parts(text))


def _utc_mark(text: Column) -> Column:
    return F.replace(text, F.lit("Z"), F.lit("+00:00"))


def _plain(text: Column) -> Column:
    zone = (
        F.when(F.length(text) == _DAY_LENGTH, " 00:00:00+00:00")
        .when(text.rlike(_HAS_OFFSET), "")
        .otherwise("+00:00")
    )
    return F.concat(text, zone).try_cast("timestamp")


def _by_parts(text: Column) -> Column:
    date = F.replace(F.regexp_extract(text, _ISO, 1), F.lit("-"), F.lit(""))
    time = F.translate(F.regexp_extract(text, _ISO, 2), ",:", ".")
    offset = F.replace(F.regexp_extract(text, _ISO, 3), F.lit(":"), F.lit(""))
    clock = F.rpad(F.substring_index(time, ".", 1), 6, "0")
    fraction = F.when(F.instr(time, ".") > 0, F.substring_index(time, ".", -1)).otherwise("0")
    zone = F.rpad(F.when(offset == "", "+").otherwise(offset), 5, "0")
    day = F.when(F.instr(date, "W") > 0, _week_day(date)).otherwise(date)
    digits = F.concat(day, F.lit(" "), clock, F.lit("."), fraction, F.lit(" "), zone)
    return F.regexp_replace(digits, _DIGITS, _MARKED).try_cast("timestamp")


def _week_day(date: Column) -> Column:
    """``2024W011`` (day 1 if left out) as ``20240101``; NULL where there is no such week or day."""
    year, week = F.substring(date, 1, 4), F.substring(date, 6, 2).cast("int")
    weekday = F.rpad(F.substring(date, 8, 1), 1, "1").cast("int")
    # The week of 4 January is week 1; a week 53 that the year lacks lands in another ISO year.
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")
    day = F.date_add(F.trunc(fourth, "week"), (week - 1) * 7 + weekday - 1)
    thursday = F.date_add(day, 3 - F.weekday(day))
    exists = week.between(1, 53) & weekday.between(1, 7) & (F.year(thursday) == year.cast("int"))
    return F.when(exists, F.date_format(day, "yyyyMMdd"))


_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _epoch(seconds: Column) -> Column:
    in_range = F.abs(seconds) < _EPOCH_LIMIT
    return F.when(in_range, F.timestamp_seconds(seconds.cast("bigint")))


def time_fields(top: Iterable[Column], nested: Iterable[Column]) -> Column:
    """The fields of a news item (VARIANTs) that may hold its time, in order of preference.

    An array of (seconds, text, plain): epoch seconds above zero, or ISO text and whether it is in
    a common form. The nested fields are read as text only.
    """
    def candidate(field: Column, numbers: bool) -> Column:
        kind, value = F.schema_of_variant(field), F.try_variant_get(field, "$", "string")
        seconds = F.when(kind.rlike(_NUMBER), value.try_cast("double")) if numbers else F.lit(None).cast("double")
        text = F.when(kind == "STRING", _utc_mark(value))
        return F.struct(
            F.when(seconds > 0, seconds).alias("seconds"), text.alias("text"), text.rlike(_PLAIN).alias("plain")
        )

    return F.array(*[candidate(field, True) for field in top], *[candidate(field, False) for field in nested])


def item_times(item: Column) -> Column:
    """``time_fields`` of an item that is still one VARIANT."""
    def fields(prefix: str, names: tuple[str, ...]) -> list[Column]:
        return [F.try_variant_get(item, f"{prefix}{name}", "variant") for name in names]

    return time_fields(fields("$.", TIME_FIELDS), fields("$.content.", NESTED_TIME_FIELDS))


def first_time(fields: Column, as_of: Column) -> Column:
    """The first usable of the time fields, else ``as_of``.

    Items in the common forms go through compiled code. The full reader is too long to repeat for
    every field, so for the items that need it, it is a fold over the fields.
    """
    places = len(TIME_FIELDS) + len(NESTED_TIME_FIELDS)
    candidates = [F.get(fields, F.lit(place)) for place in range(places)]
    chosen = F.coalesce(*[F.when(field["seconds"].isNotNull() | field["plain"], field) for field in candidates])
    common = F.coalesce(_epoch(chosen["seconds"]), _plain(chosen["text"]))
    odd = reduce(lambda left, right: left | right, [F.coalesce(~field["plain"], F.lit(False)) for field in candidates])
    fold = F.reduce(
        fields,
        F.lit(None).cast("timestamp"),
        lambda found, field: F.coalesce(found, _epoch(field["seconds"]), iso_timestamp(field["text"])),
    )
    # A common form can still name a day that does not exist; then the later fields count.
    return F.coalesce(F.when(odd | (chosen.isNotNull() & common.isNull()), fold).otherwise(common), as_of)


def coerce_ts(item: Column, as_of: Column) -> Column:
    """Publication time of a raw news item (VARIANT).

    Takes the first usable field; a number counts as epoch seconds when it is above zero, text
    when it is ISO. ``as_of`` stands in for "now", so that a re-run gives the same rows. JSON
    booleans are not numbers.

    On many rows, keep ``item_times`` in a column of its own and use ``first_time``, so that the
    item is taken apart once.
    """
    return first_time(item_times(item), as_of)


def epoch_or(value: Column, as_of: Column) -> Column:
    """Epoch seconds of a forum post (VARIANT); zero and negative numbers are times here."""
    number = F.when(F.schema_of_variant(value).rlike(_NUMBER), F.try_variant_get(value, "$", "double"))
    return F.coalesce(_epoch(number), as_of)


def utc_day(when: Column, data_type: T.DataType) -> Column:
    """UTC calendar day of an instant, whatever the session time zone; zone-less values keep their day."""
    if isinstance(data_type, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_seconds(when) / 86400).cast("int"))
    return when.cast("date")
