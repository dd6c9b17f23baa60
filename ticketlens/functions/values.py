"""Guards and parsers for ticket values: numbers, flags, durations, dates, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.text import as_column, blank_to_null, bound, clean_text, simple_casefold, strip

# Labels written by the ticket system.
MISSING_LABEL = "Не указано"
OTHER_CATEGORY = "Прочее"
OVERDUE_LABEL = "Просрочен"
NOT_OVERDUE_LABEL = "Не просрочен"
ALL_FILTER = "Все"

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_LARGEST = 1.7976931348623157e308

# One part of a duration; the sum is tested for finiteness after parsing.
_PART = r"\s*[+-]?(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?\s*"
_DURATION = rf"^-?{_PART}:{_PART}(?::{_PART})?$"
_INFINITE_PART = r"\s*[+-]?(?i:inf(?:inity)?)\s*"
_DURATION_OR_INFINITE = rf"^-?(?:{_PART}|{_INFINITE_PART}):(?:{_PART}|{_INFINITE_PART})(?::(?:{_PART}|{_INFINITE_PART}))?$"


def _finite(number: Column) -> Column:
    return F.when(number.between(-_LARGEST, _LARGEST), number)


def float_text(value: Column | str) -> Column:
    """Number written as text, under the rules of a decimal literal; null otherwise."""
    text = strip(value)
    return _finite(F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")))


def finite_number(value: Column | str, data_type: T.DataType) -> Column:
    """Finite double; booleans, text that is no number, NaN and infinities become null."""
    column = as_column(value)
    if isinstance(data_type, T.StringType):
        return float_text(column)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return _finite(column.cast("double"))
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    return F.lit(None).cast("double")


def binary_flag(value: Column | str, data_type: T.DataType) -> Column:
    number = finite_number(value, data_type)
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def label(value: Column | str, missing: str | None = MISSING_LABEL) -> Column:
    text = blank_to_null(value)
    return text if missing is None else F.coalesce(text, F.lit(missing))


def duration_hours(value: Column | str, allow_infinite: bool = False) -> Column:
    """``[-]H:MM[:SS]`` in hours. Parts may be fractional and are not limited to 0-59."""
    layout = _DURATION_OR_INFINITE if allow_infinite else _DURATION

    def total(parts: Column) -> Column:
        hours, minutes, seconds = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
        return hours + minutes / 60 + F.coalesce(seconds, F.lit(0.0)) / 3600

    def parse(text: Column) -> Column:
        sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
        parts = F.split(F.regexp_replace(text, r"^-|[_\s]", ""), ":")
        hours = F.when(text.rlike(layout), sign * bound(parts, total))
        return hours if allow_infinite else bound(hours, _finite)

    return bound(strip(value), parse)


def strict_duration_seconds(value: Column | str) -> Column:
    text = as_column(value)
    parts = F.split(text, ":")
    return F.when(
        text.rlike(r"^\d+:[0-5]\d:[0-5]\d$"),
        F.try_add(F.try_multiply(parts[0].try_cast("bigint"), F.lit(3600)), parts[1].try_cast("bigint") * 60 + parts[2].try_cast("bigint")),
    )


def strict_duration_invalid(value: Column | str) -> Column:
    """True for non-blank text that is no ``H:MM:SS``."""
    return blank_to_null(value).isNotNull() & strict_duration_seconds(value).isNull()


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_DAY_FIRST = r"^\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2})?)?$"

# The two date layouts of the table audit.
AUDIT_LONG = r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"
AUDIT_SHORT = r"^\d{1,2}\.\d{1,2}\.\d{2} \d{1,2}:\d{1,2}$"


def _without_offset(text: Column) -> Column:
    plain = F.regexp_replace(text, r"(:\d{2}(?:[.,]\d+)?)(?:Z|[+-]\d{2}:?\d{2})$", "$1")
    return F.replace(plain, F.lit(","), F.lit("."))


def iso_datetime(value: Column | str) -> Column:
    """Wall-clock time of an ISO text; an offset is dropped, never applied."""
    text = strip(value)
    return F.when(text.rlike(_ISO), _without_offset(text)).try_cast("timestamp_ntz")


def _calendar(text: Column, swap: bool) -> Column:
    """Day-month-year text in ISO order. Two-digit years from 69 belong to the last century."""
    full = F.regexp_replace(text, r"^(\d{1,2}[./-]\d{1,2}[./-])(69|[7-9]\d)(?!\d)", "$119$2")
    full = F.regexp_replace(full, r"^(\d{1,2}[./-]\d{1,2}[./-])(\d{2})(?!\d)", "$120$2")
    if swap:
        full = F.regexp_replace(full, r"^(0?[1-9]|1[0-2])[./-](1[3-9]|[2-9]\d)[./-]", "$2.$1.")
    return F.regexp_replace(full, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})", "$3-$2-$1")


def ticket_datetime(value: Column | str) -> Column:
    """ISO first, then day-first calendar text, else null."""
    def parse(text: Column) -> Column:
        return F.when(text.rlike(_ISO), _without_offset(text)).when(text.rlike(_DAY_FIRST), _calendar(text, swap=True))

    return bound(strip(value), parse).try_cast("timestamp_ntz")


def audit_datetime(value: Column | str, layout: str) -> Column:
    text = as_column(value)
    return F.when(text.rlike(layout), _calendar(text, swap=False)).try_cast("timestamp_ntz")


def clarification_count(value: Column | str) -> Column:
    number = float_text(F.replace(as_column(value).cast("string"), F.lit(","), F.lit(".")))
    return F.when(number % 1 == 0, number.try_cast("bigint"))


def clarification_count_batch(value: Column | str) -> Column:
    """Batch dialect: point decimals only."""
    number = float_text(as_column(value).cast("string"))
    return F.when(number % 1 == 0, number.try_cast("bigint"))


def overdue_flag(value: Column | str, yes: str = OVERDUE_LABEL, no: str = NOT_OVERDUE_LABEL) -> Column:
    return bound(simple_casefold(clean_text(value)),
                 lambda text: F.when(text == yes.casefold(), 1).when(text == no.casefold(), 0))


def overdue_flag_batch(value: Column | str, yes: str = OVERDUE_LABEL) -> Column:
    return F.coalesce((clean_text(value) == yes).cast("int"), F.lit(0))


def canonical(value: Column | str, data_type: T.DataType) -> Column:
    """Import form of one cell: empty text and NaN are null, dates are ISO text."""
    column = as_column(value)
    if isinstance(data_type, T.StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole, fraction = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(column, ".SSSSSS")
        return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction))
    return column
