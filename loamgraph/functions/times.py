"""Times given as text. Everything is counted in microseconds since 1970 (UTC), so no session time zone enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USABLE = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?\z"
OFFSET = r"(Z|[+-]\d{2}:\d{2})\z"
DAY_US = 86_400_000_000


def utc_micros(text: Column) -> Column:
    """BIGINT microseconds of a usable time text, else null.

    Usable: a full, valid date and time to the second or finer, `T` or a blank between, with an offset or without (then
    UTC). Null, empty, padded, date-only and impossible texts give null.
    """
    zoned = F.when(text.rlike(OFFSET), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(USABLE), F.unix_micros(zoned.try_cast("timestamp")))


def utc_day(micros: Column) -> Column:
    """`YYYY-MM-DD` of a count of microseconds; null for null."""
    days = F.floor(micros / F.lit(DAY_US)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def utc_text(micros: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS.ffffff` of a count of microseconds; null for null."""
    second = F.pmod(F.floor(micros / F.lit(1_000_000)), F.lit(86_400))
    return F.concat(
        utc_day(micros),
        F.format_string(
            " %02d:%02d:%02d.%06d",
            F.floor(second / 3600),
            F.floor(F.pmod(second, F.lit(3600)) / 60),
            F.pmod(second, F.lit(60)),
            F.pmod(micros, F.lit(1_000_000)),
        ),
    )
