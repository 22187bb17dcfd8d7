"""Text helpers shared by the operators; all are Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(value: Column) -> Column:
    """An id or name as it is compared: trimmed and lower-cased; blank becomes null."""
    key = F.lower(F.trim(value))
    return F.when(key != "", key)


def words(text: Column) -> Column:
    """Longest runs of letters or digits of any script in the lower-cased text; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def record_text(title: Column, content: Column) -> Column:
    """Title, a blank, content; nulls count as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
