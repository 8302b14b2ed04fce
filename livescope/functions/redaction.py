"""Masks and refusals for text that traces may carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first @ is not at the start, and a dot comes later.
EMAIL = r"(?s)^[^@]+@.*\."
LONG_DIGITS = r"[0-9]{12,}"
PHONE = r"(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)"
CARD = r"(^|[^A-Za-z0-9])[A-Z]{5}[0-9]{4}[A-Z]([^A-Za-z0-9]|$)"


def mask_path(path: Column) -> Column:
    """The path without its query; segments that identify something are masked."""
    parts = F.split(F.substring_index(path, "?", 1), "/")

    def masked(s: Column) -> Column:
        return (
            F.when(s.rlike("^[0-9]+$"), "#")
            .when(s.rlike("^[0-9a-fA-F-]{16,}$"), "{id}")
            .otherwise(F.regexp_replace(s, "[0-9]+", "#"))
        )

    return F.array_join(F.transform(parts, masked), "/")


def denied_text(text: Column) -> Column:
    return text.rlike(EMAIL) | text.rlike(LONG_DIGITS) | text.rlike(PHONE) | text.rlike(CARD)


def denied_number(number: Column) -> Column:
    digits = F.abs(number).cast("string")
    return (F.length(digits) >= 12) | ((F.length(digits) == 10) & F.substring(digits, 1, 1).isin("6", "7", "8", "9"))
