"""Expressions on text and on numbers typed as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns the input rules use.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
WORD_CHARACTERS = r"^[a-zA-Z0-9_]+$"
PHONE = r"^[\d\s\+\-\(\)]{7,20}$"
SPACE = r"\s"

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def contains(text: Column, word: str | Column) -> Column:
    """Case-insensitive substring match; `%` and `_` in the word stay wildcards."""
    if isinstance(word, str):
        return text.ilike(f"%{word}%")
    return F.lower(text).like(F.concat(F.lit("%"), F.lower(word), F.lit("%")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def zero_to_null(amount: Column) -> Column:
    return F.when(amount != 0, amount)


def number(text: Column) -> Column:
    """The number a text spells, else NULL."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def typed_amount(text: Column) -> Column:
    """An amount as people type it: spaces around it and thousands commas are dropped."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("decimal(10,2)")


def moment(text: Column) -> Column:
    """The time a text spells, else NULL."""
    return text.try_cast("timestamp_ntz")


def money(amount: Column) -> Column:
    """Two decimals, as notices print them."""
    return amount.cast("decimal(10,2)").cast("string")


def or_buyer(role: Column) -> Column:
    """The role of a new user who named none."""
    return F.coalesce(blank_to_null(role), F.lit("buyer"))
