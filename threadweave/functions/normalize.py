"""Scalar column functions for posts: ids, flags, times, text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadweave import fixed_values as FV


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every white-space character, not only blanks."""
    return F.btrim(_col(c), F.lit(FV.WHITESPACE))


def normalize_id(c: Column | str) -> Column:
    """P1. Trimmed id; words that mean "missing" become null; ``123.0`` becomes ``123``.

    Ids stay text throughout: a double cannot hold an 18-digit id.
    """
    text = strip(c)
    return F.when(
        ~F.lower(text).isin(FV.ID_NULL_WORDS),
        F.regexp_replace(text, r"^(\p{Nd}+)\.0$", "$1"),
    )


def parse_response_ids(c: Column | str) -> Column:
    """P2. Comma list to an array of normalised ids; null gives an empty array."""
    parts = F.transform(F.split(normalize_id(c), ","), normalize_id)
    return F.coalesce(F.filter(parts, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def parse_inbound(c: Column | str) -> Column:
    """P4."""
    return F.coalesce(F.lower(_col(c).cast("string")).isin(FV.TRUE_WORDS), F.lit(False))


def parse_created_at(c: Column | str) -> Column:
    """P5. Anything that is not in the post format becomes null.

    The weekday word is cut off by position: Spark formats weekdays but does not parse them.
    """
    text = _col(c)
    weekday_then_rest = text.rlike(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ")
    return F.when(
        weekday_then_rest,
        F.try_to_timestamp(F.substring(text, 5, 1_000), F.lit(FV.CREATED_AT_FORMAT)),
    )


def has_text(c: Column | str) -> Column:
    """P6. False for null as well."""
    return F.coalesce(strip(c) != "", F.lit(False))


def is_customer(brand: str, inbound: Column | str = "inbound", author: Column | str = "author_id") -> Column:
    """P7."""
    return _col(inbound) & (_col(author) != brand)


def is_agent(brand: str, inbound: Column | str = "inbound", author: Column | str = "author_id") -> Column:
    """P7."""
    return ~_col(inbound) & (_col(author) == brand)


def thread_line(inbound: Column | str, author: Column | str, text: Column | str) -> Column:
    """P8. ``[customer | author] text``."""
    role = F.when(_col(inbound), "customer").otherwise("agent")
    return F.concat(F.lit("["), role, F.lit(" | "), _col(author), F.lit("] "), _col(text))


def proposed_intent(primary: Column | str, matched: Column | str) -> Column:
    """P9. Machine proposal naming the primary label and the other labels that matched."""
    others = F.array_remove(_col(matched), _col(primary))
    tail = F.when(
        F.size(others) > 0,
        F.concat(F.lit(" (also_matched: "), F.array_join(others, ","), F.lit(")")),
    ).otherwise("")
    return F.concat(F.lit(FV.CANDIDATE_PREFIX), _col(primary), tail)


def proposed_primary(c: Column | str) -> Column:
    """P9 inverse; a text that is no proposal counts as unclear."""
    found = F.regexp_extract(_col(c), r"^MACHINE_CANDIDATE:\s*([a-z0-9_]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(FV.UNCLEAR))


def intent_phrase(c: Column | str) -> Column:
    """P10."""
    return F.replace(
        F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("your issue")), F.lit("_"), F.lit(" ")
    )


def preview(c: Column | str, n: int = 240) -> Column:
    """P11. Text as shown in a report."""
    return F.substring(_col(c), 1, n)


def length_between(c: Column | str, low: int, high: int) -> Column:
    """P11."""
    return F.length(_col(c)).between(low, high)
