"""Scalar functions over columns, all inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; ``empty`` (0 in evaluators, null in published tables) where b is 0."""
    share = F.try_divide(a.cast("double"), b.cast("double"))
    return share if empty is None else F.coalesce(share, F.lit(empty))


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def hash16(text: Column) -> Column:
    """First 16 hex digits of the text's SHA-256; null as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def plain_sql(sql: Column) -> Column:
    """SQL for comparing texts: no closing semicolons, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(sql), r"[;\s]+$", ""), r"\s+", " ")))


def sql_from_answer(text: Column) -> Column:
    """SQL in a model's answer: a fenced sql block, else any fenced block, else from SELECT or WITH to the first semicolon."""
    found = [F.regexp_extract(text, p, 1) for p in (r"(?is)```sql\s*(.*?)```", r"(?s)```\s*(.*?)```", r"(?is)\b((?:select|with)\b[^;]*)")]
    return F.regexp_replace(F.coalesce(*[F.when(F.trim(f) != "", f) for f in found], F.lit("")), r"^\s+|\s+$", "")


# Words that mark a predicate as temporal.
TEMPORAL_WORDS = ("date", "time", "year", "month", "day", "week", "quarter", "fiscal", "period", "posted", "posting", "created", "updated", "transaction_date", "invoice_date", "due_date", "payment_date")


def is_temporal(text: Column, strict: bool = False) -> Column:
    """Whether a predicate speaks of time: a word anywhere in it, or (strict) a whole word only."""
    words = "|".join(TEMPORAL_WORDS)
    return F.lower(text).rlike(rf"(?<![a-z0-9_])({words})(?![a-z0-9_])" if strict else f"({words})")


# Words and phrases of a question that ask for grouped output.
GROUPING = (
    "by", "per", "each", "compare", "breakdown", "trend", "monthly", "weekly", "daily", "quarterly", "yearly", "top", "biggest", "lowest", "highest",
    "which account", "which customer", "which vendor", "which product", "what account", "what customer", "what vendor", "what product",
)


def asks_for_groups(question: Column) -> Column:
    return F.lower(question).rlike(rf"\b({'|'.join(GROUPING)})\b".replace(" ", r"\s+"))


def grouping_words(question: str | None) -> list[str]:
    """The words and phrases of a question that ask for groups, in the order that they are listed in."""
    return [g for g in GROUPING if re.search(rf"\b{g}\b".replace(" ", r"\s+"), (question or "").lower())]


_TODAY = r"^\s*(date\s*\(\s*['\"]now['\"]\s*\)|current_date|date\s*\(\s*current_date\s*\)|['\"]now['\"])\s*$"
_DAY = r"\d{4}-\d{2}-\d{2}"
# The kinds of period that a date predicate describes. A predicate is of the first kind whose patterns its first value, its second value and its whole text have.
PERIODS = (
    ("BETWEEN", r"start of year", _TODAY, "", "year_to_date"),
    ("BETWEEN", r"start of month", _TODAY, "", "month_to_date"),
    ("BETWEEN", r"weekday", _TODAY, "", "week_to_date"),
    ("BETWEEN", r"-12 month", _TODAY, "", "trailing_12_months"),
    ("BETWEEN", r"-1 year", _TODAY, "", "trailing_1_year"),
    ("BETWEEN", r"(?=.*start of month).*-1 month", r"(?=.*start of month)(.*-1 (day|second|minute)|(?!.*-1 month))", "", "prior_calendar_month"),
    ("BETWEEN", r"weekday", r"weekday", "", "relative_week_range"),
    ("BETWEEN", "", "", r"(?=.*start of year).*month", "relative_month_range"),
    ("BETWEEN", "", "", r"start of year", "relative_year_range"),
    ("BETWEEN", "", "", r"start of month", "relative_month_range"),
    ("BETWEEN", "", "", _DAY, "absolute_date_range"),
    ("BETWEEN", "", "", "", "date_range"),
    (">", "", "", r"start of year", "year_to_date_lower_bound"),
    (">", "", "", r"start of month", "month_to_date_lower_bound"),
    (">", "", "", r"weekday", "week_to_date_lower_bound"),
    (">", "", "", r"-12 month", "trailing_12_months_lower_bound"),
    (">", "", "", r"-1 year", "trailing_1_year_lower_bound"),
    (">", "", "", _DAY, "absolute_date_lower_bound"),
    (">", "", "", "", "date_lower_bound"),
    ("<", "", "", _DAY, "absolute_date_upper_bound"),
    ("<", "", "", "", "date_upper_bound"),
    ("=", "", "", r"(?=.*strftime).*%y", "year_component_filter"),
    ("=", "", "", r"(?=.*strftime).*%m", "month_component_filter"),
    ("=", "", "", _DAY, "absolute_date_match"),
    ("=", "", "", "", "date_match"),
)
NO_PERIOD = "temporal_filter"


def period_of(operator: str | None, low, high, expression: str | None) -> str:
    """The kind of period that a date predicate describes."""
    operator = {">=": ">", "<=": "<"}.get(operator, operator)
    a, b = (str(x).lower() if x is not None else "" for x in (low, high))
    text = " ".join((a, b, (expression or "").lower())).replace("\n", " ")
    return next((kind for op, first, second, whole, kind in PERIODS if op == operator and re.search(first, a) and re.search(second, b) and re.search(whole, text)), NO_PERIOD)


def period_hint(operator: Column, low: Column, high: Column, expression: Column) -> Column:
    """``period_of`` as a column."""
    a, b, e = (F.lower(F.coalesce(x, F.lit(""))) for x in (low, high, expression))
    text = F.regexp_replace(F.concat_ws(" ", a, b, e), "\n", " ")
    plain = F.regexp_replace(operator, "^([<>])=$", "$1")
    out = None
    for op, first, second, whole, kind in PERIODS:
        test = plain == op
        for column, pattern in ((a, first), (b, second), (text, whole)):
            test = test & column.rlike(pattern) if pattern else test
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(NO_PERIOD)


def metric_rank(value: Column) -> Column:
    """A metric for comparison: null below 0 below 1."""
    return F.coalesce(value.cast("int"), F.lit(-1))


def worsened(before: list[Column], after: list[Column]) -> Column:
    """Whether any of several metrics ranks lower than before."""
    out = F.lit(False)
    for b, a in zip(before, after):
        out = out | (metric_rank(a) < metric_rank(b))
    return out


def percent(value: Column, digits: int = 2) -> Column:
    """A rate as per cent; null as n/a."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", value * 100), F.lit("n/a"))


def signed_points(value: Column, digits: int = 2) -> Column:
    """A difference of rates in points with its sign; null as n/a."""
    return F.coalesce(F.format_string(f"%+.{digits}f pp", value * 100), F.lit("n/a"))


def count_and_rate(count: Column, total: Column) -> Column:
    """A count with its share, as ``3/4 (75.0%)``; n/a without a total."""
    share = F.when(total != 0, F.format_string("%.1f%%", rate(count, total) * 100)).otherwise("n/a")
    return F.concat(count.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), share, F.lit(")"))
