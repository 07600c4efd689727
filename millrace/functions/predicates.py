"""Conditions on rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_not_null(*columns: str) -> Column:
    return any_of([F.col(c).isNotNull() for c in columns])


def any_ilike(column: str, patterns: Sequence[str]) -> Column:
    """At least one pattern fits, whatever the case; a pattern without % is equality."""
    return any_of([F.col(column).ilike(p) for p in patterns])


def topic(column: str, patterns: Sequence[str], guarded: str | None = None, unless: Sequence[str] = (), case_sensitive: bool = False) -> Column:
    """One of ``patterns`` fits, or ``guarded`` does and none of ``unless``; only ``guarded`` may heed the case."""
    found = any_ilike(column, patterns)
    if guarded is None:
        return found
    own = F.col(column).like(guarded) if case_sensitive else F.col(column).ilike(guarded)
    return found | (own & ~any_ilike(column, unless))


def same_text(column: str, value: str) -> Column:
    """Equality without regard to case."""
    return F.lower(F.col(column)) == value.lower()


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is unknown."""
    return F.when(condition, 1).otherwise(0)


def in_list(column: str, values: Sequence[object]) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(False)


def equal_flag(a: str, b: str) -> Column:
    """1 where both columns have the same value; a missing value equals nothing."""
    return flag(F.col(a) == F.col(b))
