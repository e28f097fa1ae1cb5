"""Conjunctive conditions as Catalyst predicates.

NULL is an ordinary value here: equal to itself and below everything.  Each
comparator becomes a two-valued predicate that still pushes down to Parquet.
A list of conditions on a column is folded into bounds first, so that a
contradiction becomes a constant FALSE and the scan goes away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

# Condition codes.
EQUAL, NOT_EQUAL, LESSTHAN, GREATER, LTEQUAL, GTEQUAL = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
SIGNS = {"=": EQUAL, "!=": NOT_EQUAL, "<": LESSTHAN, ">": GREATER, "<=": LTEQUAL, ">=": GTEQUAL}

Clause = tuple[str | int, str | int, object]


class Wildcard:
    """A variable in a match record: any value will do."""

    def __repr__(self) -> str:
        return "ANY"


ANY = Wildcard()


def code(cond: str | int) -> int:
    found = SIGNS.get(cond, cond)
    if found not in SIGNS.values():
        raise ValueError(f"unknown condition {cond!r}")
    return found


def condition(column: Column, cond: str | int, value) -> Column:
    """``column cond value``, true or false but never NULL; None is the NULL value."""
    cond = code(cond)
    if isinstance(value, Column):
        return _of_columns(column, cond, value)
    lit = F.lit(value)
    if value is None:
        return {EQUAL: column.isNull(), NOT_EQUAL: column.isNotNull(), LESSTHAN: F.lit(False), GREATER: column.isNotNull(), LTEQUAL: column.isNull(), GTEQUAL: F.lit(True)}[cond]
    return {
        EQUAL: lambda: column.eqNullSafe(lit),
        NOT_EQUAL: lambda: ~column.eqNullSafe(lit),
        LESSTHAN: lambda: column.isNull() | (column < lit),
        GREATER: lambda: column.isNotNull() & (column > lit),
        LTEQUAL: lambda: column.isNull() | (column <= lit),
        GTEQUAL: lambda: column.isNotNull() & (column >= lit),
    }[cond]()


def _of_columns(a: Column, cond: int, b: Column) -> Column:
    """``a cond b`` for two columns, either of which may be NULL."""
    return {
        EQUAL: lambda: a.eqNullSafe(b),
        NOT_EQUAL: lambda: ~a.eqNullSafe(b),
        LESSTHAN: lambda: b.isNotNull() & (a.isNull() | (a < b)),
        GREATER: lambda: a.isNotNull() & (b.isNull() | (a > b)),
        LTEQUAL: lambda: a.isNull() | (b.isNotNull() & (a <= b)),
        GTEQUAL: lambda: b.isNull() | (a.isNotNull() & (a >= b)),
    }[cond]()


def mixed_condition(value: Column, cond: str | int, against) -> Column:
    """The same for a tagged value, across types."""
    other = values.of_python(against)
    return {EQUAL: value == other, NOT_EQUAL: value != other, LESSTHAN: value < other, GREATER: value > other, LTEQUAL: value <= other, GTEQUAL: value >= other}[code(cond)]


def field_condition(fields: Column, place: int, cond: str | int, against) -> Column:
    """A condition on a field of a ragged record; a record too short never matches."""
    return (F.size(fields) > place) & F.coalesce(mixed_condition(F.get(fields, F.lit(place)), cond, against), F.lit(False))


def contradiction(clauses: list[Clause]) -> bool:
    """Whether plain Python bounds on one column leave no value at all."""
    bounds: dict = {}
    for column, cond, value in clauses:
        if isinstance(value, Column):
            continue
        low, high = bounds.setdefault(column, [None, None])  # (value, inclusive); None is open
        cond, key = code(cond), (value is not None, value)  # NULL is the lowest
        if cond in (EQUAL, GREATER, GTEQUAL):
            new = (key, cond != GREATER)
            bounds[column][0] = new if low is None or _above(new, low) else low
        if cond in (EQUAL, LESSTHAN, LTEQUAL):
            new = (key, cond != LESSTHAN)
            bounds[column][1] = new if high is None or _below(new, high) else high
    for low, high in bounds.values():
        if high is not None and high == ((False, None), False):
            return True  # below NULL
        if low and high:
            try:
                if _less(high[0], low[0]) or low[0] == high[0] and not (low[1] and high[1]):
                    return True
            except TypeError:
                continue
    return False


def _less(a, b) -> bool:
    return a[0] < b[0] or a[0] and b[0] and a[1] < b[1]


def _above(new, old) -> bool:
    return _less(old[0], new[0]) or new[0] == old[0] and not new[1]


def _below(new, old) -> bool:
    return _less(new[0], old[0]) or new[0] == old[0] and not new[1]


def match_clauses(df: DataFrame, match) -> list[Clause]:
    """Equality clauses of a match record: by place, or by name from a dict.

    ANY fields and fields past its end match anything; None matches NULL.  A
    match record longer than the rows matches none of them.
    """
    if match is None:
        return []
    if isinstance(match, dict):
        return [(c, EQUAL, v) for c, v in match.items() if v is not ANY]
    return [(df.columns[k] if k < len(df.columns) else None, EQUAL, v) for k, v in enumerate(match) if v is not ANY]


def conjunction(df: DataFrame, clauses: list[Clause] = (), match=None) -> Column:
    """All clauses and the match record at once; TRUE if there is none."""
    every = [*match_clauses(df, match), *clauses]
    every = [(df.columns[c] if isinstance(c, int) and c < len(df.columns) else None if isinstance(c, int) else c, k, v) for c, k, v in every]
    if any(c is None for c, _, _ in every) or contradiction(every):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [condition(df[c], k, v) for c, k, v in every], F.lit(True))


def select(df: DataFrame, clauses: list[Clause] = (), match=None, limit: int | None = None, order_by=None) -> DataFrame:
    """The rows that meet every clause; ``limit`` 0 or None is no limit."""
    clauses = list(clauses)
    if clauses or match is not None:
        df = df.where(conjunction(df, clauses, match))
    if order_by is not None:
        df = df.orderBy(order_by)
    return df.limit(limit) if limit else df
