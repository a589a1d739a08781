"""Predicates over label arrays: built once, compiled to a Column for plans and evaluated in Python for single rows.

Every leaf is false where the row has no such field. An empty `and_` is true, an empty `or_` and an empty set are false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    """text describes it; column maps an array column to a boolean one; matches evaluates a list."""

    text: str
    column: Callable[[Column], Column]
    matches: Callable[[Sequence[int]], bool]

    @property
    def always(self) -> bool:
        return self.text == "true"

    @staticmethod
    def _leaf(text: str, field: int, column: Callable[[Column], Column], test: Callable[[int], bool]) -> "Predicate":
        if field < 0:
            raise ValueError("a label field is a position from 0")
        return Predicate(text, lambda v: F.coalesce(column(F.get(v, F.lit(field))), F.lit(False)), lambda row: row is not None and field < len(row) and row[field] is not None and test(row[field]))

    @staticmethod
    def none() -> "Predicate":
        return Predicate("true", lambda v: F.lit(True), lambda row: True)

    @staticmethod
    def eq(field: int, value: int) -> "Predicate":
        return Predicate._leaf(f"[{field}] = {value}", field, lambda c: c == value, lambda x: x == value)

    @staticmethod
    def in_(field: int, values: Sequence[int]) -> "Predicate":
        known = frozenset(values)
        return Predicate._leaf(f"[{field}] in {sorted(known)}", field, lambda c: c.isin(sorted(known)) if known else F.lit(False), lambda x: x in known)

    @staticmethod
    def lt(field: int, value: int) -> "Predicate":
        return Predicate._leaf(f"[{field}] < {value}", field, lambda c: c < value, lambda x: x < value)

    @staticmethod
    def gt(field: int, value: int) -> "Predicate":
        return Predicate._leaf(f"[{field}] > {value}", field, lambda c: c > value, lambda x: x > value)

    @staticmethod
    def range(field: int, least: int, most: int) -> "Predicate":
        return Predicate._leaf(f"{least} <= [{field}] <= {most}", field, lambda c: c.between(least, most), lambda x: least <= x <= most)

    @staticmethod
    def and_(parts: Sequence["Predicate"]) -> "Predicate":
        text = " and ".join(f"({p.text})" for p in parts) or "true"
        return Predicate(text, lambda v: reduce(lambda a, b: a & b, (p.column(v) for p in parts), F.lit(True)), lambda row: all(p.matches(row) for p in parts))

    @staticmethod
    def or_(parts: Sequence["Predicate"]) -> "Predicate":
        text = " or ".join(f"({p.text})" for p in parts) or "false"
        return Predicate(text, lambda v: reduce(lambda a, b: a | b, (p.column(v) for p in parts), F.lit(False)), lambda row: any(p.matches(row) for p in parts))
