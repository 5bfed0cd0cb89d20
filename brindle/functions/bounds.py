"""Key ranges as predicates that reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """An end of a range: unbounded, or a key that belongs to it or doesn't."""

    key: Any = None
    included: bool = True
    bounded: bool = True


UNBOUNDED = Bound(bounded=False)


def included(key: Any) -> Bound:
    return Bound(key)


def excluded(key: Any) -> Bound:
    return Bound(key, included=False)


def _bound(x: Any, default_included: bool) -> Bound:
    return UNBOUNDED if x is None else x if isinstance(x, Bound) else Bound(x, default_included)


@dataclass(frozen=True)
class KeyRange:
    """``[start, end)`` for plain keys; ends may be :class:`Bound`; None is unbounded.

    A range whose ends are reversed is empty.
    """

    start: Any = None
    end: Any = None

    def ends(self) -> tuple[Bound, Bound]:
        return _bound(self.start, True), _bound(self.end, False)

    def predicate(self, k: Column) -> Column:
        lo, hi = self.ends()
        out = F.lit(True)
        if lo.bounded:
            out = (k >= F.lit(lo.key)) if lo.included else (k > F.lit(lo.key))
        if hi.bounded:
            upper = (k <= F.lit(hi.key)) if hi.included else (k < F.lit(hi.key))
            out = out & upper if lo.bounded else upper
        return out

    def may_meet(self, least: Any, greatest: Any) -> bool:
        """Whether a run with these extreme keys can hold a key of the range."""
        lo, hi = self.ends()
        if lo.bounded and (greatest < lo.key or greatest == lo.key and not lo.included):
            return False
        return not (hi.bounded and (least > hi.key or least == hi.key and not hi.included))


def closed(start: Any, end: Any) -> KeyRange:
    """``[start, end]``."""
    return KeyRange(included(start), included(end))
