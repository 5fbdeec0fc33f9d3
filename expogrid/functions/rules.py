"""Declarative rules for indicator columns. A rule knows the columns it reads and builds one Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import all_of, any_of, coded, holds, mean_of_observed, ratio, total_of

COMPARE = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, ">": lambda c, v: c > v,
}


@dataclass(frozen=True)
class Answer:
    """A coded answer: 1 for the adverse codes, 0 for the favourable ones, else unknown."""

    column: str
    adverse: tuple[int, ...] = (2,)
    favourable: tuple[int, ...] = (1,)

    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def build(self) -> Column:
        return coded(self.column, self.adverse, self.favourable)


@dataclass(frozen=True)
class Test:
    """1 where the comparison holds, else 0; a missing value does not hold."""

    column: str
    operator: str
    limit: int

    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def build(self) -> Column:
        return holds(COMPARE[self.operator](F.col(self.column), self.limit))


@dataclass(frozen=True)
class Absent:
    """1 where the counts add to zero with missing read as zero, else 0."""

    parts: tuple[str, ...]

    def columns(self) -> tuple[str, ...]:
        return self.parts

    def build(self) -> Column:
        return holds(total_of(self.parts) == 0)


@dataclass(frozen=True)
class AbsentAmong:
    """As ``Absent``, but known only where the whole is positive."""

    part: str
    whole: str

    def columns(self) -> tuple[str, ...]:
        return (self.whole, self.part)

    def build(self) -> Column:
        return F.when(F.col(self.whole) > 0, holds(total_of([self.part]) == 0))


@dataclass(frozen=True)
class ZeroCount:
    """1 for a recorded zero, 0 for a positive count, else unknown."""

    column: str

    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def build(self) -> Column:
        c = F.col(self.column)
        return F.when(c == 0, 1).when(c > 0, 0)


@dataclass(frozen=True)
class Per:
    """Numerator times scale over denominator. Several numerator columns are added with missing as zero."""

    above: tuple[str, ...]
    below: str
    scale: float = 1.0

    def columns(self) -> tuple[str, ...]:
        return (*self.above, self.below)

    def build(self) -> Column:
        top = F.col(self.above[0]) if len(self.above) == 1 else total_of(self.above)
        return ratio(top, self.below, self.scale)


@dataclass(frozen=True)
class Crowded:
    """1 where there is staff and people per staff member exceed the limit, else 0."""

    people: str
    staff: str
    limit: int

    def columns(self) -> tuple[str, ...]:
        return (self.people, self.staff)

    def build(self) -> Column:
        return holds((F.col(self.staff) > 0) & (ratio(self.people, self.staff) > self.limit))


@dataclass(frozen=True)
class Value:
    """A recorded number as double."""

    column: str

    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def build(self) -> Column:
        return F.col(self.column).cast("double")


@dataclass(frozen=True)
class Total:
    """A sum of counts with missing as zero."""

    parts: tuple[str, ...]

    def columns(self) -> tuple[str, ...]:
        return self.parts

    def build(self) -> Column:
        return total_of(self.parts)


@dataclass(frozen=True)
class NoneWorks:
    """1 where no listed source answers yes (1); with ``present``, only if one of those exists."""

    works: tuple[str, ...]
    present: tuple[str, ...] = ()

    def columns(self) -> tuple[str, ...]:
        return (*self.present, *self.works)

    def build(self) -> Column:
        none = all_of([F.coalesce(F.col(c), F.lit(2)) != 1 for c in self.works])
        return holds(none & any_of([F.col(c) == 1 for c in self.present]) if self.present else none)


@dataclass(frozen=True)
class BothLack:
    """1 where both answers are no, 0 where one is yes, else unknown."""

    first: str
    second: str

    def columns(self) -> tuple[str, ...]:
        return (self.first, self.second)

    def build(self) -> Column:
        a, b = F.col(self.first), F.col(self.second)
        return F.when((a == 2) & (b == 2), 1).when((a == 1) | (b == 1), 0)


@dataclass(frozen=True)
class HasWithout:
    """Among units with the first thing: 1 where the second is missing, 0 where it is there."""

    has: str
    lacks: str

    def columns(self) -> tuple[str, ...]:
        return (self.has, self.lacks)

    def build(self) -> Column:
        return F.when(F.col(self.has) == 1, coded(self.lacks, (2,), (1,)))


@dataclass(frozen=True)
class Unspent:
    """1 where money came in and none is recorded as spent, else 0."""

    received: str
    spent: str

    def columns(self) -> tuple[str, ...]:
        return (self.received, self.spent)

    def build(self) -> Column:
        return holds((F.col(self.received) > 0) & (total_of([self.spent]) == 0))


@dataclass(frozen=True)
class Where:
    """A rule that applies only where all bounds (column, operator, limit) hold."""

    bounds: tuple[tuple[str, str, int], ...]
    rule: object

    def columns(self) -> tuple[str, ...]:
        return (*[b[0] for b in self.bounds], *self.rule.columns())

    def build(self) -> Column:
        tests = [c <= v if op == "<=" else c >= v if op == ">=" else c > v for n, op, v in self.bounds for c in [F.col(n)]]
        return F.when(all_of(tests), self.rule.build())


@dataclass(frozen=True)
class Mean:
    """Null-skipping row mean of other indicators."""

    parts: tuple[str, ...]
    scale: float = 1.0

    def columns(self) -> tuple[str, ...]:
        return self.parts

    def build(self) -> Column:
        return mean_of_observed(self.parts, self.scale)


@dataclass(frozen=True)
class Product:
    """Interaction of two indices on the 0-100 scale."""

    first: str
    second: str

    def columns(self) -> tuple[str, ...]:
        return (self.first, self.second)

    def build(self) -> Column:
        return F.col(self.first) * F.col(self.second) / F.lit(100.0)
