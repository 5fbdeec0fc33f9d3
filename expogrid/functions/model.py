"""Plain descriptions the operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Group:
    code: str
    label: str
    item: object = None

    @property
    def prefix(self) -> str:
        return self.code.lower()


@dataclass(frozen=True)
class GroupScheme:
    """Groups of a population, the first one focal.

    A unit table holds, per group, one count column per measure (``a0_students`` ...)
    and a share column (``a0_share``). The share's denominator is the sum over the
    baseline groups, not over all of them. ``measures`` is (everyone, first sex, second
    sex); ``weights`` names the measure behind each weight kind.
    """

    groups: tuple[Group, ...]
    measures: tuple[str, ...] = ("students", "boys", "girls")

    @property
    def focal(self) -> Group:
        return self.groups[0]

    @property
    def baselines(self) -> tuple[Group, ...]:
        return self.groups[1:]

    @property
    def main(self) -> str:
        return self.measures[0]

    def only(self, *codes: str) -> GroupScheme:
        return GroupScheme(tuple(g for g in self.groups if g.code in codes), self.measures)

    def column(self, group: Group, measure: str | None = None) -> str:
        return f"{group.prefix}_{measure or self.main}"

    def share(self, group: Group) -> str:
        return f"{group.prefix}_share"

    def total(self, measure: str | None = None) -> str:
        return f"total_{measure or self.main}"


@dataclass(frozen=True)
class Measure:
    """How a condition is read: which way is worse, and how stored values are shown and named, as the registry states it."""

    kind: str
    direction: str
    scale: float
    unit: str
    model_unit: str


EXPOSED = Measure("binary_adverse", "higher_worse", 100.0, "percent exposed", "percentage points")


def worse(scale: float, unit: str, model_unit: str) -> Measure:
    return Measure("continuous_adverse", "higher_worse", scale, unit, model_unit)


def better(scale: float, unit: str, model_unit: str) -> Measure:
    return Measure("continuous_beneficial", "higher_better", scale, unit, model_unit)


@dataclass(frozen=True)
class About:
    """Where an indicator applies, where it comes from and how to read it."""

    applies: str = "all schools with reported enrolment"
    sources: tuple[str, ...] = ()
    meaning: str = ""
    limits: str = ""


@dataclass(frozen=True)
class Indicator:
    """A condition of units in the column ``code``; ``weight`` names the people counted by it."""

    code: str
    label: str
    measure: Measure
    domain: str = ""
    level: str = "secondary"
    weight: str = "students"
    about: About = About()

    @property
    def kind(self) -> str:
        return self.measure.kind

    @property
    def direction(self) -> str:
        return self.measure.direction

    @property
    def multiplier(self) -> float:
        return self.measure.scale

    @property
    def unit(self) -> str:
        return self.measure.unit


def check_registry(indicators: tuple[Indicator, ...]) -> None:
    codes = [i.code for i in indicators]
    repeated = sorted({c for c in codes if codes.count(c) > 1})
    if repeated:
        raise ValueError(f"repeated indicator codes: {repeated}")
    unknown = [i.code for i in indicators if not isinstance(i.measure, Measure)]
    if unknown:
        raise ValueError(f"indicators without a known measure: {unknown}")


@dataclass(frozen=True)
class Bundle:
    """Binary conditions that must all be observed, and all be 1, in the same unit."""

    code: str
    label: str
    members: tuple[str, ...]
    weight: str = "students"
    kind: str = ""
    domains: str = ""
    mechanism: str = ""
