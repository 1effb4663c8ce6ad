"""Series frequencies as column expressions: time shifts, calendar offsets and seasonal buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("minute", "hour", "day", "bday")


@dataclass(frozen=True)
class Freq:
    """``n`` minutes, hours, days, or business days between rows of a series."""

    unit: str
    n: int = 1

    def __post_init__(self) -> None:
        if self.unit not in UNITS or self.n < 1:
            raise ValueError(f"a frequency is a positive number of one of {UNITS}")

    def shift(self, ts: Column, steps: Column | int) -> Column:
        """``ts`` plus ``steps`` steps (a column or a number, not negative for business days)."""
        steps = (steps if isinstance(steps, Column) else F.lit(steps)) * self.n
        if self.unit == "bday":
            return business_shift(ts, steps)
        zero = F.lit(0)
        parts = {"day": (steps, zero, zero), "hour": (zero, steps, zero), "minute": (zero, zero, steps)}[self.unit]
        return ts + F.make_dt_interval(*parts, F.lit(0).cast("decimal(18,6)"))

    def seconds(self) -> int:
        """The length of a step; business days have none."""
        return {"minute": 60, "hour": 3600, "day": 86400}[self.unit] * self.n

    def steps_from(self, first: Column, ts: Column) -> Column:
        """Whole steps from ``first`` to ``ts``, without a time zone; not for business days."""
        clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
        return F.floor((F.datediff(ts, first).cast("long") * 86400 + clock(ts) - clock(first)) / self.seconds()).cast("long")

    def interval(self) -> str:
        """The step as an interval literal, for sequence()."""
        return f"interval {self.n} {'day' if self.unit == 'bday' else self.unit}"

    def bucket(self, ts: Column) -> Column:
        """The season of a time: weekday for daily series, weekday and hour for hourly, and the slot of the hour below."""
        if self.unit in ("day", "bday"):
            return F.weekday(ts).cast("string")
        parts = [F.weekday(ts), F.hour(ts)] + ([(F.minute(ts) / self.n).cast("int")] if self.unit == "minute" else [])
        return F.concat_ws("_", *(p.cast("string") for p in parts))


def business_shift(ts: Column, steps: Column) -> Column:
    """``ts`` plus business days; a weekend day counts as the Friday before it."""
    day = F.weekday(ts)
    back = F.greatest(F.lit(0), day - 4)
    total = steps + 2 * F.floor((F.least(day, F.lit(4)) + steps) / 5) - back
    return ts + F.make_dt_interval(total.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))


def calendar_shift(ts: Column, years: int = 0, months: int = 0) -> Column:
    """``ts`` plus calendar years and months; a day that the month lacks becomes its last."""
    return ts + F.make_ym_interval(F.lit(years), F.lit(months))
