"""Run parameters. Every date-dependent operator takes these; nothing reads the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """The "as of" date of a run and the day ranges around it (all inclusive)."""

    anchor: date
    horizon: int = 120
    calendar_back: int = 750
    calendar_ahead: int = 200

    @property
    def calendar_start(self) -> date:
        return self.anchor - timedelta(days=self.calendar_back)

    @property
    def calendar_end(self) -> date:
        return self.anchor + timedelta(days=self.calendar_ahead)

    @property
    def horizon_end(self) -> date:
        return self.anchor + timedelta(days=self.horizon)

    @property
    def grid_end(self) -> date:
        """Last projected day: the horizon, but never past the calendar."""
        return min(self.horizon_end, self.calendar_end)

    @property
    def today(self) -> Column:
        return F.lit(self.anchor)
