"""What the planning tests share: the small tables, the anchor day, and rows as dictionaries."""

from datetime import date, timedelta

SMALL = "/root/testdata/sf0.001"
ANCHOR = date(2000, 1, 3)


def day(offset: int) -> date:
    """A date by its distance from the anchor."""
    return ANCHOR + timedelta(days=offset)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]
