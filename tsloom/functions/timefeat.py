"""Calendar features of a timestamp, each scaled to [-0.5, 0.5]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> column; days of the week count from Monday.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "second_of_minute": lambda ts: F.second(ts) / 59.0 - 0.5,
    "minute_of_hour": lambda ts: F.minute(ts) / 59.0 - 0.5,
    "hour_of_day": lambda ts: F.hour(ts) / 23.0 - 0.5,
    "day_of_week": lambda ts: F.weekday(ts) / 6.0 - 0.5,
    "day_of_month": lambda ts: (F.dayofmonth(ts) - 1) / 30.0 - 0.5,
    "day_of_year": lambda ts: (F.dayofyear(ts) - 1) / 365.0 - 0.5,
    "month_of_year": lambda ts: (F.month(ts) - 1) / 11.0 - 0.5,
    "week_of_year": lambda ts: (F.weekofyear(ts) - 1) / 52.0 - 0.5,
}
#: Coarser units drop the features of finer ones.
_DAILY = ["day_of_week", "day_of_month", "day_of_year"]
BY_UNIT = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": _DAILY,
    "B": _DAILY,
    "H": ["hour_of_day", *_DAILY],
    "T": ["minute_of_hour", "hour_of_day", *_DAILY],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", *_DAILY],
}
_ALIASES = {"A": "Y", "MIN": "T", "ME": "M", "QE": "Q", "YE": "Y"}


def features_of(freq: str, ts: Column) -> dict[str, Column]:
    """The features of a frequency such as "h", "15min" or "W-SUN"."""
    unit = freq.upper().split("-")[0].lstrip("0123456789")
    unit = _ALIASES.get(unit, unit)
    if unit not in BY_UNIT:
        raise ValueError(f"unknown frequency {freq!r}; known units: {', '.join(BY_UNIT)}")
    return {name: FEATURES[name](ts) for name in BY_UNIT[unit]}


def calendar_parts(ts: Column, quarter_hours: bool = False) -> dict[str, Column]:
    """Plain month, day, weekday and hour; with quarter_hours also the quarter of the hour."""
    parts = {"month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "hour": F.hour(ts)}
    return parts | ({"quarter": F.floor(F.minute(ts) / 15).cast("int")} if quarter_hours else {})
