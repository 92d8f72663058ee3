"""Calendar expressions on DATE columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Period step of each supported calendar.
STEPS = {"MS": "interval 1 month", "D": "interval 1 day", "W-SUN": "interval 7 days"}


def as_col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def step(freq: str) -> Column:
    if freq not in STEPS:
        raise ValueError(f"unknown frequency {freq!r}, use one of {sorted(STEPS)}")
    return F.expr(STEPS[freq])


def month_floor(ds: Column | str) -> Column:
    """First day of the month, as DATE (``date_trunc`` would give a zoned timestamp)."""
    return F.trunc(as_col(ds), "month")


def week_label(ds: Column | str) -> Column:
    """The Sunday that closes the week of a date; a Sunday is its own label."""
    return F.next_day(F.date_sub(as_col(ds), 1), "SUN")


def first_on_grid(ds: Column | str, freq: str) -> Column:
    """First calendar point on or after a date."""
    d = as_col(ds)
    if freq == "MS":
        return F.when(F.dayofmonth(d) == 1, d).otherwise(F.add_months(month_floor(d), 1))
    if freq == "W-SUN":
        return week_label(d)
    step(freq)
    return d


def month_number(ds: Column | str) -> Column:
    """Months since year 0, so that differences count months."""
    d = as_col(ds)
    return F.year(d) * 12 + F.month(d)


def _cyclic(angle: Column, period: int) -> Column:
    return angle * (2 * math.pi / period)


def season_exprs(ds: Column | str, cyclic: bool = True) -> dict[str, Column]:
    """Date parts and their sine/cosine form as named expressions of any date column."""
    d = as_col(ds)
    out = {"month": F.month(d), "quarter": F.quarter(d), "day_of_year": F.dayofyear(d)}
    if cyclic:
        out["month_sin"] = F.sin(_cyclic(F.month(d), 12))
        out["month_cos"] = F.cos(_cyclic(F.month(d), 12))
        out["quarter_sin"] = F.sin(_cyclic(F.quarter(d), 4))
        out["quarter_cos"] = F.cos(_cyclic(F.quarter(d), 4))
    return out


def dummy_exprs(ds: Column | str) -> dict[str, Column]:
    """Twelve 0/1 expressions.  The list is fixed, so the schema does not depend on the data."""
    month = F.month(as_col(ds))
    return {f"month_{m}": (month == m).cast("int") for m in range(1, 13)}


def season_form(seasonal: bool | str, ds: Column | str) -> dict[str, Column]:
    """The date features of a design: none, ``cyclical`` (also True) or ``categorical`` (month dummies)."""
    if not seasonal:
        return {}
    if seasonal in (True, "cyclical"):
        return season_exprs(ds)
    if seasonal == "categorical":
        return {**season_exprs(ds, cyclic=False), **dummy_exprs(ds)}
    raise ValueError("seasonal must be False, True, 'cyclical' or 'categorical'")


def date_features(ds: Column | str) -> dict[str, Column]:
    """Every date feature a design can have, by name: what a recursion computes for a step's date."""
    return {**season_exprs(ds), **dummy_exprs(ds)}


def date_parts(df: DataFrame, ds: str = "ds") -> DataFrame:
    return df.withColumns(season_exprs(ds, cyclic=False))


def cyclical(df: DataFrame, ds: str = "ds") -> DataFrame:
    parts = season_exprs(ds)
    return df.withColumns({name: parts[name] for name in parts if name.endswith(("sin", "cos"))})


def month_dummies(df: DataFrame, ds: str = "ds") -> DataFrame:
    return df.withColumns(dummy_exprs(ds))


def weekday_factor(ds: Column | str, saturday: float = 0.75, sunday: float = 0.60) -> Column:
    """Weekly level factor: ``weekday`` counts Monday as 0."""
    day = F.weekday(as_col(ds))
    return F.when(day == 5, F.lit(saturday)).when(day == 6, F.lit(sunday)).otherwise(F.lit(1.0))
