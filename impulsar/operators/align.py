"""Exact calendar leads and lags: one window over each unit, by RANGE frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit_window(unit: str, time: str = "__t"):
    return W.partitionBy(unit).orderBy(time)


def lead(value: Column, steps: int, window, span: int) -> Column:
    """The value exactly ``steps`` periods later (earlier if negative); null in a gap."""
    if steps == 0:
        return value
    return F.max(value).over(window.rangeBetween(steps, steps)) if abs(steps) <= span else F.lit(None).cast("double")


def cumulative(value: Column, steps: int, window, span: int) -> Column:
    """Sum from the anchor through ``steps`` periods on, null unless every step is there."""
    if steps > span:
        return F.lit(None).cast("double")
    frame = window.rangeBetween(0, steps)
    return F.when(F.count(value).over(frame) == steps + 1, F.sum(value).over(frame))


def outcomes(value: Column, horizons: int, window, span: int, response: str) -> list[Column]:
    step = cumulative if response == "cumulative" else lead
    return [step(value, h, window, span) for h in range(horizons + 1)]


def row_marks(window, time: str = "__t") -> dict[str, Column]:
    """First row of its unit; a repeated key; a step of more than one period before it."""
    before = F.lag(time).over(window)
    return {"__first": before.isNull(), "__again": F.coalesce(before == F.col(time), F.lit(False)), "__gap": F.coalesce(F.col(time) - before > 1, F.lit(False))}


def with_masks(df: DataFrame, ys: list[str], valid: Column, sample: str) -> DataFrame:
    """``__m{h}``: whether a row is an anchor at horizon h."""
    each = [valid & F.col(y).isNotNull() for y in ys]
    if sample == "common":
        every = valid
        for y in ys:
            every = every & F.col(y).isNotNull()
        each = [every] * len(ys)
    return df.withColumns({f"__m{h}": m for h, m in enumerate(each)})
