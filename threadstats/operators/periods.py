"""Assigning calendar periods to entries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cut points of each division; a period includes its first
# day and excludes the next cut.  Dates outside all periods have none.
PERIOD_CUTS = {
    3: ["2016-05-03", "2016-06-20", "2016-06-25", "2016-06-30"],
    7: [
        "2015-11-16", "2016-06-24", "2017-03-30", "2018-07-07", "2018-11-26",
        "2019-03-21", "2019-03-30", "2019-04-06",
    ],
    15: [
        "2015-11-16", "2016-06-25", "2016-07-14", "2016-12-08", "2017-01-27",
        "2017-03-30", "2017-06-20", "2018-07-09", "2018-09-22", "2018-11-16",
        "2018-11-26", "2019-01-16", "2019-03-15", "2019-03-22", "2019-03-30",
        "2019-04-06",
    ],
    16: [
        "2015-11-16", "2016-06-25", "2016-07-14", "2016-07-28", "2016-12-08",
        "2017-01-27", "2017-03-30", "2017-06-20", "2018-07-09", "2018-09-22",
        "2018-11-16", "2018-11-26", "2019-01-16", "2019-03-15", "2019-03-22",
        "2019-03-30", "2019-04-06",
    ],
}
# Fixed value: the three-period division is labelled T4 to T6.
FIRST_LABEL = {3: 4}
DEFAULT_PERIODS = 15


def period_of(day: Column, cuts: Sequence[str | date]) -> Column:
    """Number of the period a date falls in, from 1; NULL outside all of them."""
    bounds = [F.lit(str(c)).cast("date") for c in cuts]
    result = F.when(day < bounds[0], F.lit(None).cast("int"))
    for number, end in enumerate(bounds[1:], start=1):
        result = result.when(day < end, F.lit(number))
    return result


def period_label(period: Column, n: int) -> Column:
    return F.concat(F.lit("T"), (period + FIRST_LABEL.get(n, 1) - 1).cast("string"))


def assign_period(
    entries: DataFrame, cuts: Sequence[str | date] | int = DEFAULT_PERIODS, day: str = "date"
) -> DataFrame:
    """Add ``period`` and drop the entries outside all periods."""
    if isinstance(cuts, int):
        cuts = PERIOD_CUTS[cuts]
    # The bounds repeat as a plain filter, which file scans can push down.
    inside = (F.col(day) >= F.lit(str(cuts[0])).cast("date")) & (
        F.col(day) < F.lit(str(cuts[-1])).cast("date")
    )
    return entries.filter(inside).withColumn("period", period_of(F.col(day), cuts))


def assign_equal_periods(entries: DataFrame, n: int, day: str = "date") -> DataFrame:
    """Cut the span of all dates into n periods of equal width.

    Inner bounds divide the span evenly; the last date belongs to the last
    period.  If all dates are equal they fall in the middle period.
    """
    span = entries.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    low = span.select("lo").scalar()
    days = span.select(F.datediff("hi", "lo").alias("days")).scalar()
    since = F.datediff(F.col(day), low).cast("bigint")
    inner = F.floor(since * n / F.nullif(days, F.lit(0))).cast("int")
    middle = F.lit(n // 2)
    return entries.withColumn(
        "period", F.when(days == 0, middle).otherwise(F.least(inner, F.lit(n - 1))) + 1
    )
