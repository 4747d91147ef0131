"""Calendar features and the public-holiday dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.text import col

# Weekday and month names, column order of a calendar row.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
CALENDAR_COLUMNS = (
    "day_of_week",
    "season",
    "month",
    "month_sin",
    "month_cos",
    "is_weekend",
    "is_public_holiday",
    "days_to_next_course_start",
)


def season(date: str | Column) -> Column:
    """Meteorological season of the northern hemisphere."""
    m = F.month(col(date))
    return (
        F.when(m.isin(12, 1, 2), F.lit("Winter"))
        .when(m.between(3, 5), F.lit("Spring"))
        .when(m.between(6, 8), F.lit("Summer"))
        .when(m.between(9, 11), F.lit("Fall"))
    )


def month_cycle(date: str | Column) -> tuple[Column, Column]:
    angle = (F.month(col(date)) - 1) * F.lit(2.0 * math.pi / 12.0)
    return F.sin(angle), F.cos(angle)


def with_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Day name, weekend flag, season, short month name and the month harmonics."""
    sin, cos = month_cycle(date)
    return df.withColumns(
        {
            "day_of_week": F.date_format(col(date), "EEEE"),
            "is_weekend": (F.weekday(col(date)) >= 5).cast("int"),
            "season": season(date),
            "month": F.date_format(col(date), "MMM"),
            "month_sin": sin,
            "month_cos": cos,
        }
    )


def country_of_region(region: str | Column) -> Column:
    """CA for Canadian region labels, US for all others."""
    name = F.upper(F.coalesce(col(region), F.lit("")))
    return F.when(name.contains("CAN") | (name == "CA"), F.lit("CA")).otherwise(F.lit("US"))


def days_to_next(date: str | Column, starts: Sequence[str]) -> Column:
    """Days until the next start date, NULL after the last; ``starts`` is a short setting."""
    if not starts:
        return F.lit(None).cast("double")
    gaps = F.transform(
        F.array(*[F.to_date(F.lit(s)) for s in sorted(starts)]),
        lambda s: F.datediff(s, col(date)),
    )
    return F.array_min(F.filter(gaps, lambda g: g >= 0)).cast("double")


def holiday_dates(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(country, date, name) of US federal and Canadian national public holidays.

    Fixed-day and nth-weekday rules are evaluated per year, with the weekend-observed days of the
    fixed US holidays; Good Friday follows the Gregorian computus. A few dozen rows per year.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))

    def fixed(month: int, day: int) -> Column:
        return F.make_date("y", F.lit(month), F.lit(day))

    def nth(month: int, weekday: int, n: int) -> Column:
        """n-th given weekday (0 = Monday) of the month."""
        first = F.make_date("y", F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))

    def last(month: int, weekday: int) -> Column:
        end = F.last_day(F.make_date("y", F.lit(month), F.lit(1)))
        return F.date_sub(end, F.pmod(F.weekday(end) - F.lit(weekday), F.lit(7)))

    def before(month: int, day: int, weekday: int) -> Column:
        """Latest given weekday strictly before the day."""
        top = F.date_sub(F.make_date("y", F.lit(month), F.lit(day)), 1)
        return F.date_sub(top, F.pmod(F.weekday(top) - F.lit(weekday), F.lit(7)))

    def good_friday() -> Column:
        y = F.col("y")
        a, b, c = y % 19, F.floor(y / 100), y % 100
        d, e = F.floor(b / 4), b % 4
        g = F.floor((b - F.floor((b + 8) / 25) + 1) / 3)
        h = (19 * a + b - d - g + 15) % 30
        i, k = F.floor(c / 4), c % 4
        l = (32 + 2 * e + 2 * i - h - k) % 7
        m = F.floor((a + 11 * h + 22 * l) / 451)
        span = h + l - 7 * m + 114
        easter = F.make_date("y", F.floor(span / 31).cast("int"), (span % 31 + 1).cast("int"))
        return F.date_sub(easter, 2)

    # (country, name, date, first year, observed on the nearest weekday)
    rules = [
        ("US", "New Year's Day", fixed(1, 1), 0, True),
        ("US", "Martin Luther King Jr. Day", nth(1, 0, 3), 1986, False),
        ("US", "Washington's Birthday", nth(2, 0, 3), 0, False),
        ("US", "Memorial Day", last(5, 0), 0, False),
        ("US", "Juneteenth National Independence Day", fixed(6, 19), 2021, True),
        ("US", "Independence Day", fixed(7, 4), 0, True),
        ("US", "Labor Day", nth(9, 0, 1), 0, False),
        ("US", "Columbus Day", nth(10, 0, 2), 0, False),
        ("US", "Veterans Day", fixed(11, 11), 0, True),
        ("US", "Thanksgiving Day", nth(11, 3, 4), 0, False),
        ("US", "Christmas Day", fixed(12, 25), 0, True),
        ("CA", "New Year's Day", fixed(1, 1), 0, False),
        ("CA", "Good Friday", good_friday(), 0, False),
        ("CA", "Victoria Day", before(5, 25, 0), 0, False),
        ("CA", "Canada Day", fixed(7, 1), 0, False),
        ("CA", "Labor Day", nth(9, 0, 1), 0, False),
        ("CA", "Thanksgiving Day", nth(10, 0, 2), 0, False),
        ("CA", "Christmas Day", fixed(12, 25), 0, False),
    ]
    entries = []
    for country, name, date, since, shifted in rules:
        valid = F.when(F.col("y") >= since, date)
        entries.append(F.struct(F.lit(country).alias("country"), valid.alias("date"), F.lit(name).alias("name")))
        if shifted:
            moved = (
                F.when(F.weekday(valid) == 5, F.date_sub(valid, 1))
                .when(F.weekday(valid) == 6, F.date_add(valid, 1))
            )
            entries.append(
                F.struct(
                    F.lit(country).alias("country"),
                    moved.alias("date"),
                    F.lit(name + " (observed)").alias("name"),
                )
            )
    return (
        years.select(F.explode(F.array(*entries)).alias("h"))
        .select("h.country", "h.date", "h.name")
        .filter(F.col("date").isNotNull())
    )


def with_holiday_flag(
    df: DataFrame, first_year: int, last_year: int, date: str = "date", region: str = "region"
) -> DataFrame:
    """1 on a public holiday of the region's country; the dimension is sent out or not by Spark's own size test."""
    days = holiday_dates(df.sparkSession, first_year, last_year).select("country", "date").distinct()
    days = days.select(
        F.col("country").alias("_country"), F.col("date").alias("_holiday"), F.lit(1).alias("_is_holiday")
    )
    return (
        df.withColumn("_c", country_of_region(region))
        .join(days, (F.col("_c") == F.col("_country")) & (col(date) == F.col("_holiday")), "left")
        .withColumn("is_public_holiday", F.coalesce("_is_holiday", F.lit(0)))
        .drop("_c", "_country", "_holiday", "_is_holiday")
    )


def with_calendar(
    df: DataFrame,
    first_year: int,
    last_year: int,
    starts: Sequence[str],
    date: str = "date",
    region: str = "region",
) -> DataFrame:
    """All calendar features of a (date, region) frame."""
    out = with_date_parts(df, date)
    out = with_holiday_flag(out, first_year, last_year, date, region)
    return out.withColumn("days_to_next_course_start", days_to_next(date, starts))


def planning_calendar(
    spark: SparkSession,
    start: str,
    end: str,
    regions: Sequence[str],
    starts: Sequence[str],
    columns: Sequence[str] = CALENDAR_COLUMNS,
) -> DataFrame:
    """Calendar row per planning date and region of a short planning window."""
    grid = (
        spark.range(1)
        .select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
        .select("date", F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"))
    )
    out = with_calendar(grid, int(start[:4]), int(end[:4]) + 1, starts)
    return out.select("date", "region", *columns)
