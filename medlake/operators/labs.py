"""Lab values over time: latest, previous, trend, deltas, panels and thresholds.

Rows are (tenant, parameter, lab_date, value, id).  Of several values of one day the one
with the largest id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.session import if_few

KEY = ["tenant", "parameter"]
RISING, FALLING = 1.05, 0.95
NEAR_LIMIT = 0.10


def daily(labs: DataFrame) -> DataFrame:
    """One value a day of each tenant and parameter."""
    return labs.groupBy(*KEY, "lab_date").agg(F.max_by("value", "id").alias("value"))


def trend(latest: Column, previous: Column) -> Column:
    return (
        F.when(previous.isNull() | latest.isNull(), "insufficient_data")
        .when(latest > previous * RISING, "rising")
        .when(latest < previous * FALLING, "falling")
        .otherwise("stable")
    )


def summary(labs: DataFrame) -> DataFrame:
    """Latest and previous value and their trend; the two newest days of each key suffice, and few rows shuffle twice."""
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("lab_date")))
    two = daily(labs).withColumn("nth", newest).where("nth <= 2")

    def nth(n: int, c: str) -> Column:
        return F.max(F.when(F.col("nth") == n, F.col(c)))

    return two.groupBy(*KEY).agg(
        nth(1, "lab_date").alias("latest_date"), nth(1, "value").alias("latest"),
        nth(2, "lab_date").alias("previous_date"), nth(2, "value").alias("previous"),
    ).withColumn("trend", trend(F.col("latest"), F.col("previous")))


def latest_with_ties(labs: DataFrame) -> DataFrame:
    """All rows of the newest day of each key."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("lab_date"))
    return labs.withColumn("nth", F.rank().over(w)).where("nth = 1").drop("nth")


def previous_before(labs: DataFrame, day: Column) -> DataFrame:
    """The newest value strictly before a day."""
    return labs.where(F.col("lab_date") < day).groupBy(*KEY).agg(
        F.max("lab_date").alias("lab_date"), F.max_by("value", F.struct("lab_date", "id")).alias("value")
    )


def deltas(labs: DataFrame) -> DataFrame:
    """The series of each key with the change from the day before it, rounded to 4 places and in percent to 1."""
    w = Window.partitionBy(*KEY).orderBy("lab_date")
    before = F.lag("value").over(w)
    rows = daily(labs).withColumn("before", before)
    return rows.select(
        *KEY, "lab_date", "value",
        F.bround(F.col("value") - F.col("before"), 4).alias("delta"),
        F.when(F.col("before") != 0, F.bround((F.col("value") - F.col("before")) / F.abs("before") * 100, 1)).alias("delta_pct"),
    )


def compare_panels(labs: DataFrame, first: Column, second: Column) -> DataFrame:
    """Values of two days side by side; a parameter of one day only stays."""
    day = lambda d, name: daily(labs.where(F.col("lab_date") == d)).select(*KEY, F.col("value").alias(name))
    return day(first, "first").join(day(second, "second"), KEY, "full_outer").withColumn("change", F.bround(F.col("second") - F.col("first"), 4))


def safety(labs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Status of each parameter's latest value against both its bounds; yellow within a tenth of one, missing without a value.

    thresholds (parameter, low, high) is a fixed dimension of some dozens of rows.
    """
    latest = summary(labs).select(*KEY, "latest_date", "latest").join(if_few(thresholds.select("parameter", F.lit(True).alias("asked"))), "parameter", "left")
    value = F.when(F.col("asked"), F.struct("parameter", F.struct("latest_date", "latest").alias("at")))
    # one row a tenant, with as many values as there are thresholds
    every = latest.groupBy("tenant").agg(F.map_from_entries(F.collect_list(value)).alias("values")).join(if_few(thresholds))
    at = F.try_element_at("values", F.col("parameter"))
    rows = every.select(*KEY, "low", "high", at["latest_date"].alias("latest_date"), at["latest"].alias("latest"))
    v, low, high = F.col("latest"), F.col("low"), F.col("high")
    out = F.coalesce(v < low, F.lit(False)) | F.coalesce(v > high, F.lit(False))
    near = F.coalesce(v < low * (1 + NEAR_LIMIT), F.lit(False)) | F.coalesce(v > high * (1 - NEAR_LIMIT), F.lit(False))
    status = F.when(v.isNull(), "missing").when(out, "red").when(near, "yellow").otherwise("green")
    return rows.select(*KEY, "latest_date", "latest", status.alias("status"))


def indices(labs: DataFrame, neutrophils: str, platelets: str, lymphocytes: str) -> DataFrame:
    """Immune index and neutrophil ratio of each tenant and day that has lymphocytes above 0."""
    wide = daily(labs).groupBy("tenant", "lab_date").pivot("parameter", [neutrophils, platelets, lymphocytes]).agg(F.first("value"))
    n, p, y = (F.col(f"`{c}`") for c in (neutrophils, platelets, lymphocytes))
    return wide.where(y > 0).select("tenant", "lab_date", F.round(n * p / y, 4).alias("immune_index"), F.round(n / y, 4).alias("ratio"))


def report(labs: DataFrame, ranges: DataFrame, today: Column, neutrophils: str, platelets: str, lymphocytes: str) -> DataFrame:
    """The whole lab summary: latest and previous value, trend, status within its range, days since, and both indices of each tenant's latest values.

    ranges (parameter, low, high) may lack parameters, which then have `no_range`.
    """
    s = summary(labs).join(ranges.select("parameter", "low", "high"), "parameter", "left")
    status = (
        F.when(F.col("low").isNull() & F.col("high").isNull(), "no_range").when(F.col("latest") < F.col("low"), "low").when(F.col("latest") > F.col("high"), "high").otherwise("normal")
    )
    pick = lambda p: F.max(F.when(F.col("parameter") == p, F.col("latest")))
    n, p, y = pick(neutrophils), pick(platelets), pick(lymphocytes)
    derived = s.groupBy("tenant").agg(F.when(y > 0, F.round(n * p / y, 4)).alias("immune_index"), F.when(y > 0, F.round(n / y, 4)).alias("ratio"))
    return s.select("tenant", "parameter", "latest_date", "latest", "previous_date", "previous", "trend", status.alias("status"), F.datediff(today, "latest_date").alias("days_ago")).join(derived, "tenant")


def trends(labs: DataFrame, documents: DataFrame, parameter: str | None = None, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Lab rows of a parameter and a span of days, both ends included, with the address of their document (id, url) where there is one."""
    rows = labs if parameter is None else labs.where(F.col("parameter") == parameter)
    rows = rows if date_from is None else rows.where(F.col("lab_date") >= date_from)
    rows = rows if date_to is None else rows.where(F.col("lab_date") <= date_to)
    return rows.join(documents.select("id", "url"), "id", "left")


def status_counts(statuses: DataFrame) -> DataFrame:
    """How many parameters of each tenant are green, yellow, red or missing."""
    return statuses.groupBy("tenant").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("green", "yellow", "red", "missing")))
