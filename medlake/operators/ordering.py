"""Places, running sums, blocks and exact percentiles in groups of which one may hold any share of all rows.

A window over a group sorts the whole group in one task.  Here rows are sorted into range partitions by group and order,
so that a large group lies in many of them; each partition counts for itself, and a group that goes on in the next
partition takes its totals along.  Totals are a row for each group in each partition, whatever the number of rows.

Null keys are a group of their own and null order values come first.  Rows that are equal in keys and order stay in one
partition and take their places in any order; order by a unique column as well where that matters.  Empty tables give
empty ones.  Columns of the rows are kept; those added must have names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators.relations import _cut
from medlake.session import if_few

PART, AT, CARRIED = "__part", "__at", "__carried"


def running(df: DataFrame, keys: list[str], order: list[str | Column], name: str, amount: Column | None = None) -> DataFrame:
    """df with the sum of `amount` (long; null counts as none; by default 1 a row) up to and with each row of its group, in order."""
    by = [*(F.col(k) for k in keys), *order]
    rows = df.withColumn(name, F.lit(1).cast("long") if amount is None else F.coalesce(amount.cast("long"), F.lit(0).cast("long")))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = _cut(rows.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}))
    inside = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    # of a partition's groups only the last can go on, so few groups are in more than one
    totals = rows.groupBy(*keys, PART).agg(F.sum(name).alias(CARRIED)).withColumn("__parts", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__parts > 1")
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = _cut(totals.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), F.col(PART).alias("__of"), F.sum(CARRIED).over(before).alias(CARRIED)))
    same = F.col(PART) == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    local = rows.withColumn(name, F.sum(name).over(inside)).join(if_few(carried), same, "left")
    return local.withColumn(name, F.col(name) + F.coalesce(CARRIED, F.lit(0).cast("long"))).select(*df.columns, name)


def placed(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "nth") -> DataFrame:
    """df with the place of each row in its group, from 1."""
    return running(df, keys, order, name)


def blocks(df: DataFrame, keys: list[str], order: list[str | Column], line: Column, size: int) -> DataFrame:
    """Text of each group in blocks (keys, block from 0, lines, text) of `size` lines at most, in order; a null line is an empty one."""
    rows = placed(df.withColumn("__line", F.coalesce(line, F.lit(""))), keys, order, "__nth")
    block = F.floor((F.col("__nth") - 1) / size).cast("long")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__nth", "__line"))), lambda x: x["__line"])
    return rows.groupBy(*keys, block.alias("block")).agg(F.count(F.lit(1)).alias("lines"), F.array_join(listed, "\n").alias("text"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Rows and exact percentiles of each group (keys, n, one column a name of `at`), linear between ranks; null values do not count.

    Equal values are counted first, so that what is sorted is the distinct ones; those at the ranks wanted are two a percentile.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = _cut(running(counted, keys, ["__value"], "__upto", F.col("__n")))
    sizes = ranks.groupBy(*keys).agg(F.max("__upto").alias("n")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = ranks.join(if_few(sizes), same)
    last = (F.col("n") - 1).cast("double")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank), F.col("__value")))

    aggregates = {}
    for name, p in at.items():
        rank = last * p
        aggregates |= {f"__low_{name}": at_rank(F.floor(rank)), f"__high_{name}": at_rank(F.ceil(rank)), f"__part_{name}": F.max(rank - F.floor(rank))}
    out = rows.groupBy(*keys, "n").agg(*(a.alias(c) for c, a in aggregates.items()))
    between = [(F.col(f"__low_{c}") * (1 - F.col(f"__part_{c}")) + F.col(f"__high_{c}") * F.col(f"__part_{c}")).alias(c) for c in at]
    return out.select(*keys, "n", *between)


def group_rows(df: DataFrame, keys: list[str], order: list[str | Column], least: int = 2) -> DataFrame:
    """The rows of groups of at least so many, with the size `n` of their group and their place `nth` in it: no group is listed in one row."""
    ranks = _cut(placed(df, keys, order))
    sizes = ranks.groupBy(*keys).agg(F.max("nth").alias("n")).where(F.col("n") >= least)
    sizes = sizes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranks.join(if_few(sizes), same).select(*df.columns, "n", "nth")
