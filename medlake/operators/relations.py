"""Joins, set operations, first-of-group and change tracking."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.session import if_few, shared_dir


def scoped(rows: DataFrame, owners: DataFrame, key: str, owner_key: str, tenant: object, column: str = "tenant") -> DataFrame:
    """Rows whose owner belongs to the tenant; rows have no tenant of their own."""
    own = owners.where(F.col(column) == F.lit(tenant)).select(F.col(owner_key).alias(key), column)
    return rows.join(own, key)


def both_ends(links: DataFrame, nodes: DataFrame, node: str, columns: list[str], targets: DataFrame | None = None) -> DataFrame:
    """Links with the columns of both ends, as source_<c> and target_<c>; links to missing nodes go.

    Targets may have a table of their own, of the same columns as nodes.
    """
    sides = {"source": nodes, "target": nodes if targets is None else targets}
    ends = [side.select(F.col(node).alias(e), *(F.col(c).alias(f"{e}_{c}") for c in columns)) for e, side in sides.items()]
    return links.join(ends[0], "source").join(ends[1], "target")


def neighbours(links: DataFrame, node: str = "id") -> DataFrame:
    """Each node with the other end of each of its links, whichever way they point."""
    one = links.select(F.col("source").alias(node), F.col("target").alias("other"), "relationship", "confidence")
    two = links.select(F.col("target").alias(node), F.col("source").alias("other"), "relationship", "confidence")
    return one.unionByName(two).where(F.col(node) != F.col("other"))


def later_copies(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Rows that repeat a key under a higher id; a null key repeats nothing."""
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    first = rows.groupBy(*keys).agg(F.min(id_column).alias("kept"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return rows.join(first, keys).where(F.col(id_column) != F.col("kept")).select(*df.columns, "kept")


def large_groups(df: DataFrame, keys: list[str], id_column: str, least: int = 2) -> DataFrame:
    """Groups of at least so many rows with their smallest and largest id."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id")
    ).where(F.col("n") >= least)


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Every key of either side as ours_only, theirs_only, same or different; nulls compare as equal."""
    a = ours.select(key, *(F.col(c).alias(f"our_{c}") for c in compared), F.lit(True).alias("in_ours"))
    b = theirs.select(key, *(F.col(c).alias(f"their_{c}") for c in compared), F.lit(True).alias("in_theirs"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"our_{c}").eqNullSafe(F.col(f"their_{c}"))
    state = F.when(F.col("in_theirs").isNull(), "ours_only").when(F.col("in_ours").isNull(), "theirs_only").when(same, "same").otherwise("different")
    return a.join(b, key, "full_outer").withColumn("state", state).drop("in_ours", "in_theirs")


def names_of_others(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """Texts that contain a name (tenant, name) of another tenant, whatever the case.

    Names shorter than `least` say too little.  A text meets a name by the name's first `least` letters, which it holds;
    what meets is then compared whole.  Names that were counted and are few are broadcast, so that no letters of texts
    are shuffled; beyond that both sides shuffle by these letters, each distinct one of a text once.
    """
    n = names.where(F.length("name") >= least).select(F.col("tenant").alias("named"), F.lower("name").alias("name"))
    n = n.where(F.length("name") >= least).withColumn("__head", F.substring("name", 1, least))
    low = F.lower("text")
    heads = F.transform(F.sequence(F.lit(1), F.length(low) - (least - 1)), lambda i: F.substring(low, i, F.lit(least)))
    rows = texts.where(F.length(low) >= least).withColumn("__head", F.explode(F.array_distinct(heads)))
    return rows.join(if_few(n), "__head").where(low.contains(F.col("name")) & (F.col("named") != F.col("tenant"))).drop("__head")


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is not in the other's, as NOT IN has it: none where the list holds a null, and no null key unless the list is empty."""
    listed = other.agg(F.count_if(F.col(other_key).isNull()).alias("__nulls"), F.count(F.lit(1)).alias("__n"))  # one row
    rows = df.join(other.select(F.col(other_key).alias(key)), key, "left_anti").join(F.broadcast(listed), F.lit(True))
    return rows.where((F.col("__nulls") == 0) & (F.col(key).isNotNull() | (F.col("__n") == 0))).select(df.columns)


def upsert(base: DataFrame, changes: DataFrame, key: str, kept_if_null: list[str]) -> DataFrame:
    """base with changes merged in: new keys are added, others overwritten, except that a null of `kept_if_null` keeps the old value."""
    columns = [c for c in base.columns if c != key]
    old = base.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("has_old"))
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("has_new"))

    def merged(c: str) -> Column:
        taken = F.coalesce(f"new_{c}", f"old_{c}") if c in kept_if_null else F.col(f"new_{c}")
        return F.when(F.col("has_new"), taken).otherwise(F.col(f"old_{c}")).alias(c)

    return old.join(new, key, "full_outer").select(key, *map(merged, columns))


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows whose key it lacks, one row a key."""
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti"))


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Audit rows of changed records: the names of changed fields, in order, and both states as JSON."""
    a = before.select(key, F.struct(*columns).alias("old"))
    b = after.select(key, F.struct(*columns).alias("new"))
    fields = F.array_compact(F.array(*(F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in columns)))
    rows = a.join(b, key).withColumn("changed_fields", fields).where(F.size("changed_fields") > 0)
    return rows.select(key, "changed_fields", F.to_json("old").alias("before"), F.to_json("new").alias("after"))


def purge(df: DataFrame, children: list[DataFrame], key: str, deleted: str, before: Column) -> list[DataFrame]:
    """df and its children without the records that were deleted before a time."""
    gone = df.where(F.col(deleted) < before).select(key)
    return [part.join(gone, key, "left_anti") for part in (df, *children)]


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through a table in the shared folder, without the constraints that DataFrame.checkpoint keeps and multiplies."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reached(start: DataFrame, links: DataFrame) -> DataFrame:
    """(start_id, id, far): what each (start_id, id) reaches over the links (at, to), with the least number of links.

    A round doubles both the links' length and the distance that is covered, so rounds grow with the
    logarithm of the longest way; a round that finds nothing new is the last, in cycles too.
    """
    found = _cut(start.select("start_id", "id", F.lit(0).alias("far")).distinct())
    links, length, n = _cut(links.distinct()), 1, found.count()
    while True:
        further = found.join(links, F.col("id") == F.col("at")).select("start_id", F.col("to").alias("id"), (F.col("far") + length).alias("far"))
        found = _cut(found.unionByName(further).groupBy("start_id", "id").agg(F.min("far").alias("far")))
        before, n = n, found.count()
        if n == before:
            return found
        onward = links.select(F.col("at").alias("to"), F.col("to").alias("last"))
        links, length = _cut(links.join(onward, "to").select("at", F.col("last").alias("to")).distinct()), length * 2


def version_chain(rows: DataFrame, start: DataFrame) -> DataFrame:
    """The versions linked with each start id, newest first as `nth` from 0; rows are (id, previous_id), one an id.

    Walks forward to the newest, however far, and then back; a cycle ends where it closes.
    Where versions branch, the newest is the one that is most links ahead, of equals the largest id.
    """
    links = rows.where("previous_id is not null").select("id", "previous_id")
    up = _reached(start.select(F.col("id").alias("start_id"), "id"), links.select(F.col("previous_id").alias("at"), F.col("id").alias("to")))
    newest = up.groupBy("start_id").agg(F.max_by("id", F.struct("far", "id")).alias("id"))
    return _reached(newest, links.select(F.col("id").alias("at"), F.col("previous_id").alias("to"))).withColumnRenamed("far", "nth")


def active_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of both sides that meet by key; each side holds its live rows only."""
    return left.join(right, F.col(left_key) == F.col(right_key))


def resolved_neighbours(links: DataFrame, nodes: DataFrame, columns: list[str], node: str = "id") -> DataFrame:
    """neighbours() with columns of the other end, as other_<c>; links with an end that is no live node go."""
    ends = nodes.select(F.col(node).alias("other"), *(F.col(c).alias(f"other_{c}") for c in columns))
    return neighbours(links, node).join(nodes.select(node), node, "left_semi").join(ends, "other").select(node, "other", *(f"other_{c}" for c in columns), "relationship", "confidence")


def group_members(df: DataFrame, keys: list[str], order: list[str], id_column: str, least: int = 2) -> DataFrame:
    """Groups of at least so many rows with their ids in order; ids alone are listed, not rows."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[id_column])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).where(F.col("n") >= least)
