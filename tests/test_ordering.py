"""Places, blocks and percentiles of groups that lie in many partitions, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlake.operators import archive, groups, ordering


@pytest.fixture(scope="module", autouse=True)
def uncoalesced(spark):
    """Small tables stay in several partitions, so that groups do go over their edges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def rows():
    """One hot group, a null one, small ones; nulls and repeated values; an extra column."""
    rng = random.Random(11)
    out = [("hot", rng.choice([None, *range(40)]), i) for i in range(900)] + [(None, rng.randint(0, 5), 900 + i) for i in range(60)]
    return out + [(f"g{i % 25}", i % 3, 1000 + i) for i in range(100)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, v long, id long").withColumn("n", F.lit("kept")).repartition(5)


def ordered(rows):
    out = {}
    for g, v, i in rows:
        out.setdefault(g, []).append((v is not None, v or 0, i))
    return {g: sorted(m) for g, m in out.items()}


def test_places_and_sums(df, rows):
    places = {r.id: r.nth for r in ordering.placed(df, ["g"], ["v", "id"]).collect()}
    sums = {r.id: (r.total, r.n) for r in ordering.running(df, ["g"], ["v", "id"], "total", F.col("v")).collect()}
    assert len(places) == len(sums) == len(rows)
    for members in ordered(rows).values():
        total = 0
        for nth, (_, v, i) in enumerate(members, 1):
            total += v
            assert places[i] == nth and sums[i] == (total, "kept")


def test_a_hot_group_lies_in_several_partitions(df):
    hot = df.where("g = 'hot'").repartitionByRange("g", "v", "id").select(F.spark_partition_id().alias("p"))
    assert hot.distinct().count() > 1


def test_descending_order_and_whole_table(df, rows):
    got = [r.id for r in ordering.placed(df, [], [F.desc("id")]).orderBy("nth").collect()]
    assert got == sorted((i for *_, i in rows), reverse=True)


def test_blocks(df, rows):
    got = {(r.g, r.block): (r.lines, r.text) for r in ordering.blocks(df, ["g"], ["v", "id"], F.when(F.col("id") % 7 != 0, F.col("id").cast("string")), 64).collect()}
    want = {}
    for g, members in ordered(rows).items():
        lines = [str(i) if i % 7 else "" for *_, i in members]
        for b in range(0, len(lines), 64):
            want[g, b // 64] = (len(lines[b : b + 64]), "\n".join(lines[b : b + 64]))
    assert got == want


def test_group_rows(df, rows):
    got = {(r.g, r.id, r.nth): r.n for r in ordering.group_rows(df.drop("n"), ["g"], ["v", "id"], 50).collect()}
    assert got == {(g, m[2], k): len(ms) for g, ms in ordered(rows).items() if len(ms) >= 50 for k, m in enumerate(ms, 1)}


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentiles(df, rows, p):
    got = {r.g: (r.size, r.q) for r in ordering.percentiles(df.drop("n"), ["g"], "v", {"q": p}).withColumnRenamed("n", "size").collect()}
    values = {g: [v for k, v, _ in m if k] for g, m in ordered(rows).items()}
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert got[g][0] == len(v) and got[g][1] == pytest.approx(np.percentile(v, p * 100), abs=1e-9)


def test_pages_and_packages(spark, df):
    lib = archive.library_pages(df.select(F.col("g").alias("topic"), F.lit("k").alias("kind"), F.col("id").alias("ref")), 100)
    hot = [r.markdown for r in lib.where("topic = 'hot'").orderBy("page").collect()]
    assert len(hot) == 9 and all(m.startswith("## hot\n- [k] ") and m.count("\n") == 100 for m in hot)
    days = spark.createDataFrame([("2024-01-02", "b"), ("2024-01-02", None), (None, "x")], "day string, title string").withColumn("day", F.to_date("day"))
    assert {(r.month, r.markdown) for r in archive.month_log_pages(days).collect()} == {("2024-01", "- 2024-01-02 \n- 2024-01-02 b"), (None, "- undated x")}
    docs = spark.createDataFrame([(1, "labs", "b"), (1, "labs", "a"), (1, None, "c"), (None, "labs", None)], "tenant long, category string, filename string")
    events = days.select(F.lit(1).cast("long").alias("tenant"), "day", "title").where("title = 'b'")
    got = {tuple(r) for r in groups.package_rows(docs, events).collect()}
    assert got == {(1, "documents/labs", 1, "a"), (1, "documents/labs", 2, "b"), (1, "documents/", 1, "c"), (None, "documents/labs", 1, None), (1, "timeline", 1, "2024-01-02 b")}


def test_empty_tables(df):
    none = df.limit(0)
    assert ordering.placed(none, ["g"], ["v"]).count() == 0 and ordering.group_rows(none.drop("n"), ["g"], ["v"]).count() == 0
    assert ordering.blocks(none, ["g"], ["v"], F.col("g"), 5).count() == 0 and ordering.percentiles(none.drop("n"), ["g"], "v", {"q": 0.5}).count() == 0
