"""Streams with state, stored tables, the text index, folder trees, dumps, JSON, letters and chunks."""

import gzip
import os
import random
import re
import unicodedata
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from medlake.functions import scalars as S
from medlake.operators import archive, folders, services, textindex
from medlake.session import dealt
from medlake.sources import dumps, files
from medlake.streaming import imports, stateful, streams

T0 = datetime(2024, 1, 1)


def streamed(spark, tmp_path, parts, schema, make):
    """What a stream makes of parts that arrive one after the other."""
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = make(streams.arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1000))
        streams.drain(out, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


CALLS = "id long, tenant string, ts timestamp, status string"


def test_responses_answer_to_the_last_moment(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [
        [(1, "a", at(0), "error"), (2, "a", at(1), "ok"), (3, "a", at(1), "ok"), (4, "b", at(5), "ok"), (5, None, at(5), "ok")],
        [(6, "a", at(61), "ok"), (7, "a", at(61) + timedelta(microseconds=1), "ok"), (8, "b", at(4), "ok"), (9, "b", at(6), "error")],
        [(10, "a", at(100), "ok"), (11, "b", at(900), "error"), (12, "b", at(901), "ok")],
    ]
    got = {r.id: (r.hit_id, r.age_s) for r in streamed(spark, tmp_path, parts, CALLS, lambda c: stateful.answered(c, ["tenant"], 60))}
    assert got == {1: (None, None), 2: (None, None), 3: (2, 0.0), 4: (None, None), 6: (2, 60.0), 7: (None, None), 8: (None, None), 9: (4, 1.0), 10: (7, pytest.approx(38.999999)), 11: (None, None), 12: (None, None)}


def test_rate_is_exact_at_the_edge(spark, tmp_path):
    """120 calls pass, the next is refused until the first is 60 s old; refused calls count for nothing."""
    rows = [(i, "a", T0 + timedelta(milliseconds=i), "ok") for i in range(125)]
    late = [(200, "a", T0 + timedelta(seconds=60) - timedelta(microseconds=1), "ok"), (201, "a", T0 + timedelta(seconds=60), "ok"), (202, "a", T0 + timedelta(seconds=60), "ok"), (203, "b", T0, "ok")]
    got = {r.id: r.allowed for r in streamed(spark, tmp_path, [rows[:70], rows[70:], late], CALLS, lambda c: stateful.limited(c, "tenant"))}
    assert {i for i, ok in got.items() if not ok and i < 200} == set(range(120, 125))
    assert (got[200], got[201], got[202], got[203]) == (False, True, False, True)


def test_keys_are_called_upon_in_groups(spark, tmp_path, monkeypatch):
    """Keys of one group have decisions and state of their own, also where one of them has ended and others go on."""
    monkeypatch.setattr(stateful, "GROUPS", 1)
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [
        [(1, "a", at(0), "ok"), (2, "b", at(0), "ok"), (3, "a", at(1), "ok"), (4, 'b",', at(1), "ok")],
        [(5, "b", at(200_000), "ok"), (6, "b", at(200_001), "ok")],
        [(7, "a", at(200_002), "ok"), (8, "b", at(200_002), "ok"), (9, "b", at(200_060), "ok")],
    ]
    got = {r.id: (r.tenant, r.allowed) for r in streamed(spark, tmp_path / "rates", parts, CALLS, lambda c: stateful.limited(c, "tenant", 1))}
    assert got == {1: ("a", True), 2: ("b", True), 3: ("a", False), 4: ('b",', True), 5: ("b", True), 6: ("b", False), 7: ("a", True), 8: ("b", False), 9: ("b", True)}
    hits = {r.id: r.hit_id for r in streamed(spark, tmp_path / "hits", parts, CALLS, lambda c: stateful.answered(c, ["tenant"], 60))}
    assert hits == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: 5, 7: None, 8: 5, 9: 5}


def test_rates_of_windows(spark, tmp_path):
    rows = [(i, "a", T0 + timedelta(seconds=i), "ok") for i in range(5)] + [(9, "a", T0 + timedelta(days=2), "ok")]
    got = streamed(spark, tmp_path, [rows, [(10, "a", T0 + timedelta(days=5), "ok")]], CALLS, lambda c: streams.rates(c, "tenant", most=4))
    assert {r.n for r in got} == {5}


def listing(spark, rows):
    return spark.createDataFrame([(i, n, T0 + timedelta(days=d), m) for i, n, d, m in rows], imports.LISTING)


def test_a_batch_counts_once(spark, tmp_path):
    store = imports.StoredTable(spark, str(tmp_path), imports.IMPORTED, "id", 4)
    assert store.read().count() == 0 and store.batches() == []
    first = listing(spark, [(1, "a", 0, "x"), (2, "b", 0, "x"), (3, "c", 0, "x"), (3, "c2", 1, "y"), (4, "d", 0, "x")])
    second = listing(spark, [(1, "a", 0, "z"), (2, "b2", 1, "x"), (3, "c2", 2, "w"), (5, "e", 0, "x"), (4, "d", 1, "x")])
    assert imports.import_batch(store, first, 0) and imports.import_batch(store, second, 1)
    once = sorted(tuple(r) for r in store.read().collect())
    assert not imports.import_batch(store, second, 1) and not imports.import_batch(store, first, 0)
    assert sorted(tuple(r) for r in store.read().collect()) == once
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in once] == [(1, "a", "x", 0, 0), (2, "b2", "x", 0, 1), (3, "c2", "w", 0, 1), (4, "d", "x", 0, 0), (5, "e", "x", 1, 1)]
    assert {(r.batch, r.state): r.n for r in imports.counts(store).collect()} == {(0, "new"): 4, (1, "unchanged"): 2, (1, "renamed"): 1, (1, "updated"): 1, (1, "new"): 1}


def test_an_import_reads_its_listing_once_and_several_tasks_write_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "PART_ROWS", 20)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    store = imports.StoredTable(spark, str(tmp_path), imports.IMPORTED, "id", 2)
    rows = spark.range(200).selectExpr("id", "concat('f', id) as name", "timestamp'2024-01-01' as modified", "md5(cast(id as string)) as md5").mapInPandas(counted, imports.LISTING)
    assert imports.import_batch(store, rows, 0, imports.every(1)) and read.value == 200
    assert imports.import_batch(store, rows.where("id < 150"), 1, imports.every(1)) and read.value == 400
    assert store.read().where("removed_at = 1").count() == 50 and store.read().count() == 200
    assert all(len([f for f in os.listdir(tmp_path / f"data/batch=1/bucket={b}") if f.endswith(".parquet")]) > 1 for b in (0, 1))


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    store = imports.StoredTable(spark, str(tmp_path), imports.IMPORTED, "id", 2)
    imports.import_batch(store, listing(spark, [(1, "a", 0, "x")]), 0)
    # data of batch 1 without a manifest: nobody reads them
    listing(spark, [(9, "stray", 0, "x")]).withColumns({"first_batch": F.lit(1), "last_batch": F.lit(1), "removed_at": F.lit(None).cast("int")}).withColumn("bucket", store.bucket()).write.partitionBy("bucket").parquet(f"{tmp_path}/data/batch=1")
    assert [r.id for r in store.read().collect()] == [1]
    imports.import_batch(store, listing(spark, [(2, "b", 0, "x")]), 1)
    assert sorted(r.id for r in store.read().collect()) == [1, 2]


def test_full_cycles_see_removals_and_returns(spark, tmp_path):
    store = imports.StoredTable(spark, str(tmp_path), imports.IMPORTED, "id", 2)
    both, one = [(1, "a", 0, "x"), (2, "b", 0, "x")], [(1, "a", 0, "x")]
    for batch, rows in enumerate([both, one, one, one, both, one, one, one, one]):
        imports.import_batch(store, listing(spark, rows), batch, imports.every(3))
        seen = {r.id: r.removed_at for r in store.read().collect()}
        assert seen == {1: None, 2: {2: 2, 3: 2, 5: 5, 6: 5, 7: 5, 8: 5}.get(batch)}
    assert [imports.every(6)(b, False) for b in range(12)] == [b in (5, 11) for b in range(12)] and imports.every(6)(0, True)


def test_audit_rows_of_a_batch_stand_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "t", T0 + timedelta(seconds=i), "ok") for i in range(10)], CALLS)
    write = imports.audit(str(tmp_path), 6)
    for batch in (0, 0, 1):
        write(rows, batch)
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted((r.batch, r.id) for r in got.collect()) == [(b, i) for b in (0, 1) for i in range(4, 10)]
    told = spark.read.schema("batch int, total long, kept long, dropped long").json(f"{tmp_path}/metrics/*").collect()
    assert sorted(tuple(r) for r in told) == [(0, 10, 6, 4), (1, 10, 6, 4)]


def test_a_stopped_audit_stream_goes_on(spark, tmp_path):
    """The first run breaks off in its second batch; the next one gives each call once."""
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "t", T0, "ok") for i in range(4)], CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write = imports.audit(f"{tmp_path}/audit")

    def run(work):
        calls = streams.arrivals(spark, f"{tmp_path}/in", spark.createDataFrame([], CALLS).schema, 1)
        streams.each_batch(calls, work, f"{tmp_path}/log").awaitTermination()

    def broken(rows, batch):
        write(rows, batch)
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(broken)
    run(write)
    got = [r.id for r in spark.read.parquet(f"{tmp_path}/audit/rows").collect()]
    assert sorted(got) == [10 * k + i for k in range(3) for i in range(4)]


def test_index_agrees_with_the_scan(spark, tmp_path):
    rng = random.Random(3)
    pool = ["Of", "the", "naïve", "café", "x1", "end", "the", "ﬁn", "of-the"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 30))), rng.choice(["the end", "of", None])) for i in range(60)] + [(99, None, None), (None, "of the", "of")]
    df = spark.createDataFrame(rows, "id long, text string, title string").repartition(3)
    textindex.build(df, "id", ["text", "title"], str(tmp_path / "index"))
    asked = ["of the", "THE END", "cafe", "naive  café!", "x1", "the the the", "fin of", "missing", "", "--", "end of the"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, phrase string")
    found = textindex.search(textindex.read(spark, str(tmp_path / "index")), queries).collect()

    def plain(x):
        t = "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).lower()
        return "".join(c if c.isalnum() else " " for c in t).split()

    want = {}
    for q, phrase in enumerate(asked):
        p = plain(phrase)
        for i, text, title in rows:
            for field, words in (("text", plain(text)), ("title", plain(title))):
                n = sum(words[k : k + len(p)] == p for k in range(len(words) - len(p) + 1)) if p else 0
                if n and i is not None:
                    want[q, i, field] = n
    assert {(r.query_id, r.id, r.field): r.hits for r in found} == want and len(want) > 100
    for q in (0, 1, 10):
        scan = {r.id for r in archive.phrase(df.where("id is not null"), asked[q], ["text", "title"]).collect()}
        assert {i for k, i, _ in want if k == q} == scan


def test_phrases_lie_within_one_text(spark, tmp_path):
    """Rows of one id are texts of their own; words that many phrases share are read once, and equal rows count once."""
    df = spark.createDataFrame([(1, "a x"), (1, "x b"), (2, "a b a b"), (2, "a b a b")], "id long, text string")
    textindex.build(df, "id", ["text"], str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "a b"), (2, "A, b!"), (3, "b a b"), (4, "a"), (5, "?")], "query_id long, phrase string")
    found = textindex.search(textindex.read(spark, str(tmp_path / "index")), queries).collect()
    assert sorted((r.query_id, r.id, r.hits) for r in found) == [(1, 2, 2), (2, 2, 2), (3, 2, 1), (4, 1, 1), (4, 2, 2)]
    assert textindex.search(textindex.read(spark, str(tmp_path / "index")), queries.where("query_id = 5")).collect() == []


FOLDER = "id long, parent long, name string"


def test_paths_of_any_depth_and_cycles(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(1001)] + [(2000, 2001, "x"), (2001, 2000, "y"), (2002, 2001, "z"), (2003, 7777, "lost"), (3000, None, "second")]
    got = {r.id: (r.path, r.depth) for r in folders.paths(spark.createDataFrame(rows, FOLDER)).collect()}
    assert set(got) == {*range(1001), 3000}
    assert got[1000] == ("/".join(f"n{i}" for i in range(1001)), 1000) and got[0] == ("n0", 0)
    assert folders.paths(spark.createDataFrame([], FOLDER)).collect() == []


def test_dealt_rows_stay_apart_however_well_they_compress(spark):
    """Rows that are all alike but for their key lie in as many partitions as their number asks for, in joins too."""
    rows = spark.range(1_300_000).select("id", F.lit("x").alias("same"))
    parts = dealt(rows, rows.count(), "id").join(dealt(rows.select("id"), rows.count(), "id"), "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 6 and sum(r["count"] for r in parts) == 1_300_000
    assert dealt(rows, 10, "id", size=512 << 20).rdd.getNumPartitions() == 8


def test_ways_that_have_ended_are_not_joined_again(spark):
    """Paths of short and long ways, of two roots, of a tree of roots alone and of repeated names."""
    rows = [(0, None, "a"), (1, None, "b")] + [(i, 0, f"s{i}") for i in range(2, 40)] + [(i, i - 1 if i > 100 else 1, "n") for i in range(100, 171)]
    got = {r.id: (r.path, r.depth) for r in folders.paths(spark.createDataFrame(rows, FOLDER)).collect()}
    assert len(got) == len(rows) and got[39] == ("a/s39", 1) and got[170] == ("/".join(["b"] + ["n"] * 71), 71)
    assert sorted(tuple(r) for r in folders.paths(spark.createDataFrame(rows[:2], FOLDER)).collect()) == [(0, "a", 0), (1, "b", 0)]


def test_twins_merge_level_by_level(spark):
    """Twins below twins merge too; the twin with most children stays."""
    rows = [(1, None, "root"), (2, 1, "Labs"), (3, 1, "labs"), (4, 2, "2024-01"), (5, 3, "2024-01"), (6, 3, "2024-02"), (7, 5, "a"), (8, 4, "b"), (9, 5, "c"), (10, 1, "other"), (11, 10, "2024-03"), (12, 11, "2024-04"), (13, 1, "2024-05")]
    df = spark.createDataFrame(rows, FOLDER)
    assert sorted(tuple(r) for r in folders.merges(df).collect()) == [(2, 3), (4, 5)]
    tree = {r.id: r.parent for r in folders.merged_tree(df).collect()}
    assert tree == {1: None, 3: 1, 5: 3, 6: 3, 7: 5, 8: 5, 9: 5, 10: 1, 11: 10, 12: 11, 13: 1}
    assert folders.merges(folders.merged_tree(df)).collect() == []
    items = spark.createDataFrame([(100, 4), (101, 12), (102, 6), (103, 555)], "id long, parent long")
    plan = [tuple(r) for r in folders.repair_plan(df, items, ["Labs", "labs", "other"]).collect()]
    assert len(plan) == 10 and set(plan) == {("merge", 2, 3), ("trash", 2, None), ("merge", 4, 5), ("trash", 4, None), ("reparent", 8, 5), ("reparent", 100, 5), ("raise", 101, 11), ("trash_nested", 12, None), ("category", 13, 10), ("consolidate", 103, 1)}


def _plain_plan(rows, items, categories):
    """repair_plan() of a tree below roots, one folder after the other."""
    by = {i: (p, n) for i, p, n in rows}
    path = lambda i: () if i is None else (*path(by[i][0]), by[i][1].lower())
    children = Counter(p for _, p, _ in rows)
    classes = {}
    for i in by:
        classes.setdefault(path(i), []).append(i)
    keeper = {i: k for c in classes.values() for k in [max(c, key=lambda x: (children[x], -x))] for i in c if i != k}
    month = lambda i: re.fullmatch("\\d{4}-\\d{2}", by[i][1])
    months = [i for i, (p, _) in by.items() if i not in keeper and month(i) and p is not None]
    nested = {i: by[i][0] for i in months if month(by[i][0])}
    roots = [i for i, (p, _) in by.items() if p is None]
    places = [i for i, (p, n) in by.items() if n == "other" and p in roots and i not in keeper]
    out = [(op, i, k if op == "merge" else None) for i, k in keeper.items() for op in ("merge", "trash")]
    for i, p in [*((i, p) for i, p, _ in rows), *items]:
        if i not in keeper:
            out += [("reparent", i, keeper[p])] if p in keeper else [("raise", i, nested[p])] if p in nested else []
    out += [("trash_nested", i, None) for i in nested]
    out += [("category", i, min(places, default=None)) for i in months if i not in nested and by[by[i][0]][1] not in categories]
    return Counter(out + [("consolidate", i, min(roots)) for i, p in items if p not in by])


@pytest.mark.parametrize("part_rows, few", [(250_000, 100_000), (3, 0)])
def test_repair_plan_as_a_plain_one(spark, monkeypatch, part_rows, few):
    """Trees of few names, items of hot, unknown and no parents and of the ids of twins, whichever way their rows are joined."""
    monkeypatch.setattr(folders, "PART_ROWS", part_rows)
    monkeypatch.setattr(folders, "FEW", few)
    rng = random.Random(5)
    names = ["labs", "Labs", "LABS", "2024-01", "2024-02", "x", "other"]
    rows = [(0, None, "root"), (1, None, "second")] + [(i, rng.choice([0, 0, 1, rng.randrange(i), max(0, i - 1)]), rng.choice(names)) for i in range(2, 160)]
    items = [(i, rng.choice([None, 7777, 7777, 0, rng.randrange(160), 8000 + i])) for i in range(100, 700)]
    got = folders.repair_plan(spark.createDataFrame(rows, FOLDER), spark.createDataFrame(items, "id long, parent long"), ["labs"])
    assert Counter(tuple(r) for r in got.collect()) == _plain_plan(rows, items, ["labs"])


def test_items_meet_their_parents_once_and_hot_ones_stay_apart(spark, monkeypatch):
    """What is left to shuffle of a written plan is what may have the id of a twin; a parent of many items is not one task's."""
    rows = [(0, None, "root")] + [(i, 0, f"{'Ab'[i % 2]}{i // 2}") for i in range(1, 40)] + [(41, 0, "a7"), (42, 0, "A7")]
    df = spark.createDataFrame(rows, FOLDER)
    items = spark.range(100, 2100).select("id", F.when(F.col("id") % 2 == 0, -99).otherwise(F.col("id") % 42).alias("parent"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = folders.repair_plan(df, items, [])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert plan.count("Exchange hashpartitioning") <= 4  # those of items, twins, and of folders named `other` and roots
    monkeypatch.setattr(folders, "PART_ROWS", 500)
    top = items.agg(folders._often("parent")).first()[0]
    assert folders._hot(top) == [-99]
    met = folders._met(items.repartition(8), df.select(F.col("id").alias("parent"), "name"), "parent", 2000, folders._hot(top), "left")
    hot = met.where("parent = -99").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in hot) == 1000 and max(r["count"] for r in hot) < 500


def test_dump_comes_back_and_damage_is_found(spark, tmp_path):
    one = spark.createDataFrame([(1, "a\nb", None, 1.5, bytearray(b"\x00\xff"), datetime(2024, 1, 1, 2, 3, 4, 567), [1, None], {"k": "v"}), (2, None, True, float("nan"), None, None, None, None)], "i long, s string, b boolean, d double, x binary, t timestamp, a array<int>, m map<string,string>")
    two = spark.range(500).selectExpr("id", "cast(id as decimal(20,3)) as d", "date'2024-01-01' as day", "timestamp_ntz'2024-01-01 01:02:03.004' as n")
    empty = spark.createDataFrame([], "q string")
    path = str(tmp_path / "dump")
    dumps.dump({"one": one, "two": two.repartition(4), "empty": empty}, path)
    back = dumps.restore(spark, path)
    assert all(back[n].dtypes == df.dtypes for n, df in (("one", one), ("two", two), ("empty", empty)))
    assert sorted(map(str, back["one"].collect())) == sorted(map(str, one.collect())) and back["two"].exceptAll(two).count() == 0
    assert dumps.damaged(spark, path).collect() == []
    assert {r.name: (r.rows, r.columns) for r in dumps.smoke_test(back).collect()} == {"one": (2, 8), "two": (500, 4), "empty": (0, 1)}
    part = next(f for f in sorted(os.listdir(f"{path}/data/two")) if f.endswith(".json.gz"))
    lines = gzip.open(f"{path}/data/two/{part}", "rt").read().splitlines()
    os.remove(f"{path}/data/two/.{part}.crc")
    with gzip.open(f"{path}/data/two/{part}", "wt") as f:
        f.write("\n".join([lines[0].replace('"id":', '"id":9'), *lines[1:]]) + "\n")
    assert [(r.name, r.rows, r.now_rows) for r in dumps.damaged(spark, path).collect()] == [("two", 500, 500)]


def test_dump_reads_its_tables_once_and_a_moved_null_is_damage(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(300).selectExpr("id", "if(id = 7, null, 'x') as a", "if(id = 7, 'x', null) as b", "array(id, null) as c").mapInPandas(counted, "id long, a string, b string, c array<long>")
    path = str(tmp_path / "dump")
    dumps.dump({"rows": rows, "none": spark.createDataFrame([], "q string")}, path)
    assert read.value == 300
    seen = lambda: {tuple(r) for r in dumps.restored(spark, path).select("name", "rows", "columns", "whole").collect()}
    assert seen() == {("rows", 300, 4, True), ("none", 0, 1, True)}
    for part in [f for f in os.listdir(f"{path}/data/rows") if f.endswith(".json.gz")]:
        text = gzip.open(f"{path}/data/rows/{part}", "rt").read()
        os.remove(f"{path}/data/rows/.{part}.crc")
        with gzip.open(f"{path}/data/rows/{part}", "wt") as f:
            f.write(text.replace('"id":7,"a":null,"b":"x"', '"id":7,"a":"x","b":null'))
    assert seen() == {("rows", 300, 4, False), ("none", 0, 1, True)}


def test_json_of_any_shape(spark):
    texts = ['{"a": {"b": [1, null]}, "c": "x"}', "[1, [2], null]", '"s"', "3.5", "true", "null", "{", "", None, '{"a": 1} x', "1,2", "1] [2", "1} {2", " 7 "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string").withColumn("v", S.parsed_json(F.col("j")))
    got = {r.i: (r.ok, r.kind) for r in df.select("i", S.json_valid(F.col("j")).alias("ok"), S.json_kind(F.col("v")).alias("kind")).collect()}
    assert got == {0: (True, "object"), 1: (True, "array"), 2: (True, "string"), 3: (True, "number"), 4: (True, "boolean"), 5: (True, "null"), 6: (False, None), 7: (False, None), 8: (False, None), 9: (False, None), 10: (False, None), 11: (False, None), 12: (False, None), 13: (True, "number")}
    members = S.json_each(df, "j").select("i", "pos", "key", F.to_json("value").alias("v")).collect()
    assert sorted((r.i, r.pos, r.key, r.v) for r in members) == [(0, 0, "a", '{"b":[1,null]}'), (0, 1, "c", '"x"'), (1, 0, None, "1"), (1, 1, None, "[2]"), (1, 2, None, "null")]
    assert [r.x for r in df.select(S.json_strings(F.col("j")).alias("x")).where("i in (2, 6)").collect()] == [[], []]


def test_letters_without_marks_as_decomposition_has_them(spark):
    points = [i for i in range(1, 0xFFFE) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4]
    texts = ["".join(map(chr, points[k : k + 200])) for k in range(0, len(points), 200)] + ["é ł ß ǆ ﬁ ½", "", "plain"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.without_diacritics(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
    assert spark.range(1).select(S.fold(F.lit("Łódź STRASSE ß")).alias("x")).first().x == "łodz strasse ß"


def test_a_backfill_goes_on_where_it_broke_off(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 7 as k", "cast(null as string) as owner")
    owners = spark.createDataFrame([(k, f"o{k}") for k in range(5)], "k long, owner string")
    seen = []

    def work(part):
        if len(seen) == 3:
            raise RuntimeError("lost")
        seen.append(1)
        return services.recover_owners(part, owners, "k", "owner", "none")

    with pytest.raises(RuntimeError):
        services.in_chunks(rows, "id", work, str(tmp_path), 6)
    assert 0 < services.chunks_done(spark, str(tmp_path)).count() < 100
    done = []

    def more(part):
        done.append(1)
        return services.recover_owners(part, owners, "k", "owner", "none")

    assert services.in_chunks(rows, "id", more, str(tmp_path), 6) == 0 and len(done) == 3
    got = {r.id: (r.owner, r.how) for r in services.chunks_done(spark, str(tmp_path)).collect()}
    assert got == {i: (f"o{i % 7}", "recovered") if i % 7 < 5 else ("none", "sentinel") for i in range(100)}


def test_files_changed_since_and_trials(spark, tmp_path):
    for name, at in (("old.txt", 1_000_000_000), ("new.TXT", 1_700_000_000), ("skip.exe", 1_700_000_000)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (at, at))
    got = files.folder(spark, str(tmp_path), modified_after="2020-01-01T00:00:00").select("relative").collect()
    assert [r.relative for r in got] == ["new.TXT"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "T"}, "statusModule": {},\n "designModule": {"phases": ["PHASE1", "PHASE2"]}, "contactsLocationsModule": {"locations": [{"facility": "F", "country": "C"}]}}}')
    trials = files.trials(spark, str(tmp_path / "t"))
    assert [(r.trial, r.phase, r.places, r.conditions) for r in trials.collect()] == [("NCT1", "PHASE1", ["F, C"], None)]
    assert [(r.summary, r.tags) for r in files.trial_entries(trials).collect()] == [("PHASE1 | F, C", '["phase1"]')]


def test_wildcards_of_a_search(spark):
    from medlake.operators import filters

    df = spark.createDataFrame([(1, "A_b"), (2, "axb"), (3, "a%b"), (4, "a\\b"), (5, None), (6, "ba")], "i int, t string")
    ids = lambda term: sorted(r.i for r in filters.where_given(df, text=term, text_columns=("t",)).collect())
    assert ids("a_B") == [1, 2, 3, 4] and ids("a\\b") == [4] and ids("b%a") == [6] and ids("") == [1, 2, 3, 4, 5, 6]
