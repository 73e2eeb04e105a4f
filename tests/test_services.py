"""Edges of the table services on small rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from medlake.operators import services


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quota_counts_what_is_held(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2)], "t string, id int")
    new = spark.createDataFrame([("a", 4), ("a", 3), ("b", 5)], "t string, id int")
    assert rows(services.insert_within_quota(base, new, "t", ["id"], 3)) == [("a", 1), ("a", 2), ("a", 3), ("b", 5)]


def test_replacing_keeps_one_row_a_key(spark):
    base = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "d int, p string, v double")
    new = spark.createDataFrame([(1, "x", 3.0), (1, "x", 4.0)], "d int, p string, v double")
    assert rows(services.insert_or_replace(base, new, ["d", "p"], [F.desc("v")])) == [(1, "x", 4.0), (1, "y", 2.0)]
    assert rows(services.insert_or_replace(base, new.limit(0), ["d", "p"], [F.desc("v")])) == rows(base)


def test_once_only_kinds(spark):
    df = spark.createDataFrame([("a", "joined", 1), ("a", "joined", 2), ("a", "seen", 3), ("a", "seen", 4), (None, None, 5), (None, None, 6)], "t string, k string, id int")
    assert [r.id for r in services.once_only(df, ["t"], "k", ["joined"], ["id"]).orderBy("id").collect()] == [1, 3, 4, 5, 6]


def test_owners_are_recovered_or_marked(spark):
    df = spark.createDataFrame([(1, "a"), (1, ""), (2, None), (None, None)], "d int, t string")
    own = spark.createDataFrame([(1, "z")], "d int, t string")
    assert rows(services.recover_owners(df, own, "d", "t", "?")) == [(1, "a", "kept"), (1, "z", "recovered"), (2, "?", "sentinel"), (None, "?", "sentinel")]


def test_extracted_values_take_the_nearest_date(spark):
    meta = '{"date":"2024-02-01","labs":[{"date":"2024-01-05","parameter":"WBC","value":"4,5"},{"parameter":"HGB","value":"12"},{"parameter":"X","value":"high"},{"date":"soon","parameter":"PLT","value":"3"}]}'
    df = spark.createDataFrame([(1, meta, date(2023, 1, 1)), (2, '{"labs":[{"parameter":"WBC","value":"1"}]}', date(2023, 1, 1)), (3, "no json", None), (4, None, None)], "id int, m string, day date")
    assert rows(services.extracted_values(df, "m", "day").select("id", "parameter", "lab_date", "value")) == [
        (1, "HGB", date(2024, 2, 1), 12.0), (1, "PLT", date(2024, 2, 1), 3.0), (1, "WBC", date(2024, 1, 5), 4.5), (2, "WBC", date(2023, 1, 1), 1.0)
    ]


def test_stale_runs_close(spark):
    df = spark.createDataFrame([(1, "running", datetime(2024, 1, 1, 10), None), (2, "running", datetime(2024, 1, 1, 11, 55), None), (3, "ok", datetime(2024, 1, 1), None)], "id int, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = services.close_stale(df, F.expr("timestamp_ntz'2024-01-01 12:00:00'")).orderBy("id").collect()
    assert [r.status for r in got] == ["timeout", "running", "ok"] and got[0].finished_at == datetime(2024, 1, 1, 12) and got[1].finished_at is None


def test_folders(spark):
    df = spark.createDataFrame([(1, None, "labs"), (2, 1, "2024-01"), (3, 2, "2024-02"), (4, 9, "2024-03"), (5, 6, "2024-04"), (6, None, "misc")], "id int, parent int, name string")
    assert rows(services.misplaced_folders(df, ["labs"]).select("id", "why")) == [(3, "month_in_month"), (5, "no_category")]
    twins = spark.createDataFrame([(1, 0, "Labs"), (2, 0, "labs"), (3, 1, "labs")], "id int, parent int, name string")
    assert [list(r.ids) for r in services.duplicate_siblings(twins, "parent", "name", "id").collect()] == [[1, 2]]


def test_a_group_needs_all_its_guards(spark):
    df = spark.createDataFrame(
        [("a", date(2024, 1, 1), "X", 0.9, None), ("a", date(2024, 1, 3), "X ", 0.8, None), ("b", None, "X", 0.9, None), ("c", None, "X", 0.9, 1), ("c", None, "X", 0.9, None), ("d", None, None, 0.6, None), ("d", None, None, 0.9, None)],
        "g string, day date, place string, sure double, taken int",
    )
    assert {r.g: r.fits for r in services.may_group(df, "g", "day", "place", "sure", "taken").collect()} == {"a": True, "b": False, "c": False, "d": False}
