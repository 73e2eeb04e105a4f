"""Edges of the operators on small rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from medlake.functions import scalars as S
from medlake.operators import archive, filters, folders, groups, labs, naming, relations, usage
from medlake.plans import governance, registry
from medlake.sources import files
from medlake.streaming import streams

LABS = "tenant string, parameter string, lab_date date, value double, id long"
CALLS = "id long, tenant string, call_type string, ts timestamp, status string, tokens_in long, tokens_out long, duration_ms long, cost_usd double"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_latest_previous_and_trend(spark):
    d = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
    rows = [("t", "WBC", d[0], 4.0, 1), ("t", "WBC", d[1], 5.0, 2), ("t", "WBC", d[2], 5.0, 3), ("t", "WBC", d[2], 5.6, 4), ("t", "PLT", d[0], 1.0, 5), ("u", "WBC", d[0], None, 6)]
    got = {(r.tenant, r.parameter): (r.latest, r.previous, r.trend) for r in labs.summary(spark.createDataFrame(rows, LABS)).collect()}
    assert got["t", "WBC"] == (5.6, 5.0, "rising")
    assert got["t", "PLT"] == (1.0, None, "insufficient_data")
    assert got["u", "WBC"][2] == "insufficient_data"


def test_delta_percent_is_left_out_after_zero(spark):
    rows = [("t", "X", date(2024, 1, 1), 0.0, 1), ("t", "X", date(2024, 1, 2), 2.0, 2), ("t", "X", date(2024, 1, 3), 3.0, 3)]
    got = [(r.delta, r.delta_pct) for r in labs.deltas(spark.createDataFrame(rows, LABS)).orderBy("lab_date").collect()]
    assert got == [(None, None), (2.0, None), (1.0, 50.0)]


def test_safety_looks_at_both_bounds(spark):  # X11
    rows = [("t", "glucose", date(2024, 1, 1), 9.0, 1), ("t", "wbc", date(2024, 1, 1), 3.1, 2)]
    limits = spark.createDataFrame([("glucose", 3.9, 5.6), ("wbc", 3.0, None), ("plt", 1.0, None)], "parameter string, low double, high double")
    got = {r.parameter: r.status for r in labs.safety(spark.createDataFrame(rows, LABS), limits).collect()}
    assert got == {"glucose": "red", "wbc": "yellow", "plt": "missing"}


@pytest.mark.parametrize(("values", "want"), [([10], 10), ([1, 2, 3, 4, 5], 3), ([1, 2], 2)])
def test_percentile(spark, values, want):  # 1.5 rounds half to even
    rows = [(i, "t", "a", datetime(2024, 1, 1), "ok", 1, 1, v, None) for i, v in enumerate(values)]
    got = {r.call_type: r.p50 for r in usage.percentiles(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {"a": want, "_overall": want}


def test_cost_of_a_million_each(spark):
    assert spark.range(1).select(S.cost_usd(F.lit(1_000_000), F.lit(1_000_000)).alias("c")).first().c == pytest.approx(4.8)


def test_leaderboard_recomputes_missing_cost(spark):  # X8
    rows = [(1, "a", "x", datetime(2024, 1, 1), "ok", 10**6, 0, 1, None), (2, "b", "x", datetime(2024, 1, 1), "error", 1, 1, 1, 0.5), (3, "__system__", "y", datetime(2024, 1, 1), "ok", 0, 0, 1, 0.0)]
    names = spark.createDataFrame([("a", "Ann")], "tenant string, name string")
    got = [(r.tenant, r.billed_usd, r.name, r.errors) for r in usage.leaderboard(spark.createDataFrame(rows, CALLS), names, 2).orderBy(F.desc("billed_usd")).collect()]
    assert got == [("a", 0.8, "Ann", 0), ("b", 0.5, "", 1)]


def test_mode_ties_go_to_the_first_name(spark):
    rows = [(i, "t", c, datetime(2024, 1, 1), "ok", 1, 1, 1, None) for i, c in enumerate("bbaa")]
    assert usage.mode(spark.createDataFrame(rows, CALLS), "tenant", "call_type").first().top == "a"


def test_search_needs_every_term_and_weighs_fields(spark):
    rows = [(1, "red widget", "x"), (2, "x", "Red WIDGET"), (3, "red", "y"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, tags string")
    got = archive.search(df, "RED widget", {"name": 3, "tags": 1}, [F.col("id")], 10).collect()
    assert [(r.id, r.score) for r in got] == [(1, 3), (2, 1)]
    assert archive.search(df, "  ", {"name": 3}, [F.col("id")], 10).count() == 0


def test_phrase_needs_neighbours(spark):
    df = spark.createDataFrame([(1, "Nález: krv, moč"), (2, "krv a moč"), (3, None)], "id int, t string")
    assert [r.id for r in archive.phrase(df, '"Krv moc"', ["t"]).collect()] == [1]


def test_ascii_case_only(spark):
    assert one(spark, S.ascii_lower, "ÁBC") == "Ábc"


@pytest.mark.parametrize(("name", "want"), [("20240131_x.pdf", date(2024, 1, 31)), ("20240100_x.pdf", date(2024, 1, 1)), ("2024-3-5 x.pdf", date(2024, 3, 5)), ("x.pdf", None), ("20249999.pdf", None)])
def test_file_date(spark, name, want):
    assert one(spark, S.file_date, name) == want


def test_fence_sender_and_slug(spark):
    assert one(spark, S.without_fence, "```json\n{}\n```") == "{}"
    assert one(spark, S.sender, "Ann <A@B.c>") == "a@b.c" and one(spark, S.sender, " A@b.c ") == "a@b.c"
    assert one(spark, S.slug, "a b/č") == "a_b_"


def test_date_range_holds_the_whole_last_day(spark):
    rows = [(datetime(2024, 1, 1, 23, 59, 59),), (datetime(2024, 1, 2),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert filters.where_given(df, date_column="ts", date_from=date(2024, 1, 1), date_to=date(2024, 1, 1)).count() == 1


def test_optional_tenant(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "tenant string")
    assert filters.for_tenant(df, None).count() == 3 and filters.for_tenant(df, "").count() == 1


def test_pages_are_disjoint_and_clamped(spark):
    df = spark.range(5)
    pages = [[r.id for r in filters.page(df, [F.col("id")], 2, o).collect()] for o in (0, 2, 4)]
    assert pages == [[0, 1], [2, 3], [4]]
    assert filters.page(df, [F.col("id")], 0).count() == 1


def test_group_defects(spark):
    rows = [("a", date(2024, 1, 1), "X", 2), ("a", date(2024, 1, 20), "X", 2), ("b", None, "X", None), ("c", date(2024, 1, 1), "X", 2), ("c", date(2024, 1, 2), "Y ", 2), ("d", None, "X", 3), ("d", None, " X", 3)]
    df = spark.createDataFrame(rows, "g string, day date, place string, total int")
    assert {r.g: r.defect for r in archive.broken_groups(df, "g", "day", "place").collect()} == {"a": "date_span", "b": "single_member", "c": "institutions"}
    assert {r.g: r.orphans for r in archive.group_integrity(df, "g", "total").collect()} == {"a": 0, "b": 1, "c": 0, "d": 1}
    assert {r.g: r.fits for r in archive.group_spans(df, "g", "day").collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_reconcile_counts_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert {r.k: r.state for r in relations.reconcile(a, b, "k", ["v"]).collect()} == {1: "same", 2: "different", 3: "ours_only", 4: "theirs_only"}


def test_hash_dedup_keeps_tenants_apart(spark):  # X27
    df = spark.createDataFrame([("a", "h", 1), ("b", "h", 2), ("a", "h", 3), ("a", None, 4), ("a", None, 5)], "tenant string, md5 string, id int")
    assert [r.id for r in relations.later_copies(df, ["tenant", "md5"], "id").collect()] == [3]


def test_upsert_keeps_old_values_only_where_told(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(1, None, None), (3, "c", 3)], "id int, s string, n int")
    assert sorted(map(tuple, relations.upsert(base, new, "id", ["s"]).collect())) == [(1, "a", None), (2, "b", 2), (3, "c", 3)]
    assert relations.insert_missing(base, new.unionByName(new), ["id"]).count() == 3


def test_lab_series_of_every_tenant(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["lab_series_delta_whole"](spark, d).select("tenant").distinct().count()
    assert got == spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count()


def test_joins_over_every_line(spark):
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    assert registry.QUERIES["double_dim_join_whole"](spark, d).count() == lines.count()
    ids = registry.QUERIES["neighbours_whole"](spark, d).select("other", "id", "confidence")
    assert ids.where("confidence <= 48").count() > 0


def test_version_chain_ends_at_a_cycle(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, previous_id long")
    start = spark.createDataFrame([(2,), (8,)], "id long")
    got = {}
    for r in relations.version_chain(rows, start).orderBy("nth").collect():
        got.setdefault(r.start_id, []).append(r.id)
    assert got[2] == [3, 2, 1] and sorted(got[8]) == [8, 9]


def test_version_chain_has_no_longest_length(spark):
    rows = spark.range(1, 301).select("id", F.expr("nullif(id - 1, 0)").alias("previous_id"))
    got = relations.version_chain(rows, rows.where("id in (1, 150)").select("id")).collect()
    assert sorted((r.start_id, r.nth, r.id) for r in got) == [(s, n, 300 - n) for s in (1, 150) for n in range(300)]


def test_version_chain_takes_every_conversation(spark):
    d = "/root/testdata/sf0.001"
    whole = registry.QUERIES["version_chain_whole"](spark, d)
    assert whole.count() == spark.read.parquet(f"{d}/conversations.parquet").count()


def test_screening(spark):
    people = spark.createDataFrame([("p", 50, "F")], "person string, age int, sex string")
    protocols = spark.createDataFrame([("a", None, 0, 99, 12), ("b", "M", 0, 99, 12), ("c", "F", 40, 60, 1), ("d", None, 40, 60, 1)], "protocol string, sex string, age_from int, age_to int, months int")
    done = spark.createDataFrame([("p", "a", date(2024, 1, 1)), ("p", "c", date(2020, 1, 1))], "person string, protocol string, day date")
    got = {r.protocol: r.status for r in archive.screening(people, protocols, done, F.lit(date(2024, 2, 1))).collect()}
    assert got == {"a": "up_to_date", "c": "overdue", "d": "never_done"}


def test_lab_table_skips_dates(spark):
    df = spark.createDataFrame([("WBC 4.5\nHGB  120 g/l\nPLT 3",), ("1.2.2024 x\nWBC 4.5",), (None,)], "text string")
    assert [r.y for r in df.select(archive.has_lab_table().alias("y")).collect()] == [True, False, False]


def test_manifest_ignores_row_order(spark):
    df = spark.range(100)
    a, b = (archive.manifest(t=x).first() for x in (df, df.orderBy(F.desc("id"))))
    assert a == b and a.rows == 100


BAD_SQL = [
    "delete from t", "insert into t values (1)", "with x as (select * from t) select * from x", "select * from t union all select * from t",
    "select * from other", "drop table t", "select 1; select 2", "select * from parquet.`/root/testdata/sf0.001/events.parquet`", "selec * from t", "",
]


@pytest.mark.parametrize("sql", BAD_SQL)
def test_refused_sql(spark, sql):
    load = lambda s, n: s.createDataFrame([("a", 1), ("b", 2)], "tenant string, n int")
    with pytest.raises(governance.Rejected):
        governance.query(spark, sql, load, ["t"], "a").collect()


def test_what_is_outside_the_views_cannot_be_read(spark):
    rows = spark.createDataFrame([("b", 2)], "tenant string, n int")
    rows.createOrReplaceGlobalTempView("leak")
    load = lambda s, n: s.createDataFrame([("a", 1), ("b", 2)], "tenant string, n int")
    for sql in (
        "select * from global_temp.leak", "select * from t join global_temp.leak", "select * from t, global_temp.leak", "select * from (select * from `global_temp`.`leak`) x",
        "select n from t where n in (select n from global_temp.leak)", "select * from default.saved", "select * from parquet.`/root/testdata/sf0.001/region.parquet`", "select * from other",
        "select try_reflect('java.lang.System', 'getProperty', 'java.version') from t", "select `reflect`('a', 'b') from t", "select java_method('a', 'b') from t", "select system.builtin.reflect('a') from t",
        "select * from range(5)", "select input_file_name() from t", "select current_catalog() from t", "select * from identifier('global_temp.leak')", "select n from t where (n) in (table global_temp.leak)",
    ):
        with pytest.raises(governance.Rejected):
            governance.query(spark, sql, load, ["t"], "a").collect()
    spark.catalog.dropGlobalTempView("leak")
    got = governance.query(spark, "select x.n as `with`, count(*) as c, max(upper(tenant)) as u from t x where n in (1, 2) and x.n = (select max(n) from t) group by x.n", load, ["t"], "a").collect()
    assert [tuple(r) for r in got] == [(1, 1, "A")]


OWN_ROWS = "tenant string, n int"


def own_rows(s, n):
    return s.createDataFrame([("a", 1), ("b", 2)], OWN_ROWS)


@pytest.mark.parametrize(
    "sql",
    [
        "select event -- \r, java_method('java.lang.System','getProperty','user.home') as h\n from t",
        "select r'\\' as a, java_method('java.lang.System','getProperty','user.home') as h, '' as b from t",
        "select n from t -- \r union all select java_method('java.lang.System','getProperty','os.name')\n",
        "select n from t union all select 1 from t", "select n from (select * from t) minus select 2", "with x as (select * from t) select * from x",
        "select 1", "values (1)", "select * from range(3)", "select * from t lateral view explode(array(1)) x", "select * from t version as of 1", "begin select 1; end",
        "select n from t; select 2", "select /*+ broadcast(t) */ * from t", "select session_user() from t", "select current_user from t", "select uuid() from t", "select input_file_name() from t",
        "select transform(n) using 'cat' from t", "select t.n from t, lateral (select 1)", "select max(n) over w from t window w as (order by reflect('a','b'))",
        "select n from t where n in (select java_method('a','b','c') from t)", "select :x from t", "drop view t", "insert into t values (1)",
        "select `java_method`('a','b') from t", "select system.builtin.count(*) from t", "",
    ],
)
def test_governed_sql_reads_plans(spark, sql):
    with pytest.raises(governance.Rejected):
        governance.query(spark, sql, own_rows, ["t"], "a").collect()


def test_governed_sql_runs_what_is_listed(spark):
    run = lambda sql, **k: [tuple(r) for r in governance.query(spark, sql, own_rows, ["t"], "a", **k).collect()]
    assert run("select '-- x', n /* y */ from t -- end") == [("-- x", 1)]
    assert run("select case when n > 1 then 'a' else 'b' end, extract(year from date '2024-01-01'), trim(' a '), -n, n div 2, tenant || 'x' from t where tenant like 'a%' and n between 0 and 3") == [("b", 2024, "a", -1, 0, "ax")]
    assert run("select n, row_number() over (partition by tenant order by n) from t x where exists (select 1 from t u where u.n = x.n)") == [(1, 1)]
    assert run("select '${env:HOME}' from t") == [("${env:HOME}",)]
    assert run("select * from t limit 5", column="nowhere", open_tables=["t"]) == [("a", 1), ("b", 2)]
    for tenant in (None, ""):
        with pytest.raises(governance.Rejected):
            governance.query(spark, "select * from t", own_rows, ["t"], tenant)


def test_governed_sql_ends_in_time(spark):
    many = lambda s, n: s.range(4000).selectExpr("'a' as tenant", "id as n")
    slow = governance.query(spark, "select count(*) from t a, t b, t c where a.n + b.n <> c.n", many, ["t"], "a")
    with pytest.raises(governance.TimedOut):
        governance.answer(slow, seconds=2)
    assert governance.answer(governance.query(spark, "select n from t order by n", many, ["t"], "a", limit=4), 3, 300) == {"columns": ["n"], "rows": [[0], [1], [2]], "row_count": 3, "truncated": True}


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some, null, none = (spark.createDataFrame(x, "j int") for x in ([(1,)], [(1,), (None,)], []))
    assert [[r.k for r in relations.not_in(left, "k", o, "j").collect()] for o in (some, null)] == [[2], []]
    assert {r.k for r in relations.not_in(left, "k", none, "j").collect()} == {1, 2, None}


def test_names_of_others_in_texts(spark):
    texts = spark.createDataFrame([(1, "a", "xx AnnaTest yy"), (2, "b", "anna"), (3, "b", "annatest annatest"), (4, "c", None)], "id int, tenant string, text string")
    names = spark.createDataFrame([("a", "AnnaTest"), ("b", "Bob"), ("c", "yyyy")], "tenant string, name string")
    assert [(r.id, r.named) for r in relations.names_of_others(texts, names).collect()] == [(3, "a")]


def test_parsed_names_and_standard_names(spark):
    parse = lambda c: naming.parsed_name(c, "AnnaTest", ["Alpha", "ELM"], {"ct": "imaging"}, [("blood", "labs")])
    got = {x: one(spark, parse, x) for x in ("202401XX_AnnaTest_ELM_CT_a_b.pdf", "20240102_annatest_x.pdf", "20240102 AnnaTest-elm-Blood-Count.pdf", "2024-1-2 alpha ct  knee.jpg", "nothing", ".hidden", "20240102_AnnaTest.pdf", "20240102 AnnaTest-onlyblood.pdf")}
    r = got["202401XX_AnnaTest_ELM_CT_a_b.pdf"]
    assert (r.form, r.date, r.institution, r.category, r.description) == ("standard", date(2024, 1, 1), "ELM", "imaging", "a_b")
    r = got["20240102 AnnaTest-elm-Blood-Count.pdf"]
    assert (r.form, r.institution, r.category, r.description) == ("bilingual", "ELM", "other", "Count")
    r = got["2024-1-2 alpha ct  knee.jpg"]
    assert (r.form, r.date, r.institution, r.category, r.description, r.extension) == ("legacy", date(2024, 1, 2), "Alpha", "imaging", "knee", ".jpg")
    r = got["nothing"]
    assert (r.form, r.date, r.institution, r.category, r.description, r.extension) == ("legacy", None, None, "other", "nothing", None)
    r = got["20240102 AnnaTest-onlyblood.pdf"]
    assert (r.form, r.institution, r.category, r.description) == ("bilingual", None, "labs", "onlyblood")
    name = lambda c: naming.standard_name(c, parse(c), "AnnaTest")
    assert one(spark, name, "2024-1-2 alpha ct knee.jpg") == "20240102_AnnaTest_Alpha_Imaging_knee.jpg"
    assert one(spark, name, "20240101_AnnaTest_Unknown_Labs_x.pdf") == "20240101_AnnaTest_Unknown_Labs_x.pdf" and one(spark, name, "nothing") == "nothing"
    assert one(spark, lambda c: naming.with_part(c, F.lit(2), F.lit(3)), "a_Part1of9.pdf") == "a_Part2of3.pdf" and one(spark, lambda c: naming.with_part(c, F.lit(1), F.lit(2)), "a") == "a_Part1of2"
    assert one(spark, lambda c: naming.institution_code(c, ["ELM"], {"kestrel": "B"}), " Kestrel ") == "B" and one(spark, lambda c: naming.institution_code(c, ["ELM"], {"kestrel": "B"}), "x") is None


def test_scalars_of_records(spark):
    assert one(spark, lambda c: S.iso_time(c).cast("string"), "2024-01-02T03:04:05Z") == "2024-01-02 03:04:05" and one(spark, lambda c: S.iso_time(c), "soon") is None
    ages = spark.createDataFrame([(date(2000, 2, 29), date(2023, 2, 28)), (date(2000, 2, 29), date(2023, 3, 1)), (date(2000, 2, 29), date(2024, 2, 29))], "b date, t date")
    assert [r.a for r in ages.select(S.age_in_years(F.col("b"), F.col("t")).alias("a")).collect()] == [22, 23, 24]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"x": "y"}), ({"q": "r"}, None)], "o map<string,string>, n map<string,string>")
    assert [r.m for r in maps.select(S.merged_maps(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": "1", "b": None, "c": "3"}, {"x": "y"}, {"q": "r"}]


def test_trash_and_live(spark):
    rows = spark.createDataFrame([(1, None), (2, date(2024, 1, 1))], "id int, deleted_at date")
    assert [r.id for r in filters.live(rows).collect()] == [1] and [r.id for r in filters.trash(rows).collect()] == [2]


def test_folders_without_a_root_have_no_path(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "x"), (5, 4, "y"), (6, 9, "z")], "id long, parent long, name string")
    assert {r.id: (r.path, r.depth) for r in folders.paths(rows).collect()} == {1: ("a", 0), 2: ("a/b", 1), 3: ("a/b/c", 2)}


def test_governed_sql_sees_one_tenant_however_written(spark):
    load = lambda s, n: s.createDataFrame([("a", 1, b"xy"), ("b", 2, b"z")], "tenant string, n int, raw binary")
    got = governance.query(spark, "SELECT n, raw, 'a union b' AS s FROM t x WHERE tenant = 'b' OR 1 = 1", load, ["t"], "a").collect()
    assert [tuple(r) for r in got] == [(1, "<bytes:2>", "a union b")]
    assert governance.query(spark, "select n from t where 'a' = tenant", load, ["t"], "a", limit=0).count() == 1


def test_files(spark, tmp_path):
    for name in ("a.PDF", "b.exe", ".hidden.pdf", "d/.x/c.pdf", "d/e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = files.folder(spark, str(tmp_path)).select("relative")
    assert sorted(r.relative for r in got.collect()) == ["a.PDF", "d/e.txt"]


def test_jsonl_and_blocks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"content": "plain"}\nnot json\n{"content": "[{\\"type\\":\\"text\\",\\"text\\":\\"a\\"},{\\"type\\":\\"img\\"},{\\"text\\":\\"b\\"}]"}\n')
    rows = files.jsonl(spark, str(tmp_path), "content string")
    assert sorted(r.y for r in rows.select(files.content_text("content").alias("y")).collect()) == ["a\nb", "plain"]


def test_stream_sync_and_dedup(spark, tmp_path):
    known = spark.createDataFrame([(1, 10, "m", "n"), (2, 10, "m", "n"), (3, 10, "m", "n")], "id int, modified int, md5 string, name string")
    new = spark.createDataFrame([(1, 10, "q", "z"), (2, 11, "m", "o"), (3, 11, "q", "n"), (4, 1, "m", "n")], "id int, modified int, md5 string, name string")
    assert {r.id: r.state for r in streams.classify(new, known).collect()} == {1: "unchanged", 2: "renamed", 3: "updated", 4: "new"}
    rows = spark.createDataFrame([(i % 3, datetime(2024, 1, 1 + i)) for i in range(6)], "k int, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = streams.arrivals(spark, str(tmp_path / "in"), rows.schema)
    streams.drain(streams.once(source, "k", "30 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert {r.n for r in streams.sessions(rows, "k").collect()} == {1}


def test_rows_that_cannot_be_read_go(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "")], "id string, n string")
    assert {(r.id, r.n) for r in filters.readable(rows, {"n": "bigint"}).collect()} == {("a", 1), ("c", None)}


def test_manifest_comes_back(spark, tmp_path):
    people = spark.createDataFrame([(2, None), (1, "Ann")], "id long, name string")
    empty = spark.createDataFrame([], "id long, name string")
    files.write_manifest(files.manifest_records({"people": (people, ["id"]), "none": (empty, ["id"])}, 1), str(tmp_path / "m"))
    assert [tuple(r) for r in files.manifest_table(spark, str(tmp_path / "m"), "people", people.schema).collect()] == [(1, "Ann")]
    assert files.manifest_table(spark, str(tmp_path / "m"), "none", people.schema).isEmpty()


def test_folders_of_a_listing(spark):
    rows = spark.createDataFrame([("a/b/x.pdf",), ("a/y.pdf",), ("z.pdf",)], "relative string")
    assert {(r.path, r.name) for r in files.folders(rows).collect()} == {("", ""), ("a", "a"), ("a/b", "b")}


def test_export_without_pages_has_folders_only(spark):
    docs = spark.createDataFrame([(1, None, "labs", date(2024, 2, 3)), (2, "r", "labs", None), (3, None, "labs", None)], "id long, remote_id string, category string, document_date date")
    assert {tuple(r) for r in files.export_rows(docs).collect()} == {(1, "labs/2024-02"), (3, "labs/undated")}


def test_qa_report_counts_timeouts_and_errors(spark):
    rows = [(i, "t", "a", datetime(2024, 1, 1), s, 1, 1, 1, None) for i, s in enumerate(["ok", "error", "timeout"])]
    got = {(r.finding, r.call_type, r["count"], r.error_rate) for r in usage.qa_report(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {("timeout", "a", 1, None), ("error_rate", None, 3, 33.3)}
    assert [tuple(r)[2:] for r in usage.qa_report(spark.createDataFrame([], CALLS)).collect()] == [(0, None, None)]
