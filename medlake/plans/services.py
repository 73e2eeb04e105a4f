"""Registered queries of the table services, with their oracle SQL; registry imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.operators import labs, services
from medlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


LABS_SQL = "SELECT user_id AS tenant, event_type AS parameter, CAST(ts AS DATE) AS lab_date, value, event_id AS id FROM events"
DAILY_SQL = f"daily AS (SELECT tenant, parameter, lab_date, arg_max(value, id) AS value FROM ({LABS_SQL}) GROUP BY ALL)"


def lab_rows(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("tenant"), F.col("event_type").alias("parameter"), F.to_date("ts").alias("lab_date"), "value", F.col("event_id").alias("id")
    )


CALLS = (
    "SELECT event_id AS id, user_id AS tenant, event_type AS call_type, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,"
    " CAST(json_extract(props, '$.k') AS BIGINT) AS tokens_in, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS tokens_out,"
    " CAST(floor(value * 10) AS BIGINT) AS duration_ms, CASE WHEN event_id % 3 = 0 THEN value / 1000 END AS cost_usd FROM events"
)


def call_rows(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("tenant"), F.col("event_type").alias("call_type"), "ts",
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), k.alias("tokens_in"), (k * 2).alias("tokens_out"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 1000).alias("cost_usd"),
    )


@query("""WITH base AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0),
h AS (SELECT o_custkey, count(*) AS held FROM base GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM n)
SELECT * FROM base UNION ALL SELECT r.o_orderkey, r.o_custkey FROM r LEFT JOIN h USING (o_custkey) WHERE nth + coalesce(held, 0) <= 6""")
def insert_quota(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return services.insert_within_quota(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0"), "o_custkey", ["o_orderkey"], 6)


@query("""WITH r AS (SELECT user_id, event_type, event_id, value FROM events), base AS (SELECT * FROM r WHERE event_id % 2 = 0 OR user_id % 3 <> 0), n AS (SELECT * FROM r WHERE event_id % 2 = 1 AND user_id % 3 = 0),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = b.user_id AND l.event_type = b.event_type) UNION ALL SELECT * FROM l""")
def insert_replace(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return services.insert_or_replace(e.where("event_id % 2 = 0 or user_id % 3 <> 0"), e.where("event_id % 2 = 1 and user_id % 3 = 0"), ["user_id", "event_type"], [F.desc("event_id")])


@query("""SELECT user_id, event_id, ts, event_type = 'error' AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""")
def latest_state(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("gone"))
    return services.latest_state(log, ["user_id"], [F.desc("ts"), F.desc("event_id")], "gone")


@query("""WITH r AS (SELECT event_id, ts AS started_at, CASE WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status, CASE WHEN event_type <> 'view' THEN ts END AS finished_at FROM events)
SELECT event_id, started_at, CASE WHEN s THEN 'timeout' ELSE status END AS status, CASE WHEN s THEN TIMESTAMP '2024-01-30 12:00:00' ELSE finished_at END AS finished_at
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '2024-01-30 11:50:00' AS s FROM r)""")
def stale_runs(spark, d):
    view = F.col("event_type") == "view"
    runs = table(spark, d, "events").select("event_id", F.col("ts").alias("started_at"), F.when(view, "running").otherwise("done").alias("status"), F.when(~view, F.col("ts")).alias("finished_at"))
    return services.close_stale(runs, F.expr("timestamp_ntz'2024-01-30 12:00:00'"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'")
def retention(spark, d):
    return services.retain(table(spark, d, "events").select("event_id", "ts"), "ts", F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 10)


@query("""SELECT o_orderkey, coalesce(c_custkey + 1000000, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey""")
def rekey_map(spark, d):
    m = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    return services.rekey(table(spark, d, "orders").select("o_orderkey", "o_custkey"), m, "o_custkey")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) WHERE nth = 1 OR event_type NOT IN ('signup', 'purchase')""")
def funnel_once(spark, d):
    return services.once_only(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", ["signup", "purchase"], ["event_id"])


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '' END AS owner FROM orders),
c AS (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0)
SELECT o_custkey, o_orderkey, CASE WHEN owner <> '' THEN owner ELSE coalesce(c_name, '__unknown__') END AS owner,
 CASE WHEN owner <> '' THEN 'kept' WHEN c_name IS NOT NULL THEN 'recovered' ELSE 'sentinel' END AS how FROM r LEFT JOIN c USING (o_custkey)""")
def orphan_recovery(spark, d):
    k = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k == 0, F.col("o_orderpriority")).when(k == 1, "").alias("owner"))
    c = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
    return services.recover_owners(rows, c, "o_custkey", "owner", "__unknown__")


@query("""WITH p AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS day, l_returnflag AS place, 1 - l_discount AS sure, CASE WHEN l_tax > 0.06 THEN 1 END AS taken FROM lineitem),
g AS (SELECT l_orderkey, min(sure) AS confidence, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS span, count(DISTINCT trim(place)) AS places, count(taken) AS grouped, count(*) AS members FROM p GROUP BY 1)
SELECT *, members >= 2 AND confidence >= 0.92::DOUBLE AND coalesce(span, 0) <= 45 AND places <= 1 AND grouped = 0 AS fits FROM g""")
def group_guard(spark, d):
    p = table(spark, d, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("place"), (1 - F.col("l_discount")).alias("sure"), F.when(F.col("l_tax") > 0.06, 1).alias("taken")
    )
    return services.may_group(p, "l_orderkey", "day", "place", "sure", "taken", 0.92, 45)


@query("""WITH r AS (SELECT l_shipdate, l_returnflag AS kind, CASE l_linestatus WHEN 'O' THEN 'ok' ELSE 'error' END AS status, CASE WHEN l_linenumber > 2 THEN l_suppkey END AS imported, l_partkey AS exported, CAST(l_quantity AS BIGINT) AS duration FROM lineitem)
SELECT kind, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failed, CAST(coalesce(sum(imported), 0) AS BIGINT) AS imported, CAST(coalesce(sum(exported), 0) AS BIGINT) AS exported,
 round(avg(duration), 1) AS avg_duration FROM r GROUP BY 1""")
def pipeline_stats(spark, d):
    r = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("error").alias("status"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("imported"),
        F.col("l_partkey").alias("exported"), F.col("l_quantity").cast("long").alias("duration"),
    )
    return services.pipeline_totals(r, ["kind"])


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS errors FROM n GROUP BY 1""")
def error_histogram(spark, d):
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("error"))
    return services.error_histogram(rows, "user_id", "error").select("user_id", F.to_json("errors").alias("errors"))


@query("""SELECT p_brand, lower(p_type) AS folded, count(*) AS n, array_to_string(list_sort(list(p_partkey)), ',') AS ids FROM part GROUP BY ALL HAVING count(*) >= 2""")
def duplicate_siblings(spark, d):
    found = services.duplicate_siblings(table(spark, d, "part"), "p_brand", "p_type", "p_partkey")
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(f"""WITH {DAILY_SQL}, last AS (SELECT tenant, parameter, arg_max(value, lab_date) AS latest FROM daily GROUP BY ALL),
i(parameter, low, high) AS (VALUES ('view', 20.0::DOUBLE, NULL::DOUBLE), ('click', NULL, 40.0), ('platelets', 100.0, NULL)),
r AS (SELECT x.tenant, i.*, latest FROM (SELECT DISTINCT tenant FROM last) x CROSS JOIN i LEFT JOIN last USING (tenant, parameter))
SELECT tenant, parameter, latest, CASE WHEN latest IS NULL THEN 'missing' WHEN latest < low OR latest > high THEN 'out_of_range' ELSE 'ok' END AS state FROM r""")
def cycle_checklist(spark, d):
    items = spark.createDataFrame([("view", 20.0, None), ("click", None, 40.0), ("platelets", 100.0, None)], "parameter string, low double, high double")
    latest = labs.summary(lab_rows(spark, d)).select("tenant", "parameter", "latest")
    return services.checklist(latest, items).select("tenant", "parameter", "latest", "state")


@query("""WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM events WHERE event_type = 'purchase' GROUP BY 1), l AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_lab FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT f.user_id, first_day, first_lab FROM f LEFT JOIN l USING (user_id) WHERE first_lab IS NULL OR first_lab > first_day""")
def baseline_missing(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("day").alias("lab_day"))
    return services.without_baseline(e, clicks, "user_id", "event_type", "day", "lab_day", "purchase")


@query(f"""WITH {DAILY_SQL}, p AS (SELECT tenant, lab_date AS day, '{{' || string_agg('"' || parameter || '":' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), ',' ORDER BY parameter) || '}}' AS labs FROM daily GROUP BY ALL)
SELECT o_orderkey, o_custkey % 150 AS tenant, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS day, coalesce(labs, '{{}}') AS labs FROM orders
LEFT JOIN p ON p.tenant = o_custkey % 150 AND p.day = DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER)""")
def treatments_with_labs(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("tenant"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("day"))
    values = labs.daily(lab_rows(spark, d)).withColumn("value", F.floor("value").cast("long"))
    return services.with_labs(e, values, "tenant", "day", "lab_date").select("o_orderkey", "tenant", "day", "labs")


@query(f"""WITH l AS ({LABS_SQL}), s AS (SELECT tenant, parameter, lab_date, id % 500 AS document FROM l WHERE id % 7 <> 0), i AS (SELECT id, tenant, parameter, lab_date, (id // 2) % 500 AS document FROM l WHERE id % 7 = 0),
o AS (SELECT tenant, parameter, lab_date, min(document) AS low, max(document) AS high FROM s GROUP BY ALL)
SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.document = i.document AND s.parameter = i.parameter) THEN 'stored' WHEN low <> i.document OR high <> i.document THEN 'collision' ELSE 'new' END AS state
FROM i LEFT JOIN o ON o.tenant = i.tenant AND o.parameter = i.parameter AND o.lab_date = i.lab_date""")
def stored_labs(spark, d):
    rows = lab_rows(spark, d)
    stored = rows.where("id % 7 <> 0").select("tenant", "parameter", "lab_date", (F.col("id") % 500).alias("document"))
    new = rows.where("id % 7 = 0").select("id", "tenant", "parameter", "lab_date", (F.floor(F.col("id") / 2).cast("long") % 500).alias("document"))
    return services.stored_state(new, stored, "document", "parameter", "tenant", "lab_date")
