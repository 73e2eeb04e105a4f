"""Every registered query of the engine on the driver's tables, with its oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlake.functions import scalars as S
from medlake.operators import archive, filters, labs, relations, usage
from medlake.plans import exports, governance, ingest, ordered, services, state, upkeep
from medlake.plans.services import CALLS as CALLS_SQL
from medlake.plans.services import DAILY_SQL, LABS_SQL, call_rows, lab_rows
from medlake.session import shared_dir, table
from medlake.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31)


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their label, where they have one."""
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# -- lab values --------------------------------------------------------------------------


@query(f"""WITH {DAILY_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY tenant, parameter ORDER BY lab_date DESC) AS n FROM daily),
two AS (SELECT tenant, parameter, max(CASE WHEN n = 1 THEN lab_date END) AS latest_date, max(CASE WHEN n = 1 THEN value END) AS latest,
 max(CASE WHEN n = 2 THEN lab_date END) AS previous_date, max(CASE WHEN n = 2 THEN value END) AS previous FROM nth WHERE n <= 2 GROUP BY ALL)
SELECT *, CASE WHEN previous IS NULL THEN 'insufficient_data' WHEN latest > previous * 1.05::DOUBLE THEN 'rising'
 WHEN latest < previous * 0.95::DOUBLE THEN 'falling' ELSE 'stable' END AS trend FROM two""")
def lab_summary(spark, d):
    return labs.summary(lab_rows(spark, d))


@query(f"""WITH l AS ({LABS_SQL}) SELECT tenant, parameter, lab_date, value, id FROM
 (SELECT *, rank() OVER (PARTITION BY tenant, parameter ORDER BY lab_date DESC) AS r FROM l) WHERE r = 1""")
def lab_latest_ties(spark, d):
    return labs.latest_with_ties(lab_rows(spark, d))


@query(f"""WITH {DAILY_SQL}, b AS (SELECT *, lag(value) OVER (PARTITION BY tenant, parameter ORDER BY lab_date) AS before FROM daily)
SELECT tenant, parameter, lab_date, value, round_even(value - before, 4) AS delta,
 CASE WHEN before <> 0 THEN round_even((value - before) / abs(before) * 100, 1) END AS delta_pct FROM b""")
def lab_series_delta(spark, d):
    return labs.deltas(lab_rows(spark, d))


@query(f"""WITH {DAILY_SQL}, a AS (SELECT * FROM daily WHERE lab_date = DATE '2024-01-10'), b AS (SELECT * FROM daily WHERE lab_date = DATE '2024-01-20')
SELECT coalesce(a.tenant, b.tenant) AS tenant, coalesce(a.parameter, b.parameter) AS parameter, a.value AS first, b.value AS second,
 round_even(b.value - a.value, 4) AS change FROM a FULL JOIN b ON a.tenant = b.tenant AND a.parameter = b.parameter""")
def panel_compare(spark, d):
    return labs.compare_panels(lab_rows(spark, d), F.lit(date(2024, 1, 10)), F.lit(date(2024, 1, 20)))


@query(f"""WITH l AS ({LABS_SQL}) SELECT tenant, parameter, max(lab_date) AS lab_date, arg_max(value, (lab_date, id)) AS value
FROM l WHERE lab_date < DATE '2024-01-15' GROUP BY ALL""")
def labs_before_date(spark, d):
    return labs.previous_before(lab_rows(spark, d), F.lit(date(2024, 1, 15)))


THRESHOLDS = [("view", 5.0, 80.0), ("click", 2.0, 60.0), ("purchase", None, 50.0), ("error", 1.0, None), ("glucose", 3.9, 5.6)]


@query(f"""WITH {DAILY_SQL}, last AS (SELECT tenant, parameter, max(lab_date) AS latest_date, arg_max(value, lab_date) AS latest FROM daily GROUP BY ALL),
t(parameter, low, high) AS (VALUES ('view', 5.0::DOUBLE, 80.0::DOUBLE), ('click', 2.0, 60.0), ('purchase', NULL, 50.0), ('error', 1.0, NULL), ('glucose', 3.9, 5.6)),
r AS (SELECT x.tenant, t.parameter, low, high, latest_date, latest FROM (SELECT DISTINCT tenant FROM last) x CROSS JOIN t LEFT JOIN last USING (tenant, parameter))
SELECT tenant, parameter, latest_date, latest, CASE WHEN latest IS NULL THEN 'missing' WHEN latest < low OR latest > high THEN 'red'
 WHEN latest < low * 1.1::DOUBLE OR latest > high * 0.9::DOUBLE THEN 'yellow' ELSE 'green' END AS status FROM r""")
def safety_status(spark, d):
    return labs.safety(lab_rows(spark, d), spark.createDataFrame(THRESHOLDS, "parameter string, low double, high double"))


@query(f"""WITH {DAILY_SQL}, w AS (SELECT tenant, lab_date, max(CASE WHEN parameter = 'view' THEN value END) AS n,
 max(CASE WHEN parameter = 'click' THEN value END) AS p, max(CASE WHEN parameter = 'purchase' THEN value END) AS y FROM daily GROUP BY ALL)
SELECT tenant, lab_date, round(n * p / y, 4) AS immune_index, round(n / y, 4) AS ratio FROM w WHERE y > 0""")
def derived_indices_pivot(spark, d):
    return labs.indices(lab_rows(spark, d), "view", "click", "purchase")


# -- usage -------------------------------------------------------------------------------


@query(f"""WITH c AS ({CALLS_SQL}) SELECT call_type, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 round(avg(duration_ms), 2) AS avg_ms, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') / count(*), 4) AS error_rate FROM c GROUP BY 1""")
def prompt_stats(spark, d):
    return usage.stats(call_rows(spark, d), ["call_type"])


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1")
def prompt_per_day(spark, d):
    return usage.per_day(table(spark, d, "events"))


@query(f"""WITH c AS ({CALLS_SQL}), n AS (SELECT tenant, call_type, count(*) AS k FROM c GROUP BY ALL)
SELECT tenant, call_type AS top, k AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY k DESC, call_type) AS r FROM n) WHERE r = 1""")
def mode_per_group(spark, d):
    return usage.mode(call_rows(spark, d), "tenant", "call_type")


@query(f"""WITH c AS ({CALLS_SQL}), s AS (SELECT tenant, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 CAST(round(sum(CAST(CASE WHEN cost_usd > 0 THEN cost_usd ELSE tokens_in * (0.8::DOUBLE / 1e6) + tokens_out * (4.0::DOUBLE / 1e6) END AS DECIMAL(18,8))), 4) AS DOUBLE) AS billed_usd,
 count(*) FILTER (status = 'error') AS errors, max(ts) AS last_call FROM c GROUP BY 1),
n AS (SELECT tenant, call_type, count(*) AS k FROM c GROUP BY ALL), m AS (SELECT tenant, call_type AS top_type FROM n QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY k DESC, call_type) = 1)
SELECT s.*, coalesce(c_name, '') AS name, top_type FROM (SELECT * FROM s ORDER BY billed_usd DESC, calls DESC, tenant LIMIT 20) s
LEFT JOIN customer ON c_custkey = tenant LEFT JOIN m USING (tenant)""")
def leaderboard(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("name"))
    return usage.leaderboard(call_rows(spark, d), names, 20)


@query(f"""WITH c AS ({CALLS_SQL}) SELECT call_type, count(*) AS calls, round(avg(duration_ms), 2) AS avg_ms, max(ts) AS last_call,
 count(*) FILTER (status = 'error') AS errors FROM c GROUP BY 1 ORDER BY calls DESC, call_type LIMIT 20""")
def tool_top20(spark, d):
    return usage.top_tools(call_rows(spark, d))


@query("SELECT count(DISTINCT event_type) AS tools, count(DISTINCT user_id) AS tenants FROM events")
def distinct_tools(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("event_type").alias("tools"), F.count_distinct("user_id").alias("tenants"))


@query(f"""WITH c AS ({CALLS_SQL}), x AS (SELECT call_type, duration_ms FROM c UNION ALL SELECT '_overall', duration_ms FROM c)
SELECT call_type, count(*) AS calls, CAST(round_even(quantile_cont(duration_ms, 0.5), 0) AS BIGINT) AS p50,
 CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS BIGINT) AS p95, CAST(round_even(quantile_cont(duration_ms, 0.99), 0) AS BIGINT) AS p99
FROM x WHERE duration_ms IS NOT NULL GROUP BY 1""")
def latency_percentiles(spark, d):
    return usage.percentiles(call_rows(spark, d))


TIERS = [("gold", None), ("silver", 0.05), ("bronze", 0.01)]


@query(f"""WITH c AS ({CALLS_SQL}), t AS (SELECT c_custkey AS tenant, CASE c_custkey % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS tier FROM customer),
caps(tier, cap_eur) AS (VALUES ('gold', NULL::DOUBLE), ('silver', 0.05), ('bronze', 0.01)),
s AS (SELECT tenant, CAST(sum(CAST(tokens_in * (0.8::DOUBLE / 1e6) + tokens_out * (4.0::DOUBLE / 1e6) AS DECIMAL(18,8))) AS DOUBLE) * 0.92::DOUBLE AS eur FROM c WHERE status = 'ok' GROUP BY 1)
SELECT t.tenant, tier, round(coalesce(eur, 0), 4) AS spent_eur, cap_eur, cap_eur IS NULL OR round(coalesce(eur, 0), 4) < cap_eur AS allowed
FROM t LEFT JOIN caps USING (tier) LEFT JOIN s USING (tenant)""")
def budget_gate(spark, d):
    k = F.col("c_custkey") % 3
    tenants = table(spark, d, "customer").select(F.col("c_custkey").alias("tenant"), F.when(k == 0, "gold").when(k == 1, "silver").otherwise("bronze").alias("tier"))
    return usage.budget(call_rows(spark, d), tenants, spark.createDataFrame(TIERS, "tier string, cap_eur double"))


@query(f"""WITH c AS ({CALLS_SQL}), r AS (SELECT call_type, count(*) AS n, count(*) FILTER (status = 'error') AS errors, avg(duration_ms) AS ms FROM c GROUP BY 1)
SELECT 'recurring_error' AS finding, call_type, errors AS count, CASE WHEN errors >= 5 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE errors >= 2
UNION ALL SELECT 'slow', call_type, n, 'medium' FROM r WHERE ms > 90 AND n >= 3""")
def qa_findings(spark, d):
    return usage.findings(call_rows(spark, d), slow_ms=90)


@query("""SELECT count(*) FILTER (CAST(ts AS DATE) >= DATE '2024-01-24') AS last_7_days, count(*) FILTER (CAST(ts AS DATE) >= DATE '2024-01-01') AS last_30_days,
 min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events""")
def recency_counts(spark, d):
    return usage.recency(table(spark, d, "events"), "ts", F.lit(AS_OF.date()))


@query("SELECT 'events' AS source, max(ts) AS last FROM events UNION ALL SELECT 'orders', max(o_orderdate) FROM orders")
def last_arrival(spark, d):
    return usage.last_arrivals(events=table(spark, d, "events"), orders=table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")))


@query(f"""WITH c AS ({CALLS_SQL}) SELECT tokens_in, max(id) AS id, arg_max(ts, id) AS ts FROM c
WHERE status = 'ok' AND ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1""")
def cache_lookup(spark, d):
    return usage.cached(call_rows(spark, d), "tokens_in", F.lit(AS_OF).cast("timestamp_ntz"))


@query("""SELECT date_trunc('hour', ts) AS hour, user_id AS tenant, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY ALL HAVING count(*) > 1""")
def busy_hours(spark, d):
    rows = filters.last_days(table(spark, d, "events"), "ts", AS_OF, 2)
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("user_id").alias("tenant")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# -- aggregates over orders and lines ----------------------------------------------------


@query("""SELECT l_returnflag AS tool, l_linestatus AS status, count(*) AS calls, round(avg(CAST(l_quantity AS BIGINT)), 2) AS avg_ms FROM lineitem GROUP BY ALL""")
def activity_stats_2key(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("status"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.col("l_quantity").cast("long")), 2).alias("avg_ms"))


@query("""WITH r AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS b FROM orders)
SELECT status, count(*) AS runs, count(*) FILTER (a > 100) AS ok, round(avg(a), 1) AS avg_a, max(b) AS max_b, CAST(sum(a + b) AS BIGINT) AS total FROM r GROUP BY 1""")
def sync_summary_null_sum(spark, d):
    a, b = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), a.alias("a"), b.alias("b"))
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("a") > 100).alias("ok"), F.round(F.avg("a"), 1).alias("avg_a"), F.max("b").alias("max_b"), F.sum(F.col("a") + F.col("b")).alias("total")
    )


@query("""SELECT l_orderkey, max(CASE WHEN l_orderkey % 11 <> 0 THEN l_linenumber END) AS declared, count(*) AS parts,
 CAST(CASE WHEN max(CASE WHEN l_orderkey % 11 <> 0 THEN l_linenumber END) IS NULL THEN count(*) ELSE abs(max(CASE WHEN l_orderkey % 11 <> 0 THEN l_linenumber END) - count(*)) END AS BIGINT) AS orphans
FROM lineitem GROUP BY 1""")
def group_integrity(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_linenumber")).alias("total"))
    return archive.group_integrity(rows, "l_orderkey", "total")


@query("""SELECT l_orderkey, CAST(date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS INTEGER) AS span, count(l_shipdate) AS known,
 count(l_shipdate) < 2 OR date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) <= 30 AS fits FROM lineitem GROUP BY 1""")
def group_date_span(spark, d):
    return archive.group_spans(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", 30)


@query("""WITH g AS (SELECT l_orderkey, count(*) AS members, CAST(date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS INTEGER) AS span,
 count(DISTINCT trim(l_returnflag)) AS places FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT *, CASE WHEN members = 1 THEN 'single_member' WHEN span > 60 THEN 'date_span' WHEN places > 1 THEN 'institutions' END AS defect FROM g) WHERE defect IS NOT NULL""")
def broken_groups(spark, d):
    return archive.broken_groups(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", "l_returnflag", 60)


@query("""SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags, count(*) AS n FROM lineitem GROUP BY 1""")
def listagg_per_group(spark, d):
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(x, lambda r: r["l_returnflag"]), ", ").alias("flags"), F.count(F.lit(1)).alias("n"))


@query("""SELECT s.o_orderkey, s.o_custkey, s.o_totalprice, c_mktsegment AS tenant FROM orders s JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def tenant_scoped_join(spark, d):
    owners = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("tenant"))
    return relations.scoped(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), owners, "o_custkey", "c_custkey", "BUILDING")


@query("""SELECT l_suppkey AS source, l_partkey AS target, l_orderkey, s_name AS source_name, p_name AS target_name FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""")
def double_dim_join(spark, d):
    return _named_ends(spark, d, table(spark, d, "lineitem"))


def _named_ends(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    links = lines.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_orderkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return relations.both_ends(links, s, "id", ["name"], p).select("source", "target", "l_orderkey", "source_name", "target_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_not_in(spark, d):
    return relations.not_in(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("""SELECT p_partkey, p_brand AS tenant, named, name FROM part JOIN (SELECT DISTINCT p_brand AS named, lower(split_part(p_name, ' ', 2)) AS name FROM part) x ON contains(lower(p_name), name) AND named <> p_brand WHERE length(name) >= 4""")
def theta_contains(spark, d):
    parts = table(spark, d, "part")
    names = parts.select(F.col("p_brand").alias("tenant"), F.split("p_name", " ")[1].alias("name")).distinct()
    texts = parts.select("p_partkey", F.col("p_brand").alias("tenant"), F.col("p_name").alias("text"))
    return relations.names_of_others(texts, names).select("p_partkey", "tenant", "named", "name")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'
 AND contains(lower(o_orderpriority), 'high') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""")
def dynamic_filter_page(spark, d):
    rows = filters.where_given(
        table(spark, d, "orders"), {"o_orderstatus": "F", "o_custkey": None}, "o_orderdate", date(1996, 3, 1), date(1996, 5, 31), "HIGH", ("o_orderpriority",)
    )
    return filters.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 20).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def set_difference(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderdate < timestamp_ntz'1997-01-01'").select("o_custkey").subtract(o.where("o_orderdate >= timestamp_ntz'1997-01-01'").select("o_custkey"))


@query("""WITH base AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 4 <> 0),
ch AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN upper(c_name) END AS name, round(c_acctbal * 2, 2) AS balance FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(b.id, c.id) AS id, CASE WHEN c.id IS NOT NULL THEN coalesce(c.name, b.name) ELSE b.name END AS name,
 CASE WHEN c.id IS NOT NULL THEN c.balance ELSE b.balance END AS balance FROM base b FULL JOIN ch c ON b.id = c.id""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer")
    base = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.upper("c_name")).alias("name"), F.round(F.col("c_acctbal") * 2, 2).alias("balance")
    )
    return relations.upsert(base, new, "id", ["name"])


@query("""SELECT id, to_json(changed_fields)::VARCHAR AS changed FROM (SELECT c_custkey AS id, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'name' END, CASE WHEN c_custkey % 3 = 0 THEN 'segment' END], lambda x: x IS NOT NULL) AS changed_fields
FROM customer) WHERE len(changed_fields) > 0""")
def audit_changes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.select("id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 3 != 0, F.col("segment")).alias("segment"))
    return relations.changes(c, new, "id", ["name", "segment"]).select("id", F.to_json("changed_fields").alias("changed"))


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')
SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)""")
def soft_delete_purge(spark, d):
    o = table(spark, d, "orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kept = relations.purge(o, [lines], "o_orderkey", "deleted_at", F.expr("timestamp_ntz'1996-01-01'"))
    one, two = (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for df, name in zip(kept, ("orders", "lineitem"), strict=True))
    return one.unionByName(two)


@query("""WITH x AS (SELECT o_custkey, list(CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1)
SELECT o_custkey, list_min(list_filter(days, lambda v: v BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')) AS earliest,
 list_max(list_filter(days, lambda v: v BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')) AS newest FROM x""")
def date_repair_array(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.to_date("o_orderdate")).alias("days"))
    bounds = F.lit(date(1996, 1, 1)), F.lit(date(1998, 12, 31))
    return x.select(
        "o_custkey", archive.date_from_candidates(F.col("days"), *bounds).alias("earliest"), archive.date_from_candidates(F.col("days"), *bounds, newest=True).alias("newest")
    )


PROTOCOLS = [("F", "F", 20, 60, 12), ("O", None, 0, 99, 24), ("P", "M", 40, 99, 6)]


@query("""WITH p AS (SELECT c_custkey AS person, CAST(20 + c_custkey % 60 AS INTEGER) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM customer),
pr(protocol, for_sex, age_from, age_to, months) AS (VALUES ('F', 'F', 20, 60, 12), ('O', NULL, 0, 99, 24), ('P', 'M', 40, 99, 6)),
l AS (SELECT o_custkey AS person, o_orderstatus AS protocol, max(CAST(o_orderdate AS DATE)) AS last_done FROM orders GROUP BY ALL),
r AS (SELECT person, protocol, last_done, last_done + CAST(months * 30 AS INTEGER) AS due FROM p JOIN pr ON (for_sex IS NULL OR for_sex = sex) AND age BETWEEN age_from AND age_to LEFT JOIN l USING (person, protocol))
SELECT *, CASE WHEN last_done IS NULL THEN 'never_done' WHEN due < DATE '2000-01-01' THEN 'overdue' WHEN due <= DATE '2000-03-31' THEN 'due_soon' ELSE 'up_to_date' END AS status FROM r""")
def screening_compliance(spark, d):
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("person"), (20 + F.col("c_custkey") % 60).cast("int").alias("age"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex")
    )
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("protocol"), F.to_date("o_orderdate").alias("day"))
    protocols = spark.createDataFrame(PROTOCOLS, "protocol string, sex string, age_from int, age_to int, months int")
    return archive.screening(people, protocols, done, F.lit(date(2000, 1, 1)))


# -- documents, pages and conversations --------------------------------------------------


@query("""SELECT sha256(text) AS hash, lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_docs(spark, d):
    rows = table(spark, d, "documents").withColumn("hash", F.sha2("text", 256))
    return relations.large_groups(rows, ["hash", "lang"], "doc_id")


@query("""SELECT doc_id, source, lang, kept FROM (SELECT *, min(doc_id) OVER (PARTITION BY source, lang, text) AS kept FROM documents) WHERE doc_id <> kept""")
def hash_dedup(spark, d):
    rows = table(spark, d, "documents").withColumn("hash", F.sha2("text", 256)).select("doc_id", "source", "lang", "hash")
    return relations.later_copies(rows, ["source", "lang", "hash"], "doc_id").drop("hash")


FLAGS_SQL = """f AS (SELECT doc_id, lang, source, n_chars, coalesce(text <> '', false) AS has_text, quality IS NOT NULL AS has_review, coalesce(n_chars >= 500, false) AS long_enough
 FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)), g AS (SELECT *, has_text AND has_review AND long_enough AS complete FROM f)"""


@query(f"""WITH {FLAGS_SQL} SELECT lang, count(*) AS documents, count(*) FILTER (has_text) AS n_has_text, count(*) FILTER (has_review) AS n_has_review,
 count(*) FILTER (long_enough) AS n_long_enough, count(*) FILTER (complete) AS n_complete FROM g GROUP BY 1""")
def doc_health(spark, d):
    return archive.health(reviewed(spark, d), ["lang"])


@query(f"""WITH {FLAGS_SQL} SELECT * FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT has_text THEN 'no_text' END, CASE WHEN NOT has_review THEN 'no_review' END, CASE WHEN NOT long_enough THEN 'too_short' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g)
WHERE reasons <> ''""")
def gap_audit(spark, d):
    return archive.gaps(reviewed(spark, d)).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {FLAGS_SQL} SELECT doc_id, source, complete FROM g WHERE NOT complete AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25""")
def matrix_page(spark, d):
    rows = archive.flags(reviewed(spark, d)).where(~F.col("complete") & (F.col("lang") == "en"))
    return filters.page(rows, [F.desc("n_chars"), F.col("doc_id")], 25, 25).select("doc_id", "source", "complete")


@query("""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\p{L}[\\p{L} .%-]*\\s+[-+]?\\d+([.,]\\d+)?\\b') AND NOT regexp_matches(x, '^\\s*\\d{1,4}[.\\-/]\\d{1,2}[.\\-/]'))) AS INTEGER) AS n FROM documents
WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\p{L}[\\p{L} .%-]*\\s+[-+]?\\d+([.,]\\d+)?\\b'))) >= 1""")
def lab_table_detector(spark, d):
    return table(spark, d, "documents").select("doc_id", archive.lab_lines().alias("n")).where("n >= 1")


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS title, substr(text, 1, 510) AS content FROM documents""")
def truncated_listing(spark, d):
    return table(spark, d, "documents").select("doc_id", S.shortened(F.col("text"), 40).alias("title"), F.substring("text", 1, 510).alias("content"))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(lower(role || ' ' || CAST(turn AS VARCHAR))), '\\s+')) AS tag FROM conversations)
GROUP BY 1 ORDER BY n DESC, tag LIMIT 20""")
def tag_topn(spark, d):
    c = table(spark, d, "conversations")
    return archive.tag_counts(c, F.split(F.trim(F.lower(F.concat_ws(" ", "role", F.col("turn").cast("string")))), "\\s+"), 20)


@query("""WITH r AS (SELECT o_orderstatus AS kind, o_orderpriority AS who, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT 'kind' AS dimension, kind AS key, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'who', who, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'month', month, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM r""")
def conv_stats_grouping_sets(spark, d):
    return archive.conversation_stats(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_orderdate")


@query("""SELECT p_partkey, p_name, p_brand, CAST(CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'wid') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'red') OR contains(lower(p_brand), 'wid') THEN 3 ELSE 0 END
 + CASE WHEN contains(lower(p_type), 'red') OR contains(lower(p_type), 'wid') THEN 1 ELSE 0 END AS INTEGER) AS score FROM part
WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) AND (contains(lower(p_name), 'wid') OR contains(lower(p_brand), 'wid') OR contains(lower(p_type), 'wid'))
ORDER BY score DESC, p_partkey LIMIT 30""")
def weighted_search(spark, d):
    rows = archive.search(table(spark, d, "part"), "RED wid", {"p_name": 3, "p_brand": 3, "p_type": 1}, [F.col("p_partkey")], 30)
    return rows.select("p_partkey", "p_name", "p_brand", "score")


@query("""SELECT doc_id, lang FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' of the ')""")
def phrase_search(spark, d):
    return archive.phrase(table(spark, d, "documents"), '"Of the"', ["text"]).select("doc_id", "lang")


RULES = [("widget", "device"), ("bolt", "fastener"), ("ring", "fastener"), ("gear", "drive")]


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'widget') THEN 'device' WHEN contains(lower(p_name), 'bolt') THEN 'fastener' WHEN contains(lower(p_name), 'ring') THEN 'fastener'
 WHEN contains(lower(p_name), 'gear') THEN 'drive' ELSE 'other' END AS category FROM part""")
def keyword_classifier(spark, d):
    return archive.classify(table(spark, d, "part"), "p_name", RULES, "other").select("p_partkey", "category")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, coalesce(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), ''), '1') AS page FROM pages""")
def url_parse(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"),
        F.coalesce(F.try_parse_url("url", F.lit("QUERY"), F.lit("page")), F.lit("1")).alias("page"),
    )


@query("""WITH a AS (SELECT doc_id, n_chars % 2 AS q FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, quality AS q FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.q AS our_q, CAST(b.q AS BIGINT) AS their_q, CASE WHEN b.doc_id IS NULL THEN 'ours_only' WHEN a.doc_id IS NULL THEN 'theirs_only'
 WHEN a.q IS NOT DISTINCT FROM b.q THEN 'same' ELSE 'different' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def reconcile_full_outer(spark, d):
    ours = table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", (F.col("n_chars") % 2).alias("q"))
    return relations.reconcile(ours, table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("q")), "doc_id", ["q"])


@query("SELECT d.doc_id, d.source, coalesce(CAST(l.toxic AS VARCHAR), '__unknown__') AS owner FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def orphan_left_join(spark, d):
    return reviewed(spark, d).select("doc_id", "source", F.coalesce(F.col("toxic").cast("string"), F.lit("__unknown__")).alias("owner"))


@query("""WITH lines AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS day, string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS s FROM lineitem GROUP BY 1)
SELECT 'orders' AS source, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS title, o_orderstatus AS summary, CAST(o_orderkey AS VARCHAR) AS ref FROM orders
UNION ALL SELECT 'events', CAST(ts AS DATE), event_type, props, CAST(event_id AS VARCHAR) FROM events
UNION ALL SELECT 'labs', day, 'results', s, CAST(l_orderkey AS VARCHAR) FROM lines""")
def journey_timeline(spark, d):
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("day"), F.array_join(F.transform(x, lambda r: r["l_returnflag"]), ", ").alias("summary"))
    return archive.timeline(
        orders=table(spark, d, "orders").select(
            F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"), F.col("o_orderkey").cast("string").alias("ref")
        ),
        events=table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("title"), F.col("props").alias("summary"), F.col("event_id").cast("string").alias("ref")),
        labs=lines.select("day", F.lit("results").alias("title"), "summary", F.col("l_orderkey").cast("string").alias("ref")),
    )


@query("""SELECT strftime(day, '%Y-%m') AS month, string_agg('- ' || strftime(day, '%Y-%m-%d') || ' ' || title, chr(10) ORDER BY day, title) AS markdown
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type AS title FROM events) GROUP BY 1""")
def month_log(spark, d):
    return archive.month_log(table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("title")).distinct())


def _turn_chain(c: DataFrame) -> DataFrame:
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("previous_id"))
    return relations.version_chain(rows, rows.where("previous_id is null"))


@query("""SELECT a.conv_id * 1000 + a.turn AS start_id, b.conv_id * 1000 + b.turn AS id, CAST(m.t - b.turn AS INTEGER) AS nth FROM conversations a
JOIN (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1) m USING (conv_id) JOIN conversations b USING (conv_id) WHERE a.turn = 0""")
def version_chain_recursive(spark, d):
    return _turn_chain(table(spark, d, "conversations"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target, 'supplies' AS relationship, l_quantity AS confidence FROM lineitem)
SELECT source AS id, target AS other, relationship, confidence FROM e WHERE source <> target UNION ALL SELECT target, source, relationship, confidence FROM e WHERE source <> target""")
def neighbours(spark, d):
    return _supplies(table(spark, d, "lineitem"))


def _supplies(lines: DataFrame) -> DataFrame:
    e = lines.select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("supplies").alias("relationship"), F.col("l_quantity").alias("confidence")
    ).distinct()
    return relations.neighbours(e)


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE user_id = 7 GROUP BY 1""")
def governed_sql(spark, d):
    def load(own: SparkSession, name: str) -> DataFrame:
        return table(own, d, name).withColumnRenamed("user_id", "tenant")

    sql = "select event_type, count(*) as n, sum(cast(get_json_object(props, '$.k') as bigint)) as k from events group by event_type"
    return governance.query(spark, sql, load, ["events"], 7)


# -- streams -----------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], name: str, mode: str) -> DataFrame:
    """What a stream over the events table holds once all has arrived, as a table in the shared folder; no row passes through the driver."""
    schema = table(spark, d, "events").schema
    events = streams.arrivals(spark, f"{d}/events.parquet*", schema)
    out = make(events.withColumn("ts", F.col("ts").cast("timestamp")))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        streams.drain(out, f"{path}/rows", f"{path}/log").awaitTermination()
    else:  # every batch holds the whole result
        streams.each_batch(out, lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"), f"{path}/log", mode).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1")
def stream_daily_counts(spark, d):
    return _streamed(spark, d, streams.daily_counts, "daily", "complete")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, d):
    return _streamed(spark, d, lambda e: streams.once(e.select("user_id", "ts"), "user_id", "60 days").select("user_id"), "dedup", "append")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('purchase', 'error')")
def stream_funnel_once(spark, d):
    return _streamed(spark, d, lambda e: streams.once_for_ever(e, ["user_id"], "event_type", ["purchase", "error"]).select("user_id", "event_type"), "funnel", "append")


@query("SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS prompt FROM events WHERE event_type <> 'error'")
def stream_cache_misses(spark, d):
    """The prompts that had to be answered, all events being within the time to live."""
    prompt, status = F.get_json_object("props", "$.k").cast("long"), F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return _streamed(spark, d, lambda e: streams.cache_misses(e.select("ts", prompt.alias("prompt"), status.alias("status")), "prompt", "60 days").select("prompt"), "misses", "append")


# -- beyond the archive's own: plain generalisations ---------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("""SELECT user_id, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def rolling_day_counts(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.count(F.lit(1)).over(w).alias("last_day"))


# -- table services ------------------------------------------------------------------------

QUERIES.update(services.QUERIES)
ORACLES.update(services.ORACLES)

# -- naming, hygiene, groups and further reports -------------------------------------------

QUERIES.update(upkeep.QUERIES)
ORACLES.update(upkeep.ORACLES)

# -- exports, usage over a span of days, readable rows ---------------------------------------

QUERIES.update(exports.QUERIES)
ORACLES.update(exports.ORACLES)

# -- streams with state, stored tables, indexes, trees, dumps, JSON ---------------------------

QUERIES.update(state.QUERIES)
ORACLES.update(state.ORACLES)

# -- sources, inserts, text scalars and stored reports -----------------------------------------

QUERIES.update(ingest.QUERIES)
ORACLES.update(ingest.ORACLES)

# -- places, pages and percentiles of groups of any size ----------------------------------------

QUERIES.update(ordered.QUERIES)
ORACLES.update(ordered.ORACLES)

# -- further names of queries that read their whole tables --------------------------------------

for _name, _whole in {"lab_series_delta_whole": lab_series_delta, "double_dim_join_whole": double_dim_join, "version_chain_whole": version_chain_recursive, "neighbours_whole": neighbours}.items():
    QUERIES[_name], ORACLES[_name] = _whole, ORACLES[_whole.__name__]
