"""Registered queries of exports, usage over a span of days and readable rows, with their oracle SQL; registry imports them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from medlake.operators import filters, services, usage
from medlake.plans.upkeep import CALLS_SQL, call_rows
from medlake.session import shared_dir, table
from medlake.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


NOW_SQL = "TIMESTAMP '2024-01-30 12:00:00'"


def now():
    return F.expr("timestamp_ntz'2024-01-30 12:00:00'")


@query(f"""WITH {CALLS_SQL}, t AS (SELECT call_type, count(*) AS calls, round(avg(duration_ms), 2) AS avg_ms, max(ts) AS last_call, count(*) FILTER (status = 'error') AS errors
 FROM c WHERE ts >= {NOW_SQL} - INTERVAL 14 DAY GROUP BY 1 ORDER BY calls DESC, call_type LIMIT 3) SELECT *, CAST(sum(calls) OVER () AS BIGINT) AS total_calls FROM t""")
def tool_usage(spark, d):
    return usage.tool_usage(call_rows(spark, d), now(), 14, 3)


@query(f"""WITH {CALLS_SQL}, t AS (SELECT c_custkey AS tenant, CASE c_custkey % 2 WHEN 0 THEN 'gold' ELSE 'bronze' END AS tier FROM customer), caps(tier, cap_eur) AS (VALUES ('gold', NULL::DOUBLE), ('bronze', 0.01)),
s AS (SELECT tenant, CAST(sum(CAST(tokens_in * (0.8::DOUBLE / 1e6) + tokens_out * (4.0::DOUBLE / 1e6) AS DECIMAL(18,8))) AS DOUBLE) * 0.92::DOUBLE AS eur FROM c WHERE status = 'ok' AND ts >= {NOW_SQL} - INTERVAL 10 DAY GROUP BY 1)
SELECT t.tenant, tier, round(coalesce(eur, 0), 4) AS spent_eur, cap_eur, cap_eur IS NULL OR round(coalesce(eur, 0), 4) < cap_eur AS allowed FROM t LEFT JOIN caps USING (tier) LEFT JOIN s USING (tenant)""")
def budget_of_days(spark, d):
    tenants = table(spark, d, "customer").select(F.col("c_custkey").alias("tenant"), F.when(F.col("c_custkey") % 2 == 0, "gold").otherwise("bronze").alias("tier"))
    caps = spark.createDataFrame([("gold", None), ("bronze", 0.01)], "tier string, cap_eur double")
    return usage.budget(usage.recent(call_rows(spark, d), now(), 10), tenants, caps)


@query(f"""WITH {CALLS_SQL}, r AS (SELECT call_type, duration_ms, CASE WHEN id % 50 = 0 THEN 'timeout' ELSE status END AS status FROM c WHERE ts >= {NOW_SQL} - INTERVAL 7 DAY),
g AS (SELECT call_type, count(*) AS n, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'timeout') AS timeouts, avg(duration_ms) AS ms FROM r GROUP BY 1)
SELECT 'recurring_error' AS finding, call_type, errors AS count, CASE WHEN errors >= 5 THEN 'high' ELSE 'medium' END AS severity, NULL::DOUBLE AS error_rate FROM g WHERE errors >= 2
UNION ALL SELECT 'slow', call_type, n, 'medium', NULL FROM g WHERE ms > 90 AND n >= 3 UNION ALL SELECT 'timeout', call_type, timeouts, 'high', NULL FROM g WHERE timeouts > 0
UNION ALL SELECT 'error_rate', NULL, count(*), NULL, round(count(*) FILTER (status = 'error') * 100.0::DOUBLE / count(*), 1) FROM r""")
def qa_report(spark, d):
    calls = call_rows(spark, d).withColumn("status", F.when(F.col("id") % 50 == 0, "timeout").otherwise(F.col("status")))
    return usage.qa_report(usage.recent(calls, now(), 7), slow_ms=90)


@query("""WITH r AS (SELECT CASE l_linestatus WHEN 'O' THEN 'ok' ELSE 'error' END AS status, CASE WHEN l_linenumber > 2 THEN l_suppkey END AS imported, l_partkey AS exported, CAST(l_quantity AS BIGINT) AS duration
 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01' - INTERVAL 30 DAY),
t AS (SELECT count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failed, CAST(coalesce(sum(imported), 0) AS BIGINT) AS imported,
 CAST(coalesce(sum(exported), 0) AS BIGINT) AS exported, round(avg(duration), 1) AS avg_duration FROM r)
SELECT t.*, (SELECT count(*) FROM documents WHERE n_chars >= 500) AS done, (SELECT count(*) FROM documents WHERE n_chars IS NULL OR n_chars < 500) AS pending FROM t""")
def pipeline_of_days(spark, d):
    runs = table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("ts"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("error").alias("status"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("imported"),
        F.col("l_partkey").alias("exported"), F.col("l_quantity").cast("long").alias("duration"),
    )
    return services.pipeline_report(usage.recent(runs, F.expr("timestamp_ntz'1998-07-01 00:00:00'"), 30), table(spark, d, "documents"), F.col("n_chars") >= 500)


def listed(spark, d):
    """The five tables of the manifest, with the order in which their rows are listed."""
    return {
        "customers": (table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]), "nations": (table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]),
        "orders": (table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"]), "parts": (table(spark, d, "part").select("p_partkey", "p_brand"), ["p_partkey"]),
        "regions": (table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]),
    }


MANIFEST_SQL = " UNION ALL ".join(
    f"(SELECT '{name}' AS name, CAST(to_json({{'{key}': {key}, '{value}': {value}}}) AS VARCHAR) AS record FROM {t} ORDER BY {key} LIMIT 200)"
    for name, t, key, value in (
        ("customers", "customer", "c_custkey", "c_name"), ("nations", "nation", "n_nationkey", "n_name"), ("orders", "orders", "o_orderkey", "o_orderstatus"),
        ("parts", "part", "p_partkey", "p_brand"), ("regions", "region", "r_regionkey", "r_name"),
    )
)


@query(MANIFEST_SQL)
def manifest_export(spark, d):
    return files.manifest_records(listed(spark, d))


@query("SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 200")
def manifest_import(spark, d):
    """What comes back of a table once the manifest was written and read again."""
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    files.write_manifest(files.manifest_records(listed(spark, d)), path)
    return files.manifest_table(spark, path, "parts", table(spark, d, "part").select("p_partkey", "p_brand").schema)


@query("""WITH p AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1)
SELECT doc_id AS id, source || '/' || coalesce(CASE WHEN doc_id % 4 <> 0 THEN '2024-0' || (doc_id % 9 + 1) END, 'undated') AS folder, p.text FROM documents LEFT JOIN p ON p.id = doc_id WHERE doc_id % 3 <> 0""")
def folder_export(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("r"), "doc_id")).alias("remote_id"), F.col("source").alias("category"),
        F.when(F.col("doc_id") % 4 != 0, F.make_date(F.lit(2024), (F.col("doc_id") % 9 + 1).cast("int"), F.lit(5))).alias("document_date"),
    )
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page_number"), "text")
    return files.export_rows(docs, pages)


@query("SELECT event_id, CAST(CASE WHEN event_id % 7 <> 1 THEN event_id END AS BIGINT) AS amount FROM events WHERE event_id % 7 <> 0")
def readable_rows(spark, d):
    """Rows whose amount is no number are left out; a missing amount is none, and stays."""
    raw = F.when(F.col("event_id") % 7 == 0, "broken").when(F.col("event_id") % 7 != 1, F.col("event_id").cast("string"))
    return filters.readable(table(spark, d, "events").select("event_id", raw.alias("amount")), {"amount": "bigint"})
