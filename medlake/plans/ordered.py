"""Registered queries of places, pages and percentiles in groups of any size, with their oracle SQL; registry imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.operators import archive, groups, ordering
from medlake.plans.services import CALLS, call_rows
from medlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


@query("""WITH r AS (SELECT source AS topic, '- [' || lang || '] ' || doc_id AS line, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS nth FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL)
SELECT topic, (nth - 1) // 10 AS page, '## ' || topic || chr(10) || string_agg(line, chr(10) ORDER BY nth) AS markdown FROM r GROUP BY 1, 2""")
def research_library_pages(spark, d):
    rows = table(spark, d, "documents").where("lang is not null and source is not null and doc_id is not null")
    return archive.library_pages(rows.select(F.col("source").alias("topic"), F.col("lang").alias("kind"), F.col("doc_id").alias("ref")), 10)


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS title FROM events UNION ALL SELECT CAST(o_orderdate AS DATE), o_orderpriority FROM orders),
r AS (SELECT strftime(day, '%Y-%m') AS month, '- ' || strftime(day, '%Y-%m-%d') || ' ' || title AS line, row_number() OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY day, title) AS nth FROM e)
SELECT month, (nth - 1) // 50 AS page, count(*) AS lines, string_agg(line, chr(10) ORDER BY nth) AS markdown FROM r GROUP BY 1, 2""")
def month_log_pages(spark, d):
    a = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("title"))
    return archive.month_log_pages(a.unionByName(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"))), 50)


@query("""WITH r AS (SELECT o_custkey AS tenant, 'documents/' || o_orderstatus AS shelf, CAST(o_orderkey AS VARCHAR) AS entry FROM orders
UNION ALL SELECT user_id, 'timeline', strftime(CAST(ts AS DATE), '%Y-%m-%d') || ' ' || event_type FROM events) SELECT tenant, shelf, row_number() OVER (PARTITION BY tenant, shelf ORDER BY entry) AS nth, entry FROM r""")
def document_package_rows(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").cast("string").alias("filename"))
    events = table(spark, d, "events").select(F.col("user_id").alias("tenant"), F.to_date("ts").alias("day"), F.col("event_type").alias("title"))
    return groups.package_rows(docs, events)


@query("""WITH r AS (SELECT lang, source, doc_id, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars NULLS FIRST, doc_id NULLS FIRST) AS nth FROM documents) SELECT * FROM r WHERE n >= 2""")
def duplicate_rows(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "n_chars", "doc_id")
    return ordering.group_rows(docs, ["lang", "source"], ["n_chars", "doc_id"]).select("lang", "source", "doc_id", "n", "nth")


@query("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def price_percentiles(spark, d):
    p = ordering.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query(f"""WITH c AS ({CALLS}) SELECT id, call_type, CAST(sum(coalesce(tokens_in, 0)) OVER (PARTITION BY call_type ORDER BY ts NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_so_far FROM c""")
def running_tokens(spark, d):
    """Tokens that calls of a type have taken so far, with each call."""
    rows = call_rows(spark, d).select("id", "call_type", "ts", "tokens_in")
    return ordering.running(rows, ["call_type"], ["ts", "id"], "tokens_so_far", F.col("tokens_in")).select("id", "call_type", "tokens_so_far")
