"""Usage, cost and latency of calls.

Calls are (tenant, call_type, ts, status, tokens_in, tokens_out, duration_ms, cost_usd, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.functions.scalars import EUR, cost_usd
from medlake.session import if_few


def errors() -> Column:
    return F.count_if(F.col("status") == "error")


def total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def money(c: Column) -> Column:
    """Sums of money in decimals, so that their order does not matter."""
    return F.sum(c.cast("decimal(18,8)"))


def stats(calls: DataFrame, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return calls.groupBy(*by).agg(
        n.alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"),
        F.round(F.avg("duration_ms"), 2).alias("avg_ms"), errors().alias("errors"),
        F.round(errors() / n, 4).alias("error_rate"),
    )


def per_day(calls: DataFrame) -> DataFrame:
    """Calls of each day that has any."""
    return calls.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))


def mode(calls: DataFrame, by: str, what: str) -> DataFrame:
    """The most frequent value of each group, the first by name among equals."""
    n = calls.groupBy(by, what).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), what)
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(by, F.col(what).alias("top"), F.col("n").alias("top_n"))


def billed(c: str = "cost_usd") -> Column:
    """The recorded cost, or that of the tokens where none above 0 is recorded."""
    return F.when(F.col(c) > 0, F.col(c)).otherwise(cost_usd(F.col("tokens_in"), F.col("tokens_out")))


def leaderboard(calls: DataFrame, tenants: DataFrame, n: int) -> DataFrame:
    """The tenants with the largest billed cost, then the most calls; unknown tenants keep an empty name."""
    rows = calls.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"),
        F.round(money(billed()), 4).cast("double").alias("billed_usd"), errors().alias("errors"), F.max("ts").alias("last_call")
    )
    top = rows.orderBy(F.desc("billed_usd"), F.desc("calls"), "tenant").limit(n)
    named = top.join(tenants.select("tenant", "name"), "tenant", "left").withColumn("name", F.coalesce("name", F.lit("")))
    return named.join(mode(calls, "tenant", "call_type").select("tenant", F.col("top").alias("top_type")), "tenant", "left")


def top_tools(calls: DataFrame, n: int = 20) -> DataFrame:
    rows = calls.groupBy("call_type").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("ts").alias("last_call"), errors().alias("errors")
    )
    return rows.orderBy(F.desc("calls"), "call_type").limit(n)


def percentiles(calls: DataFrame) -> DataFrame:
    """p50, p95 and p99 of the duration by type, and over all as `_overall`; linear between ranks, rounded half to even."""
    return exact_percentiles(calls)


def budget(calls: DataFrame, tenants: DataFrame, caps: DataFrame) -> DataFrame:
    """Euros spent on successful calls against the cap of each tenant's tier; no cap is no limit."""
    spent = calls.where("status = 'ok'").groupBy("tenant").agg((money(cost_usd(F.col("tokens_in"), F.col("tokens_out"))).cast("double") * EUR).alias("eur"))
    rows = tenants.join(if_few(caps), "tier", "left").join(spent, "tenant", "left")
    eur = F.round(F.coalesce("eur", F.lit(0.0)), 4)
    return rows.select("tenant", "tier", eur.alias("spent_eur"), "cap_eur", (F.col("cap_eur").isNull() | (eur < F.col("cap_eur"))).alias("allowed"))


def findings(calls: DataFrame, slow_ms: float = 5000, least: int = 3, often: int = 2, high: int = 5) -> DataFrame:
    """Recurring errors and slow types, with their severity."""
    rows = calls.groupBy("call_type").agg(F.count(F.lit(1)).alias("n"), errors().alias("errors"), F.avg("duration_ms").alias("ms"))
    recurring = rows.where(F.col("errors") >= often).select(
        F.lit("recurring_error").alias("finding"), "call_type", F.col("errors").alias("count"), F.when(F.col("errors") >= high, "high").otherwise("medium").alias("severity")
    )
    slow = rows.where((F.col("ms") > slow_ms) & (F.col("n") >= least)).select(F.lit("slow").alias("finding"), "call_type", F.col("n").alias("count"), F.lit("medium").alias("severity"))
    return recurring.unionByName(slow)


def recency(rows: DataFrame, column: str, today: Column) -> DataFrame:
    day = F.to_date(column)
    return rows.agg(
        F.count_if(day >= F.date_sub(today, 7)).alias("last_7_days"), F.count_if(day >= F.date_sub(today, 30)).alias("last_30_days"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )


def last_arrivals(**sources: DataFrame) -> DataFrame:
    """The newest timestamp (column ts) of each source."""
    parts = [df.agg(F.max("ts").alias("last")).select(F.lit(name).alias("source"), "last") for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cached(calls: DataFrame, key: str, as_of: Column, days: int = 30) -> DataFrame:
    """The newest successful call of each key within so many days."""
    fresh = calls.where((F.col("status") == "ok") & (F.col("ts") >= as_of - F.make_interval(days=F.lit(days))))
    return fresh.groupBy(key).agg(F.max("id").alias("id"), F.max_by("ts", "id").alias("ts"))


def recent(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows of the last so many days; rows after as_of count, as they do against a clock."""
    return rows.where(F.col("ts") >= as_of - F.make_interval(days=F.lit(days)))


def tool_usage(calls: DataFrame, as_of: Column, days: int = 30, n: int = 20) -> DataFrame:
    """top_tools() of the last days, with total_calls, the calls of the tools listed."""
    top = top_tools(recent(calls, as_of, days), n)
    return top.withColumn("total_calls", F.sum("calls").over(Window.partitionBy(F.lit(0))))  # n rows


def qa_report(calls: DataFrame, slow_ms: float = 5000, least: int = 3, often: int = 2, high: int = 5) -> DataFrame:
    """findings(), the types that ran into timeouts, and one row with the share of errors in percent, to one place."""
    rate = F.round(F.try_divide(errors() * 100.0, F.count(F.lit(1))), 1)
    timeouts = calls.where("status = 'timeout'").groupBy("call_type").agg(F.count(F.lit(1)).alias("count"))
    none, unknown = F.lit(None).cast("double").alias("error_rate"), F.lit(None).cast("string")
    late = timeouts.select(F.lit("timeout").alias("finding"), "call_type", "count", F.lit("high").alias("severity"), none)
    overall = calls.agg(F.count(F.lit(1)).alias("count"), rate.alias("error_rate"))
    overall = overall.select(F.lit("error_rate").alias("finding"), unknown.alias("call_type"), "count", unknown.alias("severity"), "error_rate")
    return findings(calls, slow_ms, least, often, high).select("*", none).unionByName(late).unionByName(overall)


def ai_cost(calls: DataFrame, as_of: Column, hours: int = 24, by: list[str] | None = None) -> DataFrame:
    """The recorded cost of successful calls of the last hours, by tenant or over all."""
    fresh = calls.where((F.col("status") == "ok") & (F.col("ts") >= as_of - F.make_interval(hours=F.lit(hours))))
    return fresh.groupBy(*(by or [])).agg(F.round(F.coalesce(money(F.col("cost_usd")), F.lit(0)), 4).cast("double").alias("cost_usd"), F.count(F.lit(1)).alias("calls"))


def stats_with_total(calls: DataFrame) -> DataFrame:
    """stats() of each type and, as `_total`, of all calls, with their billed cost; types are added up, calls read once."""
    rows = calls.rollup("call_type").agg(
        F.grouping("call_type").alias("g"), F.count(F.lit(1)).alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), errors().alias("errors"),
        F.round(money(billed()), 4).cast("double").alias("cost_usd"),
    )
    return rows.select(F.when(F.col("g") == 1, "_total").otherwise(F.col("call_type")).alias("call_type"), "calls", "tokens_in", "tokens_out", "errors", "cost_usd", F.round(F.col("errors") / F.col("calls"), 4).alias("error_rate"))


def snapshot(calls: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One key and JSON value: calls, errors and tokens of each type over the last days, types in order."""
    fresh = calls.where((F.col("ts") >= as_of - F.make_interval(days=F.lit(days))) & (F.col("ts") < as_of))
    rows = fresh.groupBy("call_type").agg(F.count(F.lit(1)).alias("calls"), errors().alias("errors"), total("tokens_in").alias("tokens_in"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("call_type", "calls", "errors", "tokens_in"))).alias("types"))
    return one.select(F.concat(F.lit("weekly_"), F.date_format(as_of, "yyyy-MM-dd")).alias("key"), F.to_json("types").alias("value"))


def whole_snapshot(calls: DataFrame, runs: DataFrame, as_of: Column, days: int = 7, tools: int = 20) -> DataFrame:
    """One key and JSON value: statistics of each type, the tools called most, and pipeline runs (ts, status), all of the last days."""
    since = (F.col("ts") >= as_of - F.make_interval(days=F.lit(days))) & (F.col("ts") < as_of)
    week = calls.where(since)
    kinds = week.groupBy("call_type").agg(F.count(F.lit(1)).alias("calls"), errors().alias("errors"), total("tokens_in").alias("tokens_in"))
    prompts = kinds.agg(F.array_sort(F.collect_list(F.struct("call_type", "calls", "errors", "tokens_in"))).alias("prompts"))
    best = top_tools(week, tools).select(F.struct((-F.col("calls")).alias("less"), "call_type", "calls").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    best = best.select(F.transform("x", lambda x: F.struct(x["call_type"].alias("call_type"), x["calls"].alias("calls"))).alias("tools"))
    done = runs.where(since).agg(F.struct(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failed")).alias("pipeline"))
    one = prompts.join(best).join(done)  # a row each
    return one.select(F.concat(F.lit("weekly_"), F.date_format(as_of, "yyyy-MM-dd")).alias("key"), F.to_json(F.struct("prompts", "tools", "pipeline")).alias("value"))


def exact_percentiles(calls: DataFrame) -> DataFrame:
    """As percentiles(), from a histogram: calls are first counted by type and duration, so that no task holds all durations."""
    counts = calls.where(F.col("duration_ms").isNotNull()).groupBy("call_type", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(counts.groupBy("duration_ms").agg(F.sum("n").alias("n")).withColumn("call_type", F.lit("_overall")))
    rows = counts.groupBy("call_type").agg(
        F.sum("n").alias("calls"), *(F.bround(F.percentile("duration_ms", p, F.col("n")), 0).cast("long").alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    )
    return rows.select("call_type", "calls", "p50", "p95", "p99")
