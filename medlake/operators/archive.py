"""Documents and conversations: search, completeness, statistics, groups, timelines and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.functions.scalars import contains_ascii, first_match, fold, reasons, shortened, year_month
from medlake.operators import ordering
from medlake.session import if_few


def search(df: DataFrame, query: str, weights: dict[str, int], order: list[Column], limit: int) -> DataFrame:
    """Rows in which each term of the query stands in some field, by the weights of the fields that hold any term."""
    terms = query.split()
    if not terms:
        return df.withColumn("score", F.lit(0)).limit(0)
    found = F.lit(True)
    for t in terms:
        some = F.lit(False)
        for c in weights:
            some = some | contains_ascii(F.col(c), t)
        found = found & some
    score = F.lit(0)
    for c, w in weights.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | contains_ascii(F.col(c), t)
        score = score + F.when(hit, w).otherwise(0)
    return df.where(found).withColumn("score", score).orderBy(F.desc("score"), *order).limit(limit)


def phrase(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold the words of the query one after the other, in one of the columns."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    if not words:
        return df.limit(0)
    some, rare = F.lit(False), max(words, key=len)
    for c in columns:
        folded = fold(F.coalesce(F.col(c), F.lit("")))
        # a word that is not there needs no further look
        some = some | (folded.contains(rare) & folded.rlike("(^|[^\\p{L}\\p{N}])" + "[^\\p{L}\\p{N}]+".join(words) + "($|[^\\p{L}\\p{N}])"))
    return df.where(some)


def classify(df: DataFrame, column: str, rules: list[tuple[str, str]], default: str) -> DataFrame:
    return df.withColumn("category", first_match(F.col(column), rules, default))


#: A name of letters, then a number, as results stand in a table; lines that start with a date are none.
LAB_LINE, DATE_LINE = "^\\s*\\p{L}[\\p{L} .%-]*\\s+[-+]?\\d+([.,]\\d+)?\\b", "^\\s*\\d{1,4}[.\\-/]\\d{1,2}[.\\-/]"


def lab_lines(text: str = "text") -> Column:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\\R")
    return F.size(F.filter(lines, lambda x: x.rlike(LAB_LINE) & ~x.rlike(DATE_LINE)))


def has_lab_table(text: str = "text", least: int = 3) -> Column:
    return lab_lines(text) >= least


def flags(df: DataFrame) -> DataFrame:
    """Completeness of documents with text, n_chars, quality (null: not yet looked at) and lang."""
    return df.withColumns(
        {
            "has_text": F.coalesce(F.col("text") != "", F.lit(False)),
            "has_review": F.col("quality").isNotNull(),
            "long_enough": F.coalesce(F.col("n_chars") >= 500, F.lit(False)),
        }
    ).withColumn("complete", F.col("has_text") & F.col("has_review") & F.col("long_enough"))


def health(df: DataFrame, by: list[str]) -> DataFrame:
    f = flags(df)
    return f.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in ("has_text", "has_review", "long_enough", "complete"))
    )


def gaps(df: DataFrame) -> DataFrame:
    """Incomplete documents with the reasons, in order."""
    f = flags(df)
    why = reasons(no_text=~F.col("has_text"), no_review=~F.col("has_review"), too_short=~F.col("long_enough"))
    return f.withColumn("reasons", why).where(F.size("reasons") > 0)


def group_integrity(parts: DataFrame, group: str, declared: str) -> DataFrame:
    """Parts that each group has and declares; with no declaration all are orphans, else the difference counts."""
    g = parts.groupBy(group).agg(F.max(declared).alias("declared"), F.count(F.lit(1)).alias("parts"))
    return g.withColumn("orphans", F.when(F.col("declared").isNull(), F.col("parts")).otherwise(F.abs(F.col("declared") - F.col("parts"))).cast("long"))


def group_spans(parts: DataFrame, group: str, day: str, most: int = 7) -> DataFrame:
    """Whether the days of a group lie within so many days; fewer than two known days do."""
    g = parts.groupBy(group).agg(F.datediff(F.max(day), F.min(day)).alias("span"), F.count(day).alias("known"))
    return g.withColumn("fits", (F.col("known") < 2) | (F.col("span") <= most))


def broken_groups(parts: DataFrame, group: str, day: str, place: str, most: int = 7) -> DataFrame:
    """Groups with a defect and its first name: one member, too wide a span, or several institutions."""
    g = parts.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), F.datediff(F.max(day), F.min(day)).alias("span"), F.count_distinct(F.trim(place)).alias("places")
    )
    defect = F.when(F.col("members") == 1, "single_member").when(F.col("span") > most, "date_span").when(F.col("places") > 1, "institutions")
    return g.withColumn("defect", defect).where("defect is not null")


def conversation_stats(df: DataFrame, kind: str, who: str, when: str) -> DataFrame:
    """Counts by kind, by participant, by month and over all, in one pass; null and empty keys are `(unset)`."""
    rows = df.select(
        *(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(unset)")).alias(n) for c, n in ((kind, "kind"), (who, "who"))),
        F.coalesce(year_month(F.col(when)), F.lit("(unset)")).alias("month"),
    )
    sets = [[rows.kind], [rows.who], [rows.month], []]
    g = rows.groupingSets(sets, "kind", "who", "month").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("gk"), F.grouping("who").alias("gw"), F.grouping("month").alias("gm")
    )
    what = F.when(F.col("gk") == 0, "kind").when(F.col("gw") == 0, "who").when(F.col("gm") == 0, "month").otherwise("total")
    return g.select(what.alias("dimension"), F.coalesce("kind", "who", "month", F.lit("")).alias("key"), "n")


def tag_counts(df: DataFrame, tags: Column, n: int = 100) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(min(n, 100))


def timeline(**legs: DataFrame) -> DataFrame:
    """Legs of (day, title, summary, tags, ref) in one shape, with their source; every row of each."""
    parts = [df.select(F.lit(s).alias("source"), "day", "title", shortened(F.col("summary"), 200).alias("summary"), "ref") for s, df in legs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def month_log(df: DataFrame) -> DataFrame:
    """A Markdown list of each month, by day and title."""
    line = F.concat(F.lit("- "), F.date_format("day", "yyyy-MM-dd"), F.lit(" "), F.col("title"))
    rows = df.select(year_month(F.col("day")).alias("month"), F.struct("day", "title", line.alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy("month").agg(F.array_join(lines, "\n").alias("markdown"))


def date_from_candidates(days: Column, low: Column, high: Column, newest: bool = False) -> Column:
    """The earliest, or newest, of the candidate dates within bounds; null if none is."""
    fit = F.filter(days, lambda d: (d >= low) & (d <= high))
    return F.array_max(fit) if newest else F.array_min(fit)


def screening(people: DataFrame, protocols: DataFrame, done: DataFrame, today: Column) -> DataFrame:
    """Status of each protocol for each person it applies to: overdue, due_soon within 90 days, up_to_date or never_done.

    people (person, age, sex), protocols (protocol, sex, age_from, age_to, months; a small dimension), done (person, protocol, day).
    """
    p = protocols.select("protocol", F.col("sex").alias("for_sex"), "age_from", "age_to", "months")
    fits = (F.col("for_sex").isNull() | (F.col("for_sex") == F.col("sex"))) & F.col("age").between(F.col("age_from"), F.col("age_to"))
    last = done.groupBy("person", "protocol").agg(F.max("day").alias("last_done"))
    rows = people.join(if_few(p), fits).join(last, ["person", "protocol"], "left")
    due = F.date_add("last_done", (F.col("months") * 30).cast("int"))
    status = F.when(F.col("last_done").isNull(), "never_done").when(due < today, "overdue").when(due <= F.date_add(today, 90), "due_soon").otherwise("up_to_date")
    return rows.select("person", "protocol", "last_done", due.alias("due"), status.alias("status"))


#: Times to the microsecond, in records of JSON.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def manifest(**tables: DataFrame) -> DataFrame:
    """Row count and content hash of each table, whatever its row order: two sums of halves of row hashes."""
    parts = []
    for name, df in tables.items():
        h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), JSON_TIMES))
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")).select(F.lit(name).alias("name"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timeline_page(rows: DataFrame, sources: list[str] | None, query: str | None, limit: int, offset: int = 0, newest: bool = True, most: int = 500) -> DataFrame:
    """A page of a timeline: some sources, rows whose title or summary holds the query, by day; ties by source, ref and summary."""
    out = rows if sources is None else rows.where(F.col("source").isin(sources))
    if query:
        out = out.where(contains_ascii(F.col("title"), query) | contains_ascii(F.col("summary"), query))
    day = F.desc("day") if newest else F.asc("day")
    return out.orderBy(day, "source", "ref", "summary").offset(max(0, offset)).limit(max(1, min(limit, most)))


def library(df: DataFrame) -> DataFrame:
    """A Markdown section a topic of rows (topic, kind, ref), by kind and ref."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), F.col("ref").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("kind", "ref", line.alias("line")))), lambda x: x["line"])
    rows = df.groupBy("topic").agg(lines.alias("lines"))
    return rows.select("topic", F.concat(F.lit("## "), "topic", F.lit("\n"), F.array_join("lines", "\n")).alias("markdown"))


def library_pages(df: DataFrame, size: int = 1000) -> DataFrame:
    """library() in pages (topic, page from 0, markdown) of `size` lines at most, each under the topic's heading: a topic may have any number of rows."""
    rows = df.select("topic", "kind", "ref")
    line = F.concat(F.lit("- ["), F.coalesce("kind", F.lit("")), F.lit("] "), F.coalesce(F.col("ref").cast("string"), F.lit("")))
    pages = ordering.blocks(rows, ["topic"], ["kind", "ref"], line, size)
    return pages.select("topic", F.col("block").alias("page"), F.concat(F.lit("## "), F.coalesce("topic", F.lit("")), F.lit("\n"), "text").alias("markdown"))


def month_log_pages(df: DataFrame, size: int = 1000) -> DataFrame:
    """month_log() in pages (month, page from 0, lines, markdown) of `size` lines at most; rows without a day are under the month null."""
    line = F.concat(F.lit("- "), F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("undated")), F.lit(" "), F.coalesce("title", F.lit("")))
    rows = df.select(year_month(F.col("day")).alias("month"), "day", "title")
    return ordering.blocks(rows, ["month"], ["day", "title"], line, size).select("month", F.col("block").alias("page"), "lines", F.col("text").alias("markdown"))
