"""Filters, sorting and pages."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.functions.scalars import LOWER, UPPER, all_of, ascii_lower, contains_ascii, json_strings


def where_given(
    df: DataFrame,
    equal: dict[str, object] | None = None,
    date_column: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
    text: str | None = None,
    text_columns: tuple[str, ...] = (),
) -> DataFrame:
    """The rows that meet every condition given; a None condition is none at all, an empty string is one."""
    found = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v is not None]
    if date_from is not None:
        found.append(F.col(date_column) >= F.lit(date_from))
    if date_to is not None:  # the whole last day counts, of timestamps too
        found.append(F.col(date_column) < F.lit(date_to + timedelta(days=1)))
    if text:
        found.append(any_like(text_columns, text))
    return df.where(all_of(found))


def any_contains(columns: tuple[str, ...], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains_ascii(F.col(c), term)
    return out


def any_like(columns: tuple[str, ...], term: str) -> Column:
    """Whether some column holds the term whatever the case of A-Z; a per cent sign in it stands for any text and an underscore for any character."""
    pattern = F.lit("%" + "".join(LOWER[UPPER.index(x)] if x in UPPER else x for x in term).replace("\\", "\\\\") + "%")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.like(ascii_lower(F.col(c)), pattern), F.lit(False))
    return out


def last_days(df: DataFrame, column: str, as_of: datetime, days: float) -> DataFrame:
    """Rows of the window of so many days that ends with as_of; rows after it count, as they do against a clock."""
    return df.where(F.col(column) >= F.lit(as_of - timedelta(days=days)).cast(df.schema[column].dataType))


def for_tenant(df: DataFrame, tenant: object | None, column: str = "tenant") -> DataFrame:
    """All rows for None; else the tenant's own, the empty tenant's included."""
    return df if tenant is None else df.where(F.col(column) == F.lit(tenant))


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def trash(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def missing(c: str) -> Column:
    """Null or empty."""
    return F.col(c).isNull() | (F.col(c) == "")


def readable(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with columns read as other types, without the rows that have a value which is none of its type; null stays null."""
    ok = all_of([F.col(c).isNull() | F.col(c).try_cast(t).isNotNull() for c, t in types.items()])
    return df.where(ok).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page under a total order; the limit is held between 1 and `most`."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def has_all_tags(c: str, tags: list[str]) -> Column:
    """Whether a JSON array of strings holds every tag."""
    return F.size(F.array_except(F.array(*map(F.lit, tags)), json_strings(F.col(c)))) == 0


def shared_tags(c: str, tags: list[str]) -> Column:
    """The tags of a JSON array that are asked for, in their order there."""
    return F.array_intersect(json_strings(F.col(c)), F.array(*map(F.lit, tags)))


def notes(df: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Rows whose text holds the query whatever the case of A-Z; a blank query finds nothing."""
    return df.where(contains_ascii(F.col(column), query.strip())) if query.strip() else df.limit(0)


def record_notes(notes_of: DataFrame, records: DataFrame, query: str, tenant: object, key: str, column: str = "text") -> DataFrame:
    """notes() of the tenant's records that are not deleted; a note without such a record has no row."""
    own = live(for_tenant(records, tenant)).select(key)
    return notes(notes_of, query, column).join(own, key, "left_semi")


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows with one of the values; an empty list keeps none."""
    return df.where(F.col(column).isin(values)) if values else df.limit(0)


def without_prefix(df: DataFrame, column: str, prefix: str = "__") -> DataFrame:
    """Rows whose id is none of the system's own; a null id stays."""
    return df.where(F.coalesce(~F.col(column).startswith(prefix), F.lit(True)))


def by_rank(column: str, ranks: list[str]) -> Column:
    """A sort key: the place of a value in the list, unknown ones last."""
    out = F.lit(len(ranks))
    for i, v in reversed(list(enumerate(ranks))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out
