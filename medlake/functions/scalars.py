"""Scalar functions as native column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price of a million tokens in and out, in dollars, and euros to a dollar.
PRICE_IN, PRICE_OUT, EUR = 0.80, 4.00, 0.92
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition, without combining marks, is one character, and what that is; marks; and those with longer ones.

    Composed Hangul is left as it is: both sides of a comparison have it so.
    """
    plain, marks, longer = {}, [], {}
    for i in chain(range(0x80, 0xAC00), range(0xF900, 0xFFFE)):
        c = chr(i)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        rest = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if rest != c:
            if len(rest) == 1:
                plain[c] = rest
            else:
                longer[c] = rest
    return "".join(plain) + "".join(marks), "".join(plain.values()), longer


COMPOSED, PLAIN, LONGER = _decomposed()


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as LIKE folds in the documented store."""
    return F.translate(c, UPPER, LOWER)


def contains_ascii(c: Column, term: str) -> Column:
    """Whether a text contains a term whatever the case of A-Z; null counts as no."""
    low = "".join(LOWER[UPPER.index(x)] if x in UPPER else x for x in term)
    return F.coalesce(ascii_lower(c).contains(low), F.lit(False))


def without_diacritics(c: Column) -> Column:
    """Text in compatibility decomposition without its combining marks; letters that have none, such as l with stroke or sharp s, stay."""
    table = F.from_json(F.lit(json.dumps(LONGER)), "map<string,string>")

    def plain(t: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
        some = F.translate(t, "".join(LONGER), "") != t  # a look-up a letter, where a class of a thousand letters would be tried one by one
        return F.when(t.rlike("[^\\x00-\\x7F]"), F.translate(F.when(some, spelled).otherwise(t), COMPOSED, PLAIN)).otherwise(t)

    # inside a lambda the text is named and not written out again, however long its own expression is
    return F.transform(F.array(c), plain)[0]


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(without_diacritics(c))


def json_valid(c: Column) -> Column:
    """Whether the whole of a text is one JSON value; null is none.

    The parser stops after the first value, so the text is read inside an array and inside an object: what follows
    a value breaks one of them, or makes a second element.
    """
    listed, member = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(one & member.isNotNull(), F.lit(False))


def parsed_json(c: Column) -> Column:
    """The variant of a text that is JSON, else null."""
    return F.when(json_valid(c), F.try_parse_json(c))


def json_kind(v: Column) -> Column:
    """object, array, string, number, boolean or null of a variant; null where there is none."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "VOID", "null")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(v.isNotNull(), "number")
    )


def json_each(df: DataFrame, column: str) -> DataFrame:
    """df with a row for each member of its JSON: pos, key (null in arrays) and value, a variant; scalars and what is no JSON have no rows."""
    rows = df.withColumn("__v", parsed_json(F.col(column)))
    members = df.sparkSession.tvf.variant_explode(F.col("__v").outer())
    return rows.lateralJoin(members).drop("__v")


def half_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)


def cost_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.lit(PRICE_IN / 1e6) + tokens_out * F.lit(PRICE_OUT / 1e6)


def shortened(c: Column, n: int) -> Column:
    """The first n characters, with an ellipsis where more follow."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def json_strings(c: Column) -> Column:
    """A JSON array of strings; what cannot be read is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def without_fence(c: Column) -> Column:
    """Text inside a Markdown fence, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "^\\s*```[^\\n]*\\n", ""), "\\n?```\\s*$", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def sender(c: Column) -> Column:
    """The address in `Name <address>`, or the whole, in lower case."""
    inner = F.regexp_extract(c, "<([^>]*)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(c)))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "(\\.[^./]+)$", 1))


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first keyword, in order, that a text contains."""
    return F.transform(F.array(fold(c)), lambda t: F.coalesce(*(F.when(t.contains(k), F.lit(v)) for k, v in rules), F.lit(default)))[0]


def file_date(c: Column) -> Column:
    """A date at the head of a file name: YYYYMMDD, YYYYMM with an unknown day, or YYYY-M-D."""
    compact = F.regexp_extract(c, "^(\\d{8})", 1)
    month = F.concat(F.substring(compact, 1, 6), F.lit("01"))
    dashed = F.regexp_extract(c, "^(\\d{4}-\\d{1,2}-\\d{1,2})", 1)
    return F.coalesce(
        F.when(compact != "", F.coalesce(_date(compact, "yyyyMMdd"), _date(month, "yyyyMMdd"))),
        F.when(dashed != "", _date(dashed, "yyyy-M-d")),
    )


def _date(c: Column, form: str) -> Column:
    return F.try_to_timestamp(c, F.lit(form)).cast("date")


def all_of(conditions: list[Column]) -> Column:
    """The conjunction; true of none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def reasons(**flags: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))


#: Address patterns of linked records.
DRIVE, PUBMED, TRIALS = "https://drive.google.com/file/d/%s/view", "https://pubmed.ncbi.nlm.nih.gov/%s/", "https://clinicaltrials.gov/study/%s"


def record_url(source: Column, record: Column) -> Column:
    """The address of a record of a known source: a drive file, a paper by its number, with PMID ahead or not, or a trial by its NCT id; else null."""
    name, key = F.lower(source), F.trim(record)
    number = F.trim(F.regexp_replace(key, "PMID:?", ""))
    return (
        F.when((name == "drive") & (key != ""), F.format_string(DRIVE, key))
        .when((name == "pubmed") & number.rlike("^\\d+$"), F.format_string(PUBMED, number))
        .when(name.isin("clinicaltrials", "clinicaltrials.gov") & F.upper(key).startswith("NCT"), F.format_string(TRIALS, key))
    )


def without_closing_tag(c: Column, tag: str) -> Column:
    """Text in which its own closing tag can end nothing; null is empty."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit(f"</{tag}>"), F.lit(f"</{tag}_>"))


def iso_time(c: Column) -> Column:
    """A timestamp in ISO form, with Z or an offset or none; null for others."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "(?i)z$", "+00:00"))


def age_in_years(born: Column, today: Column) -> Column:
    """Whole years; a birthday on 29 February is that of 1 March where there is none."""
    before = (F.month(today) < F.month(born)) | ((F.month(today) == F.month(born)) & (F.dayofmonth(today) < F.dayofmonth(born)))
    return F.year(today) - F.year(born) - before.cast("int")


def plausible(c: Column, low: Column, high: Column) -> Column:
    """The date if it lies within the bounds, else null."""
    return F.when(c.between(low, high), c)


def merged_maps(old: Column, new: Column) -> Column:
    """Both maps in one, keys of the second first; nulls of the second overwrite too."""
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(new, F.create_map().cast("map<string,string>"))), k))
    return F.map_concat(keep, F.coalesce(new, F.create_map().cast("map<string,string>")))


def prompt_hash(system: Column, user: Column, model: Column) -> Column:
    """SHA-256 of what decides an answer, each part behind its name and marks that no text holds; null parts are empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit("system\x00"), part(system), F.lit("\x01user\x00"), part(user), F.lit("\x01model\x00"), part(model)).cast("binary"), 256)


def known_or_unknown(c: Column, known: list[str]) -> Column:
    """A name of the list in its spelling there, whatever its case; `unknown` for others."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, known)), lambda k: F.lower(k) == F.lower(F.trim(c))), F.lit(0)), F.lit("unknown"))
