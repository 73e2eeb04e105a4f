"""File names of the archive: grammars, standard names, institutions and categories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.functions.scalars import extension, file_date, first_match, fold

#: Category and its token in a standard name.
TOKENS = {
    "labs": "Labs", "report": "Report", "pathology": "Pathology", "imaging": "Imaging", "genetics": "Genetics", "hereditary_genetics": "HereditaryGenetics", "surgery": "Surgery",
    "surgical_report": "SurgicalReport", "consultation": "Consultation", "prescription": "Prescription", "referral": "Referral", "discharge": "Discharge",
    "discharge_summary": "DischargeSummary", "chemo_sheet": "ChemoSheet", "reference": "Reference", "advocate": "Advocate", "other": "Other", "vaccination": "Vaccination",
    "dental": "Dental", "preventive": "Preventive",
}
#: Tokens of old names count as imaging too.
BY_TOKEN = {t.lower(): c for c, t in TOKENS.items()} | {"ct": "imaging", "usg": "imaging"}
MERGED = {"surgical_report": "surgery", "discharge_summary": "discharge"}
STAYING = ("advocate", "reference")
PART = "_?Part\\d+of\\d+$"


def mapped(c: Column, values: dict[str, str]) -> Column:
    """The value of a key; null for others."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=.)\\.[^.]*$", "")


def name_date(c: Column) -> Column:
    """The date at the head of a name; XX for the day is the first of the month."""
    return file_date(F.regexp_replace(c, "^(\\d{6})XX", "$101"))


def _after_date(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, f"^(\\d{{8}}|\\d{{6}}XX|\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})[{marks}]*", "")


def institution_code(c: Column, codes: list[str], names: dict[str, str]) -> Column:
    """The code of an institution: a code as it is, or what its name in any case stands for; null if unknown."""
    return F.when(c.isin(codes), c).otherwise(mapped(F.lower(F.trim(c)), names))


def parsed_name(c: Column, person: str, codes: list[str], aliases: dict[str, str], keywords: list[tuple[str, str]]) -> Column:
    """form, date, institution, category, description and extension of a file name, by the first grammar that fits.

    standard: DATE_Person_Institution_Category_Description; bilingual: DATE Person-Institution-Description, of three
    parts the last; legacy: DATE and words, of which the first known institution and then the first alias of a
    category are taken out.  Where no token names the category, the first keyword in the description does, else `other`.
    """
    s, day = stem(c), name_date(c)
    infer = lambda d: first_match(F.coalesce(d, F.lit("")), keywords, "other")
    joined = lambda parts, at, mark: F.nullif(F.array_join(F.slice(parts, at, F.greatest(F.size(parts), F.lit(1))), mark), F.lit(""))

    p = F.split(_after_date(s, "_"), "_")
    token = mapped(F.lower(F.get(p, F.lit(2))), BY_TOKEN)
    standard_rest = F.when(token.isNotNull(), joined(p, 4, "_")).otherwise(joined(p, 3, "_"))
    is_standard = day.isNotNull() & (s.contains(f"_{person}_") | s.startswith(f"{person}_")) & (F.size(p) >= 2) & (F.lower(F.get(p, F.lit(0))) == person.lower())
    standard = F.struct(
        F.lit("standard").alias("form"), day.alias("date"), F.when(F.size(p) >= 3, F.get(p, F.lit(1))).alias("institution"),
        F.when(F.size(p) < 3, "other").otherwise(F.coalesce(token, infer(standard_rest))).alias("category"), F.when(F.size(p) >= 3, standard_rest).alias("description"),
        F.nullif(extension(c), F.lit("")).alias("extension"),
    )

    r = F.regexp_replace(_after_date(s, " _-"), f"(?i)^{person}-*", "")
    q = F.split(r, "-", 3)
    is_bilingual = day.isNotNull() & s.contains(" ") & F.lower(s).contains(person.lower())
    known = F.get(F.filter(F.array(*map(F.lit, codes)), lambda k: F.lower(k) == F.lower(F.get(q, F.lit(0)))), F.lit(0))
    rest = F.nullif(F.coalesce(F.get(q, F.lit(2)), F.get(q, F.lit(1)), F.get(q, F.lit(0))), F.lit(""))
    bilingual = F.struct(
        F.lit("bilingual").alias("form"), day.alias("date"), F.when(F.size(q) >= 2, F.coalesce(known, F.get(q, F.lit(0)))).alias("institution"),
        infer(rest).alias("category"), rest.alias("description"), F.nullif(extension(c), F.lit("")).alias("extension"),
    )

    words = F.filter(F.split(F.when(day.isNotNull(), _after_date(s, "_ -")).otherwise(s), "[_\\-\\s]+"), lambda w: w != "")
    codes_of = F.transform(words, lambda w: F.get(F.filter(F.array(*map(F.lit, codes)), lambda k: F.lower(k) == F.lower(w)), F.lit(0)))
    at = F.array_position(F.transform(codes_of, lambda x: x.isNotNull()), True)
    left = F.when(at > 0, F.filter(words, lambda w, i: i != at - 1)).otherwise(words)
    kinds = F.transform(left, lambda w: mapped(F.lower(w), aliases))
    named = F.array_position(F.transform(kinds, lambda x: x.isNotNull()), True)
    free = F.nullif(F.array_join(F.when(named > 0, F.filter(left, lambda w, i: i != named - 1)).otherwise(left), " "), F.lit(""))
    legacy = F.struct(
        F.lit("legacy").alias("form"), day.alias("date"), F.when(at > 0, F.get(codes_of, (at - 1).cast("int"))).alias("institution"),
        F.when(named > 0, F.get(kinds, (named - 1).cast("int"))).otherwise(infer(free)).alias("category"), free.alias("description"), F.nullif(extension(c), F.lit("")).alias("extension"),
    )
    return F.when(is_standard, standard).when(is_bilingual, bilingual).otherwise(legacy)


def standard_name(c: Column, parsed: Column, person: str, institution: Column | None = None) -> Column:
    """DATE_Person_Institution_Category_Description.ext; unchanged without a date or a known institution."""
    given = parsed["institution"] if institution is None else F.coalesce(institution, parsed["institution"])
    prefix = F.lower(F.regexp_extract(parsed["description"], "^([^-]*)-", 1))
    rest = F.when(prefix.isin(list(BY_TOKEN)), F.regexp_replace(parsed["description"], "^[^-]*-", "")).otherwise(parsed["description"])
    name = F.concat_ws("_", F.date_format(parsed["date"], "yyyyMMdd"), F.lit(person), given, F.coalesce(mapped(parsed["category"], TOKENS), F.lit("Other")), F.nullif(rest, F.lit("")))
    ends = F.regexp_extract(c, "(?<=.)(\\.[^.]*)$", 1)
    return F.when(parsed["date"].isNull() | given.isNull() | given.isin("", "Unknown"), c).otherwise(F.concat(name, ends))


def is_standard_name(c: Column, person: str) -> Column:
    """Whether a name is YYYYMMDD_Person_Institution_Category with a known category and institution."""
    p = F.split(F.regexp_extract(stem(c), f"^\\d{{8}}_{person}_(.*)$", 1), "_")
    return F.coalesce((F.size(p) >= 2) & (F.get(p, F.lit(0)) != "Unknown") & F.lower(F.get(p, F.lit(1))).isin(list(BY_TOKEN)), F.lit(False))


def is_corrupt_name(c: Column, person: str) -> Column:
    """Longer than 255, or the person's name stands in it three times or more."""
    return (F.length(c) > 255) | (F.size(F.split(stem(c), f"\\Q{person}\\E")) > 3)


def with_part(c: Column, part: Column, total: Column) -> Column:
    """The name with PartNofM at its end, in place of an earlier one."""
    mark = F.concat(F.lit("Part"), part.cast("string"), F.lit("of"), total.cast("string"))
    return F.concat(F.concat_ws("_", F.nullif(F.regexp_replace(stem(c), PART, ""), F.lit("")), mark), F.regexp_extract(c, "(?<=.)(\\.[^.]*)$", 1))


def owner_swapped(c: Column, names: list[str], owner: Column) -> Column:
    """Standard names that hold another person's name, with the owner's in its place; others unchanged."""
    p = F.split(c, "_")
    wrong = F.get(p, F.lit(1)).isin(names) & (F.get(p, F.lit(1)) != owner) & F.lower(F.get(F.split(stem(c), "_"), F.lit(3))).isin(list(BY_TOKEN))
    return F.when(wrong & (F.size(p) >= 4), F.array_join(F.transform(p, lambda x, i: F.when(i == 1, owner).otherwise(x)), "_")).otherwise(c)


def inferred_institution(providers: Column, rules: list[tuple[str, str]]) -> Column:
    """The institution of the first fragment, in order, that the providers' names hold, whatever case and diacritics; null if none."""
    return first_match(F.array_join(F.coalesce(providers, F.array().cast("array<string>")), " "), [(k.lower(), v) for k, v in rules])


def institution_backfill(docs: DataFrame, clinics: DataFrame, rules: list[tuple[str, str]], allowed: list[str]) -> DataFrame:
    """Rows (id, tenant, category, institution, providers) without an institution that get one, and from where.

    The providers decide; else the tenant's clinic (tenant, clinic), for categories where that is safe.
    """
    empty = docs.where(F.col("institution").isNull() | (F.col("institution") == ""))
    by = inferred_institution(F.col("providers"), rules)
    clinic = F.when(F.col("category").isin(allowed), F.col("clinic"))
    rows = empty.join(clinics.select("tenant", "clinic"), "tenant", "left")
    return rows.select("id", F.coalesce(by, clinic).alias("institution"), F.when(by.isNotNull(), "providers").otherwise("clinic").alias("origin")).where("institution is not null")


def context_backfill(docs: DataFrame, clinics: DataFrame, allowed: list[str]) -> DataFrame:
    """As institution_backfill, from the tenant's clinic alone."""
    return institution_backfill(docs.withColumn("providers", F.array().cast("array<string>")), clinics, [("\u0000", "")], allowed)


def category_audit(docs: DataFrame, doc_types: dict[str, str], advocate: list[str]) -> DataFrame:
    """Rows (id, filename, category, doc_type, name_category) whose category should change, to what and why; the first rule that applies.

    Merged categories, advocates named in the file name, tokens of the name for `other`, and last the type that was
    read from the document, which leaves advocates and references alone.
    """
    low = F.lower("filename")
    is_advocate = F.lit(False)
    for k in advocate:
        is_advocate = is_advocate | low.contains(k)
    merge = mapped(F.col("category"), MERGED)
    wanted = F.coalesce(mapped(F.col("doc_type"), doc_types), F.when(F.col("doc_type").isin(list(TOKENS)), F.col("doc_type")))
    rule = (
        F.when(merge.isNotNull(), F.struct(merge.alias("suggested"), F.lit("legacy_category_merge").alias("reason")))
        .when((F.col("category") != "advocate") & is_advocate, F.struct(F.lit("advocate").alias("suggested"), F.lit("advocate_keyword_in_filename").alias("reason")))
        .when((F.col("category") == "other") & (F.col("name_category") != "other"), F.struct(F.col("name_category").alias("suggested"), F.lit("filename_token_detected").alias("reason")))
        .when(~F.col("category").isin(*STAYING) & (wanted != F.col("category")), F.struct(wanted.alias("suggested"), F.lit("document_type").alias("reason")))
    )
    return docs.select("id", "category", rule.alias("r")).where("r is not null").select("id", "category", "r.suggested", "r.reason")


def category_upgrade(docs: DataFrame) -> DataFrame:
    """id and category, with merged categories renamed and `other` replaced by the valid category that the metadata names."""
    meta = F.get_json_object("metadata", "$.category")
    valid = meta.isin([c for c in TOKENS if c != "other"])
    new = F.coalesce(mapped(F.col("category"), {"surgical_report": "surgery"}), F.when((F.col("category") == "other") & valid, meta), F.col("category"))
    return docs.select("id", new.alias("category"), (new != F.col("category")).alias("changed"))


def date_disagreements(docs: DataFrame, most: int = 30) -> DataFrame:
    """Documents whose file name and extracted date lie more than so many days apart."""
    far = F.abs(F.datediff("document_date", name_date(F.col("filename"))))
    return docs.withColumns({"name_date": name_date(F.col("filename")), "days": far}).where(F.col("days") > most)
