"""Registered queries of naming, hygiene, groups and further reports, with their oracle SQL; registry imports them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from medlake.functions import scalars as S
from medlake.operators import archive, filters, folders, groups, hygiene, labs, naming, relations, usage
from medlake.plans.services import CALLS, DAILY_SQL, LABS_SQL, call_rows, lab_rows
from medlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


# -- documents as the archive's files: expressions that both engines read alike ------------

PERSON, CODES = "AnnaTest", ["Alpha", "KestrelClinic", "ELM"]
NAMES = {"alpha labs": "Alpha", "kestrel": "KestrelClinic", "elm institute": "ELM"}
ALIASES = {"labs": "labs", "blood": "labs", "ct": "imaging", "recheck": "consultation"}
KEYWORDS = [("scan", "imaging"), ("blood", "labs"), ("letter", "report")]
FILE = {
    "id": "doc_id",
    "filename": """CASE WHEN doc_id % 6 = 0 THEN concat('202401', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '_AnnaTest_Alpha_Labs_Blood', CAST(doc_id AS STRING), '.pdf')
 WHEN doc_id % 6 = 1 THEN concat('202402', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), ' AnnaTest-ELM-Letter', CAST(doc_id AS STRING), '.pdf')
 WHEN doc_id % 6 = 2 THEN concat('2024-3-', CAST(doc_id % 28 + 1 AS STRING), '_alpha_recheck_note ', CAST(doc_id AS STRING), '.docx')
 WHEN doc_id % 6 = 3 THEN concat('free scan ', CAST(doc_id AS STRING), '.jpg')
 WHEN doc_id % 6 = 4 THEN concat('20240401_AnnaTest_Unknown_Report_x', CAST(doc_id AS STRING), '.pdf')
 ELSE concat('20240501_AnnaTest_AnnaTest_counsel_AnnaTest', CAST(doc_id AS STRING), '.pdf') END""",
    "category": "CASE WHEN doc_id % 7 = 0 THEN 'surgical_report' WHEN doc_id % 7 < 4 THEN 'other' WHEN doc_id % 7 = 4 THEN 'advocate' ELSE 'labs' END",
    "doc_type": "CASE WHEN doc_id % 5 = 0 THEN 'lab_report' WHEN doc_id % 5 = 1 THEN 'imaging' WHEN doc_id % 5 = 2 THEN 'nonsense' END",
    "mime": "CASE WHEN doc_id % 4 = 0 THEN 'application/pdf' WHEN doc_id % 4 = 1 THEN 'text/csv' WHEN doc_id % 4 = 2 THEN 'image/png' END",
    "summary": "CASE WHEN doc_id % 3 <> 0 THEN source END",
    "metadata": """CASE WHEN doc_id % 8 = 0 THEN '' WHEN doc_id % 8 = 1 THEN '{"findings":["x"],"category":"imaging"}' WHEN doc_id % 8 = 2 THEN '{"findings":[],"diagnoses":["d"]}'
 WHEN doc_id % 8 = 3 THEN '{"findings":[]}' WHEN doc_id % 8 = 4 THEN '{"category":"nonsense"}' END""",
    "remote_id": "CASE WHEN doc_id % 9 <> 0 THEN concat('r', CAST(doc_id AS STRING)) END",
    "sync_state": "CASE WHEN doc_id % 10 = 0 THEN 'pending' WHEN doc_id % 10 = 1 THEN 'deleted_remote' ELSE 'synced' END",
    "outside": "doc_id % 13 = 0",
    "institution": "CASE WHEN doc_id % 4 = 1 THEN 'Alpha' WHEN doc_id % 4 = 2 THEN '' END",
    "tenant": "doc_id % 11",
    "document_date": "CASE WHEN doc_id % 12 <> 0 THEN CAST('2024-03-01' AS DATE) END",
    "n_chars": "n_chars",
}
FILES_SQL = "files AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FILE.items()) + " FROM documents), pages_read AS (SELECT DISTINCT doc_id AS id FROM labels)"


def file_rows(spark, d):
    return table(spark, d, "documents").select(*(F.expr(e).alias(c) for c, e in FILE.items()))


def read_pages(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"))


def flagged(spark, d):
    return hygiene.flags(file_rows(spark, d), read_pages(spark, d), PERSON)


IN_STANDARD = "(regexp_matches(filename, '^\\d{8}_AnnaTest_[^_.]*_(labs|Labs|Report|report)(_|\\.|$)') AND filename NOT LIKE '%\\_AnnaTest\\_Unknown\\_%' ESCAPE '\\')"
FLAGGED_SQL = f"""{FILES_SQL}, fl AS (SELECT f.*, p.id IS NOT NULL AS has_ocr, summary IS NOT NULL AS has_ai, coalesce(metadata <> '', false) AS has_metadata, remote_id IS NOT NULL AS is_synced,
 {IN_STANDARD} AS is_standard, document_date IS NOT NULL AS has_date, institution IS NOT NULL AS has_institution FROM files f LEFT JOIN pages_read p ON p.id = f.id),
m AS (SELECT *, has_ocr AND has_ai AND has_metadata AND is_synced AND is_standard AND has_date AND has_institution AS complete FROM fl)"""


@query(f"""WITH {FILES_SQL}, s AS (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS st, regexp_extract(filename, '\\.[^.]*$') AS ext FROM files)
SELECT id, CASE id % 6 WHEN 0 THEN 'standard' WHEN 4 THEN 'standard' WHEN 5 THEN 'standard' WHEN 1 THEN 'bilingual' ELSE 'legacy' END AS form,
 CASE id % 6 WHEN 2 THEN make_date(2024, 3, CAST(id % 28 + 1 AS INT)) WHEN 3 THEN NULL ELSE CAST(strptime(substr(st, 1, 8), '%Y%m%d') AS DATE) END AS date,
 CASE id % 6 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'ELM' WHEN 2 THEN 'Alpha' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'AnnaTest' END AS institution,
 CASE id % 6 WHEN 0 THEN 'labs' WHEN 1 THEN 'report' WHEN 2 THEN 'consultation' WHEN 3 THEN 'imaging' WHEN 4 THEN 'report' ELSE 'other' END AS category,
 CASE id % 6 WHEN 0 THEN 'Blood' || id WHEN 1 THEN 'Letter' || id WHEN 2 THEN 'note ' || id WHEN 3 THEN 'free scan ' || id WHEN 4 THEN 'x' || id ELSE 'counsel_AnnaTest' || id END AS description, ext AS extension FROM s""")
def parsed_names(spark, d):
    parsed = naming.parsed_name(F.col("filename"), PERSON, CODES, ALIASES, KEYWORDS)
    return file_rows(spark, d).select("id", parsed.alias("p")).select("id", "p.*")


@query(f"""WITH {FILES_SQL} SELECT id, CASE id % 6 WHEN 1 THEN regexp_replace(filename, '^(\\d{{8}}) AnnaTest-ELM-(.*)$', '\\1_AnnaTest_ELM_Report_\\2')
 WHEN 2 THEN strftime(make_date(2024, 3, CAST(id % 28 + 1 AS INT)), '%Y%m%d') || '_AnnaTest_Alpha_Consultation_note ' || id || '.docx'
 WHEN 5 THEN '20240501_AnnaTest_AnnaTest_Other_counsel_AnnaTest' || id || '.pdf' ELSE filename END AS new_name FROM files""")
def standard_names(spark, d):
    parsed = naming.parsed_name(F.col("filename"), PERSON, CODES, ALIASES, KEYWORDS)
    return file_rows(spark, d).select("id", naming.standard_name(F.col("filename"), parsed, PERSON).alias("new_name"))


@query(f"""WITH {FILES_SQL} SELECT count(*) AS files, count(*) FILTER ({IN_STANDARD}) AS standard, count(*) FILTER (length(filename) > 255 OR (length(filename) - length(replace(filename, 'AnnaTest', ''))) / 8 >= 3) AS corrupt FROM files""")
def name_audit(spark, d):
    c = F.col("filename")
    return file_rows(spark, d).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(naming.is_standard_name(c, PERSON)).alias("standard"), F.count_if(naming.is_corrupt_name(c, PERSON)).alias("corrupt")
    )


@query(f"""WITH {FILES_SQL} SELECT id, regexp_replace(filename, '\\.[^.]*$', '') || '_Part' || (id % 3 + 1) || 'of3' || regexp_extract(filename, '\\.[^.]*$') AS part_name FROM files""")
def part_names(spark, d):
    once = naming.with_part(F.col("filename"), F.lit(9), F.lit(9))  # an earlier mark is replaced
    return file_rows(spark, d).select("id", naming.with_part(once, F.col("id") % 3 + 1, F.lit(3)).alias("part_name"))


@query(f"""WITH {FILES_SQL} SELECT id, CASE WHEN id % 6 IN (0, 4) THEN replace(filename, '_AnnaTest_', '_Eve_') ELSE filename END AS new_name FROM files""")
def name_swaps(spark, d):
    return file_rows(spark, d).select("id", naming.owner_swapped(F.col("filename"), [PERSON, "Eve"], F.lit("Eve")).alias("new_name"))


@query(f"""WITH {FILES_SQL}, x AS (SELECT id, CASE id % 6 WHEN 0 THEN CAST(strptime(substr(filename, 1, 8), '%Y%m%d') AS DATE) WHEN 1 THEN CAST(strptime(substr(filename, 1, 8), '%Y%m%d') AS DATE)
 WHEN 2 THEN make_date(2024, 3, CAST(id % 28 + 1 AS INT)) WHEN 4 THEN DATE '2024-04-01' WHEN 5 THEN DATE '2024-05-01' END AS name_date, document_date FROM files)
SELECT id, name_date, CAST(abs(date_diff('day', name_date, document_date)) AS INT) AS days FROM x WHERE abs(date_diff('day', name_date, document_date)) > 30""")
def date_disagreements(spark, d):
    return naming.date_disagreements(file_rows(spark, d)).select("id", "name_date", "days")


PROVIDERS = [("lumen", "Lumen"), ("kestrel", "KestrelClinic"), ("halcyon", "ELM")]
PROVIDER_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'Klinika KESTREL a.s.' WHEN doc_id % 5 = 1 THEN 'Štátny Halcyónový ústav' WHEN doc_id % 5 = 2 THEN 'Bory, LUMEN' ELSE source END"


@query(f"""WITH {FILES_SQL}, p AS (SELECT doc_id AS id, {PROVIDER_SQL} AS provider FROM documents)
SELECT id, CASE WHEN id % 5 = 0 THEN 'KestrelClinic' WHEN id % 5 = 1 THEN 'ELM' WHEN id % 5 = 2 THEN 'Lumen' ELSE 'clinic' || tenant END AS institution,
 CASE WHEN id % 5 < 3 THEN 'providers' ELSE 'clinic' END AS origin FROM files WHERE coalesce(institution, '') = '' AND (id % 5 < 3 OR (category IN ('other', 'advocate') AND tenant < 8))""")
def institution_backfill(spark, d):
    docs = file_rows(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.expr(PROVIDER_SQL)).alias("providers")), "id")
    clinics = spark.range(8).select(F.col("id").alias("tenant"), F.concat(F.lit("clinic"), "id").alias("clinic"))
    return naming.institution_backfill(docs, clinics, PROVIDERS, ["other", "advocate"])


@query(f"""WITH {FILES_SQL} SELECT id, 'clinic' || tenant AS institution, 'clinic' AS origin FROM files WHERE coalesce(institution, '') = '' AND category IN ('other', 'advocate') AND tenant < 8""")
def context_backfill(spark, d):
    clinics = spark.range(8).select(F.col("id").alias("tenant"), F.concat(F.lit("clinic"), "id").alias("clinic"))
    return naming.context_backfill(file_rows(spark, d), clinics, ["other", "advocate"])


@query(f"""WITH {FILES_SQL}, n AS (SELECT *, CASE id % 6 WHEN 0 THEN 'labs' WHEN 1 THEN 'report' WHEN 2 THEN 'consultation' WHEN 3 THEN 'imaging' WHEN 4 THEN 'report' ELSE 'other' END AS named,
 CASE doc_type WHEN 'lab_report' THEN 'labs' WHEN 'imaging' THEN 'imaging' END AS wanted FROM files)
SELECT id, category, CASE WHEN category = 'surgical_report' THEN 'surgery' WHEN category <> 'advocate' AND contains(filename, 'counsel') THEN 'advocate' WHEN category = 'other' AND named <> 'other' THEN named ELSE wanted END AS suggested,
 CASE WHEN category = 'surgical_report' THEN 'legacy_category_merge' WHEN category <> 'advocate' AND contains(filename, 'counsel') THEN 'advocate_keyword_in_filename' WHEN category = 'other' AND named <> 'other' THEN 'filename_token_detected' ELSE 'document_type' END AS reason
FROM n WHERE category = 'surgical_report' OR (category <> 'advocate' AND contains(filename, 'counsel')) OR (category = 'other' AND named <> 'other') OR (category <> 'advocate' AND wanted <> category)""")
def category_audit(spark, d):
    parsed = naming.parsed_name(F.col("filename"), PERSON, CODES, ALIASES, KEYWORDS)
    return naming.category_audit(file_rows(spark, d).withColumn("name_category", parsed["category"]), {"lab_report": "labs"}, ["counsel", "advocate"])


@query(f"""WITH {FILES_SQL}, n AS (SELECT id, category, CASE WHEN category = 'surgical_report' THEN 'surgery' WHEN category = 'other' AND id % 8 = 1 THEN 'imaging' ELSE category END AS new FROM files)
SELECT id, new AS category, new <> category AS changed FROM n""")
def category_upgrade(spark, d):
    return naming.category_upgrade(file_rows(spark, d))


# -- completeness ------------------------------------------------------------------------


@query(f"""WITH {FLAGGED_SQL} SELECT count(*) AS total, {", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in (*hygiene.FLAGS, "complete"))} FROM m""")
def document_matrix_summary(spark, d):
    return hygiene.matrix_summary(flagged(spark, d))


@query(f"WITH {FLAGGED_SQL}, one AS (SELECT id, substr(filename, 1, 60) AS filename, {', '.join(hygiene.FLAGS)}, complete FROM m) " + " UNION ALL ".join(
    f"SELECT '{name}' AS kept_by, * FROM one" + (f" WHERE NOT {flag}" if flag else "") for name, flag in hygiene.FILTERS.items()
))
def document_matrix(spark, d):
    return hygiene.matrices(flagged(spark, d))


AUDITED_SQL = f"""{FLAGGED_SQL}, au AS (SELECT * REPLACE (has_ocr OR (has_ai AND has_metadata) AS has_ocr), mime IS NULL OR mime <> 'text/csv' AS can FROM m),
w AS (SELECT *, (NOT can OR (has_ocr AND has_ai AND has_metadata)) AND has_date AND has_institution AND is_synced AND is_standard AS whole FROM au)"""


@query(f"""WITH {AUDITED_SQL} SELECT count(*) FILTER (can AND NOT has_ocr) AS missing_ocr, count(*) FILTER (can AND NOT has_ai) AS missing_ai, count(*) FILTER (can AND NOT has_metadata) AS missing_metadata,
 count(*) FILTER (NOT can) AS non_extractable_skipped, count(*) FILTER (NOT has_date) AS missing_date, count(*) FILTER (NOT has_institution) AS missing_institution, count(*) FILTER (NOT is_synced) AS not_synced,
 count(*) FILTER (NOT is_standard) AS not_standard_named, count(*) FILTER (outside) AS external_location, count(*) FILTER (sync_state = 'deleted_remote') AS deleted_remote, count(*) FILTER (whole) AS fully_complete FROM w""")
def gap_counters(spark, d):
    return hygiene.gap_counters(flagged(spark, d))


WHY_SQL = """concat_ws(',', CASE WHEN can AND NOT has_ocr THEN 'no_ocr' END, CASE WHEN can AND NOT has_ai THEN 'no_ai' END, CASE WHEN can AND NOT has_metadata THEN 'no_metadata' END, CASE WHEN NOT has_date THEN 'no_date' END,
 CASE WHEN NOT has_institution THEN 'no_institution' END, CASE WHEN NOT is_synced THEN 'not_synced' END, CASE WHEN NOT is_standard THEN 'not_standard_named' END)"""


@query(f"WITH {AUDITED_SQL} SELECT id, {WHY_SQL} AS reasons FROM w WHERE NOT whole AND {WHY_SQL} <> ''")
def stuck_documents(spark, d):
    return hygiene.stuck(flagged(spark, d)).select("id", F.array_join("reasons", ",").alias("reasons"))


LIST_SQL = """concat_ws(',', CASE WHEN NOT is_standard THEN 'non_standard_name' END, CASE WHEN NOT is_synced THEN 'not_exported' END, CASE WHEN NOT has_ai THEN 'no_summary' END, CASE WHEN NOT has_ocr THEN 'no_ocr' END,
 CASE WHEN outside THEN 'not_in_folder' END)"""


@query(f"WITH {FLAGGED_SQL} SELECT id, {LIST_SQL} AS reasons FROM m WHERE {LIST_SQL} <> ''")
def gap_list(spark, d):
    return hygiene.gap_list(flagged(spark, d), ~F.col("outside")).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {FILES_SQL} SELECT 'metadata' AS queue, id FROM files WHERE id % 8 NOT IN (1, 2) UNION ALL SELECT 'unprocessed', id FROM files WHERE summary IS NULL
UNION ALL SELECT 'pending_sync', id FROM files WHERE remote_id IS NULL OR sync_state = 'pending' UNION ALL SELECT 'readable', id FROM files WHERE mime IS NULL OR mime <> 'text/csv'
UNION ALL SELECT 'listed', id FROM files WHERE category IN ('labs', 'advocate') UNION ALL SELECT 'not_system', id FROM files WHERE sync_state <> 'pending'""")
def work_queues(spark, d):
    f = file_rows(spark, d)
    parts = {
        "metadata": hygiene.metadata_queue(f), "unprocessed": hygiene.unprocessed(f, "summary"), "pending_sync": hygiene.pending_sync(f), "readable": f.where(hygiene.extractable()),
        "listed": filters.in_list(f, "category", ["labs", "advocate"]), "not_system": filters.without_prefix(f, "sync_state", "pend"),
    }
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("queue"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT conv_id AS id, count(*) AS pages FROM conversations GROUP BY 1 HAVING count(*) >= 2")
def page_counts(spark, d):
    return hygiene.page_counts(table(spark, d, "conversations").select(F.col("conv_id").alias("id")))


@query("SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def page_texts(spark, d):
    return hygiene.page_texts(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page_number"), "text"))


@query(f"""WITH {FILES_SQL} SELECT id, remote_id, CASE WHEN id % 3 = 0 THEN 'missing' WHEN id % 5 = 0 THEN 'deleted_remote' ELSE 'external' END AS state FROM files
WHERE remote_id IS NOT NULL AND (id % 3 = 0 OR id % 5 = 0 OR id % 7 = 0)""")
def missing_upstream(spark, d):
    f = file_rows(spark, d).withColumn("root", F.lit("home"))
    remote = f.where("id % 3 <> 0 and remote_id is not null").select("remote_id", F.when(F.expr("id % 7 = 0"), "other").otherwise("home").alias("root"), F.expr("id % 5 = 0").alias("trashed"))
    return hygiene.missing_upstream(f, remote)


# -- tags, notes and joins ---------------------------------------------------------------

TAGS_SQL = """CASE WHEN doc_id % 4 = 0 THEN '["a","b"]' WHEN doc_id % 4 = 1 THEN '["b","c"]' WHEN doc_id % 4 = 2 THEN 'not json' END"""


@query("""SELECT doc_id, doc_id % 4 = 0 AS has_both, CASE doc_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b' ELSE '' END AS shared FROM documents""")
def tag_predicates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(TAGS_SQL).alias("tags"))
    return rows.select("doc_id", filters.has_all_tags("tags", ["a", "b"]).alias("has_both"), F.array_join(filters.shared_tags("tags", ["a", "b"]), ",").alias("shared"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'thtion be')")
def notes_search(spark, d):
    return filters.notes(table(spark, d, "conversations"), " THTION be ").select("conv_id", "turn")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_acctbal > 0")
def active_pairs(spark, d):
    return relations.active_pairs(table(spark, d, "orders").where("o_orderstatus = 'O'"), table(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


LINKS_SQL = "l AS (SELECT doc_id AS source, doc_id * 7 % 1009 AS target, CASE WHEN doc_id % 2 = 0 THEN 'same' ELSE 'follows' END AS relationship, (doc_id % 10) / 10 AS confidence FROM documents)"


@query(f"""WITH {LINKS_SQL}, n AS (SELECT source AS id, target AS other, relationship, confidence FROM l UNION ALL SELECT target, source, relationship, confidence FROM l)
SELECT n.id, n.other, o.lang AS other_lang, relationship, confidence FROM n JOIN documents a ON a.doc_id = n.id JOIN documents o ON o.doc_id = n.other WHERE n.id <> n.other AND a.n_chars > 50 AND o.n_chars > 50""")
def resolved_neighbours(spark, d):
    docs = table(spark, d, "documents")
    links = docs.select(
        F.col("doc_id").alias("source"), (F.col("doc_id") * 7 % 1009).alias("target"), F.when(F.expr("doc_id % 2 = 0"), "same").otherwise("follows").alias("relationship"), ((F.col("doc_id") % 10) / 10).alias("confidence")
    )
    live = docs.where("n_chars > 50").select(F.col("doc_id").alias("id"), "lang")
    return relations.resolved_neighbours(links, live, ["lang"])


@query(f"""WITH {FILES_SQL}, listing AS (SELECT CASE WHEN id % 2 = 0 THEN regexp_replace(filename, '\\.[^.]*$', '') || '_OCR.txt' WHEN id % 3 = 0 THEN 'stray' || id || '_OCR.txt' ELSE filename END AS name FROM files)
SELECT name FROM listing WHERE name LIKE 'stray%'""")
def stray_companions(spark, d):
    f = file_rows(spark, d)
    name = F.when(F.expr("id % 2 = 0"), F.concat(naming.stem(F.col("filename")), F.lit("_OCR.txt"))).when(F.expr("id % 3 = 0"), F.concat(F.lit("stray"), "id", F.lit("_OCR.txt"))).otherwise(F.col("filename"))
    return groups.unexpected(f.select(name.alias("name")), f)


@query("""SELECT lang, source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars, doc_id) AS ids FROM documents GROUP BY 1, 2 HAVING count(*) >= 2""")
def duplicate_members(spark, d):
    return relations.group_members(table(spark, d, "documents"), ["lang", "source"], ["n_chars", "doc_id"], "doc_id").select("lang", "source", "n", F.array_join("ids", ",").alias("ids"))


# -- reports -----------------------------------------------------------------------------

RANGES = [("view", 10.0, 60.0), ("click", None, 40.0)]


@query(f"""WITH {DAILY_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY tenant, parameter ORDER BY lab_date DESC) AS n FROM daily),
two AS (SELECT tenant, parameter, max(CASE WHEN n = 1 THEN lab_date END) AS latest_date, max(CASE WHEN n = 1 THEN value END) AS latest, max(CASE WHEN n = 2 THEN lab_date END) AS previous_date, max(CASE WHEN n = 2 THEN value END) AS previous FROM nth WHERE n <= 2 GROUP BY ALL),
i AS (SELECT tenant, max(latest) FILTER (parameter = 'view') AS n, max(latest) FILTER (parameter = 'click') AS p, max(latest) FILTER (parameter = 'purchase') AS y FROM two GROUP BY 1)
SELECT two.tenant, parameter, latest_date, latest, previous_date, previous, CASE WHEN previous IS NULL THEN 'insufficient_data' WHEN latest > previous * 1.05::DOUBLE THEN 'rising' WHEN latest < previous * 0.95::DOUBLE THEN 'falling' ELSE 'stable' END AS trend,
 CASE WHEN parameter NOT IN ('view', 'click') THEN 'no_range' WHEN parameter = 'view' AND latest < 10 THEN 'low' WHEN (parameter = 'view' AND latest > 60) OR (parameter = 'click' AND latest > 40) THEN 'high' ELSE 'normal' END AS status,
 CAST(date_diff('day', latest_date, DATE '2024-02-10') AS INT) AS days_ago, CASE WHEN y > 0 THEN round(n * p / y, 4) END AS immune_index, CASE WHEN y > 0 THEN round(n / y, 4) END AS ratio FROM two JOIN i USING (tenant)""")
def lab_report(spark, d):
    ranges = spark.createDataFrame(RANGES, "parameter string, low double, high double")
    return labs.report(lab_rows(spark, d), ranges, F.lit(date(2024, 2, 10)), "view", "click", "purchase")


@query(f"""WITH l AS ({LABS_SQL}) SELECT l.tenant, l.lab_date, l.value, l.id, CASE WHEN d.doc_id IS NOT NULL THEN 'https://pubmed.ncbi.nlm.nih.gov/' || d.doc_id || '/' END AS url
FROM l LEFT JOIN documents d ON d.doc_id = l.id WHERE parameter = 'purchase' AND lab_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def lab_trends(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.record_url(F.lit("pubmed"), F.col("doc_id").cast("string")).alias("url"))
    return labs.trends(lab_rows(spark, d), docs, "purchase", F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 20))).select("tenant", "lab_date", "value", "id", "url")


@query(f"""WITH {DAILY_SQL}, last AS (SELECT tenant, parameter, arg_max(value, lab_date) AS v FROM daily GROUP BY ALL), s AS (SELECT tenant, CASE WHEN v < 20 THEN 'green' WHEN v < 50 THEN 'yellow' WHEN v < 80 THEN 'red' ELSE 'missing' END AS status FROM last)
SELECT tenant, count(*) FILTER (status = 'green') AS green, count(*) FILTER (status = 'yellow') AS yellow, count(*) FILTER (status = 'red') AS red, count(*) FILTER (status = 'missing') AS missing FROM s GROUP BY 1""")
def status_counts(spark, d):
    v = F.col("latest")
    status = F.when(v < 20, "green").when(v < 50, "yellow").when(v < 80, "red").otherwise("missing")
    return labs.status_counts(labs.summary(lab_rows(spark, d)).select("tenant", status.alias("status")))


CALLS_SQL = f"c AS ({CALLS})"


@query(f"""WITH {CALLS_SQL} SELECT tenant, CAST(round(coalesce(sum(CAST(cost_usd AS DECIMAL(18,8))), 0), 4) AS DOUBLE) AS cost_usd, count(*) AS calls FROM c WHERE status = 'ok' AND ts >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1""")
def ai_cost_of_a_day(spark, d):
    return usage.ai_cost(call_rows(spark, d), F.expr("timestamp_ntz'2024-01-30 12:00:00'"), 24, ["tenant"])


@query(f"""WITH {CALLS_SQL}, b AS (SELECT *, CAST(CASE WHEN cost_usd > 0 THEN cost_usd ELSE tokens_in * (0.8 / 1e6)::DOUBLE + tokens_out * (4.0 / 1e6)::DOUBLE END AS DECIMAL(18,8)) AS m FROM c),
g AS (SELECT call_type, m, tokens_in, tokens_out, status FROM b UNION ALL SELECT '_total', m, tokens_in, tokens_out, status FROM b)
SELECT call_type, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) FILTER (status = 'error') AS errors, CAST(round(sum(m), 4) AS DOUBLE) AS cost_usd,
 round(count(*) FILTER (status = 'error') / count(*), 4) AS error_rate FROM g GROUP BY 1""")
def prompt_stats_with_total(spark, d):
    return usage.stats_with_total(call_rows(spark, d))


@query(f"""WITH {CALLS_SQL}, t AS (SELECT call_type, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM c
 WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT 'weekly_2024-01-30' AS key, '[' || string_agg('{{"call_type":"' || call_type || '","calls":' || calls || ',"errors":' || errors || ',"tokens_in":' || tokens_in || '}}', ',' ORDER BY call_type) || ']' AS value FROM t""")
def weekly_snapshot(spark, d):
    return usage.snapshot(call_rows(spark, d), F.expr("timestamp_ntz'2024-01-30 00:00:00'"))


@query(f"""WITH {CALLS_SQL}, g AS (SELECT call_type, duration_ms FROM c UNION ALL SELECT '_overall', duration_ms FROM c)
SELECT call_type, count(*) AS calls, CAST(round_even(quantile_cont(duration_ms, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS BIGINT) AS p95,
 CAST(round_even(quantile_cont(duration_ms, 0.99), 0) AS BIGINT) AS p99 FROM g GROUP BY 1""")
def latency_histogram(spark, d):
    return usage.exact_percentiles(call_rows(spark, d))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey DESC LIMIT 40 OFFSET 10")
def nulls_last_page(spark, d):
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return filters.page(table(spark, d, "orders"), [day.desc_nulls_last(), F.desc("o_orderkey")], 40, 10).select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50""")
def priority_page(spark, d):
    return filters.page(table(spark, d, "orders"), [filters.by_rank("o_orderstatus", ["F", "O"]), F.desc("o_totalprice"), F.col("o_orderkey")], 50).select("o_orderkey", "o_orderstatus")


FIVE_SQL = """SELECT 'orders' AS source, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS title, o_orderstatus AS summary, CAST(o_orderkey AS VARCHAR) AS ref FROM orders
UNION ALL SELECT 'events', CAST(ts AS DATE), event_type, props, CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT 'talks', make_date(2024, 1, CAST(turn % 28 + 1 AS INT)), role, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, CAST(conv_id AS VARCHAR) FROM conversations
UNION ALL SELECT 'papers', make_date(2024, 2, CAST(doc_id % 28 + 1 AS INT)), lang, source, CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'labs', CAST(min(l_shipdate) AS DATE), 'results', CAST(count(*) AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey"""


def five_legs(spark, d):
    ref = lambda c: F.col(c).cast("string").alias("ref")
    return archive.timeline(
        orders=table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"), ref("o_orderkey")),
        events=table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("title"), F.col("props").alias("summary"), ref("event_id")),
        talks=table(spark, d, "conversations").select(F.expr("make_date(2024, 1, cast(turn % 28 + 1 as int))").alias("day"), F.col("role").alias("title"), F.col("text").alias("summary"), ref("conv_id")),
        papers=table(spark, d, "documents").select(F.expr("make_date(2024, 2, cast(doc_id % 28 + 1 as int))").alias("day"), F.col("lang").alias("title"), F.col("source").alias("summary"), ref("doc_id")),
        labs=table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("day"), F.count(F.lit(1)).cast("string").alias("summary")).select("day", F.lit("results").alias("title"), "summary", ref("l_orderkey")),
    )


@query(FIVE_SQL)
def five_way_timeline(spark, d):
    return five_legs(spark, d)


@query(f"""WITH t AS ({FIVE_SQL}) SELECT * FROM t WHERE source IN ('orders', 'labs', 'talks') AND (contains(lower(title), 'urgent') OR contains(lower(summary), 'urgent')) ORDER BY day DESC, source, ref, summary LIMIT 60 OFFSET 5""")
def timeline_search(spark, d):
    return archive.timeline_page(five_legs(spark, d), ["orders", "labs", "talks"], "URGENT", 60, 5)


@query("""SELECT strftime(day, '%Y-%m') AS month, string_agg('- ' || strftime(day, '%Y-%m-%d') || ' ' || title, chr(10) ORDER BY day, title) AS markdown FROM
 (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type AS title FROM events UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), o_orderpriority FROM orders) GROUP BY 1""")
def treatment_timeline(spark, d):
    a = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("title")).distinct()
    return archive.month_log(a.unionByName(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title")).distinct()))


@query("""SELECT source AS topic, '## ' || source || chr(10) || string_agg('- [' || lang || '] ' || doc_id, chr(10) ORDER BY coalesce(lang, ''), doc_id) AS markdown FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1""")
def research_library(spark, d):
    rows = table(spark, d, "documents").where("lang is not null and source is not null")
    return archive.library(rows.select(F.col("source").alias("topic"), F.col("lang").alias("kind"), F.col("doc_id").alias("ref")))


# -- upkeep ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INT) AS place FROM lineitem QUALIFY true")
def group_members(spark, d):
    return groups.members(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query(f"""WITH {FILES_SQL}, p AS (SELECT conv_id AS id, turn, CASE WHEN turn % 2 = 0 THEN 'labs' ELSE 'report' END AS category, CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN 0.5 ELSE 0.9 END AS confidence FROM conversations),
k AS (SELECT id, count(*) AS total FROM p GROUP BY 1 HAVING count(*) >= 2 AND min(confidence) >= 0.7), n AS (SELECT p.*, total, row_number() OVER (PARTITION BY p.id ORDER BY turn) AS nth FROM p JOIN k USING (id))
SELECT n.id AS source_id, n.id AS group_id, CAST(nth AS INT) AS part_number, CAST(total AS INT) AS total_parts, n.category, regexp_replace(filename, '\\.[^.]*$', '') || '_Part' || nth || 'of' || total || regexp_extract(filename, '\\.[^.]*$') AS filename FROM n JOIN files f ON f.id = n.id""")
def split_documents(spark, d):
    c = table(spark, d, "conversations")
    parts = c.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("part"), F.when(F.expr("turn % 2 = 0"), "labs").otherwise("report").alias("category"), F.when(F.expr("conv_id % 4 = 0 and turn = 0"), 0.5).otherwise(0.9).alias("confidence")
    )
    return groups.split(file_rows(spark, d).select("id", "filename"), parts)


@query("""WITH p AS (SELECT l_orderkey AS grp, l_linenumber AS part_number, l_partkey, CAST(l_shipdate AS DATE) AS day, l_returnflag AS place FROM lineitem),
b AS (SELECT grp, CASE WHEN count(*) = 1 THEN 'single_member' WHEN date_diff('day', min(day), max(day)) > 7 THEN 'date_span' WHEN count(DISTINCT trim(place)) > 1 THEN 'institutions' END AS defect FROM p GROUP BY 1)
SELECT CASE WHEN defect IS NULL THEN p.grp END AS grp, CASE WHEN defect IS NULL THEN part_number END AS part_number, l_partkey, day, place, defect FROM p JOIN b USING (grp)""")
def repaired_groups(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("part_number"), "l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("place"))
    return groups.repaired(rows, "grp", "day", "place")


@query("SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'error') THEN -1 ELSE o_custkey END AS tenant FROM orders")
def reassigned_rows(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant"))
    return groups.reassigned(rows, table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id")), -1)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 0 AND c_custkey % 20 < 14 THEN 'free' WHEN c_mktsegment = 'BUILDING' THEN 'free_onboarding' ELSE c_mktsegment END AS tier FROM customer")
def tier_transition(spark, d):
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "free_onboarding").otherwise(F.col("c_mktsegment"))
    ends = F.when(F.expr("c_custkey % 3 <> 0"), F.expr("date_add(date'2024-01-01', cast(c_custkey % 20 as int))"))
    return groups.after_onboarding(table(spark, d, "customer").select("c_custkey", tier.alias("tier"), ends.alias("onboarding_ends_at")), F.lit(date(2024, 1, 15))).select("c_custkey", "tier")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS nth FROM events")
def audit_history(spark, d):
    return groups.history(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "nth")


@query("""SELECT event_id AS run_id, ts AS started_at, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 90 SECOND END AS finished_at, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN event_type <> 'view' THEN 90.0::DOUBLE END AS duration_s FROM events""")
def run_records(spark, d):
    e = table(spark, d, "events")
    done = e.where("event_type <> 'view'").select(F.col("event_id").alias("run_id"), F.expr("ts + interval 90 seconds").alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return groups.completed_runs(e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at")), done)


@query("""WITH base AS (SELECT n_nationkey AS tenant, r_name AS vaccine FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT tenant, vaccine FROM base
UNION ALL SELECT n_nationkey, r_name FROM nation, region WHERE n_regionkey <> r_regionkey""")
def reference_clone(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    base = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("tenant"), F.col("r_name").alias("vaccine"))
    return groups.cloned(base, r.select(F.col("r_name").alias("vaccine")), n.select(F.col("n_nationkey").alias("tenant")), ["vaccine"])


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 5 THEN p_partkey // 4 END AS parent, p_brand AS name FROM part),
t AS (SELECT id, name AS path, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name, depth + 1 FROM f JOIN t ON f.parent = t.id) SELECT * FROM t""")
def folder_tree(spark, d):
    parent = F.when(F.col("p_partkey") > 5, F.floor(F.col("p_partkey") / 4))
    return folders.paths(table(spark, d, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.col("p_brand").alias("name")))


@query("""WITH b AS (SELECT o_custkey AS tenant, o_orderstatus AS category, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS names FROM orders GROUP BY 1, 2),
s AS (SELECT tenant, string_agg(category || ':' || names, ';' ORDER BY category) AS documents FROM b GROUP BY 1),
t AS (SELECT user_id AS tenant, string_agg(strftime(CAST(ts AS DATE), '%Y-%m-%d') || ' ' || event_type, ',' ORDER BY CAST(ts AS DATE), event_type) AS timeline FROM events GROUP BY 1) SELECT * FROM s FULL JOIN t USING (tenant)""")
def document_package(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").cast("string").alias("filename"))
    events = table(spark, d, "events").select(F.col("user_id").alias("tenant"), F.to_date("ts").alias("day"), F.col("event_type").alias("title"))
    shelf = F.transform(F.map_entries("documents"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ",")))
    line = F.transform("timeline", lambda x: F.concat_ws(" ", F.date_format(x["day"], "yyyy-MM-dd"), x["title"]))
    return groups.package(docs, events).select("tenant", F.array_join(shelf, ";").alias("documents"), F.array_join(line, ",").alias("timeline"))


@query("SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders WHERE o_orderkey % 50 <> 0) AS now_rows UNION ALL SELECT 'region', (SELECT count(*) FROM region), NULL")
def restore_check(spark, d):
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    return groups.restore_check(archive.manifest(orders=o, nation=n, region=table(spark, d, "region")), archive.manifest(orders=o.where("o_orderkey % 50 <> 0"), nation=n))


@query("""SELECT c_custkey AS tenant, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN c_name ELSE 'none' END AS context, CASE WHEN c_custkey % 2 = 0 THEN 'stored' WHEN c_custkey % 3 = 0 THEN 'file' ELSE 'default' END AS origin FROM customer""")
def tenant_context(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "tenant")
    return groups.context(c, c.where("tenant % 2 = 0").select("tenant", F.col("c_mktsegment").alias("context")), c.where("tenant % 3 = 0").select("tenant", F.col("c_name").alias("context")), "none")


# -- scalars -----------------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://drive.google.com/file/d/' || doc_id || '/view' WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' WHEN 2 THEN 'https://clinicaltrials.gov/study/NCT' || doc_id END AS url,
 replace('<x>' || coalesce(source, '') || '</x>', '</x>', '</x_>') AS safe, sha256('system' || chr(0) || coalesce(lang, '') || chr(1) || 'user' || chr(0) || coalesce(source, '') || chr(1) || 'model' || chr(0) || coalesce(text, '')) AS hash,
 CASE WHEN doc_id % 3 = 0 THEN 'BRCA1' WHEN doc_id % 3 = 1 THEN 'TP53' ELSE 'unknown' END AS gene FROM documents""")
def record_scalars(spark, d):
    source = F.element_at(F.array(*map(F.lit, ("drive", "PubMed", "ClinicalTrials.gov", "else"))), (F.col("doc_id") % 4 + 1).cast("int"))
    gene = F.element_at(F.array(F.lit(" brca1 "), F.lit("Tp53"), F.lit("odd")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", S.record_url(source, F.concat(F.when(F.expr("doc_id % 4 = 2"), "NCT").when(F.expr("doc_id % 8 = 1"), "PMID:").otherwise(""), F.col("doc_id").cast("string"))).alias("url"), S.without_closing_tag(F.concat(F.lit("<x>"), F.coalesce("source", F.lit("")), F.lit("</x>")), "x").alias("safe"),
        S.prompt_hash(F.col("lang"), F.col("source"), F.col("text")).alias("hash"), S.known_or_unknown(gene, ["BRCA1", "TP53"]).alias("gene"),
    )


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) - CAST(event_id % 20000 AS INT) AS born, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, CAST(date_sub('year', born, day) AS INT) AS age, CASE WHEN born BETWEEN DATE '1990-01-01' AND DATE '2020-12-31' THEN born END AS plausible_born FROM e""")
def ages_and_bounds(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.date_sub(F.to_date("ts"), (F.col("event_id") % 20000).cast("int")).alias("born"))
    return e.select("event_id", S.age_in_years(F.col("born"), F.col("day")).alias("age"), S.plausible(F.col("born"), F.lit(date(1990, 1, 1)), F.lit(date(2020, 12, 31))).alias("plausible_born"))
