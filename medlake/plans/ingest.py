"""Registered queries of sources, inserts, text scalars and reports over stored values, with their oracle SQL; registry imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.functions import scalars as S
from medlake.operators import archive, filters, folders, hygiene, naming, relations, services, usage
from medlake.plans.state import TREE_SQL, fresh, tree
from medlake.plans.upkeep import ALIASES, CALLS_SQL, CODES, FILES_SQL, IN_STANDARD, KEYWORDS, PERSON, call_rows, file_rows
from medlake.session import dealt, table
from medlake.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


# -- sources -------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT 'source=' || source AS s, 'lang=' || lang AS l FROM documents WHERE text <> '')
SELECT s || '/' || l AS path, l AS name, 1 AS files FROM p UNION SELECT s, s, 0 FROM p UNION SELECT '', '', 0 FROM p""")
def listed_folders(spark, d):
    """Documents as text files, a folder a source and language, listed again: folders with the number of files right in them."""
    path = fresh(spark, "listed")
    docs = table(spark, d, "documents").where("text <> ''").select("source", "lang", "text")
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    rows = files.folder(spark, path).select("relative")
    inside = rows.groupBy(F.regexp_replace("relative", "/?[^/]*$", "").alias("path")).agg(F.count(F.lit(1)).alias("files"))
    return files.folders(rows).join(inside, "path", "left").select("path", "name", F.coalesce("files", F.lit(0)).alias("files"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || chr(10) || text ELSE text END AS text FROM conversations WHERE conv_id % 7 <> 3 AND text NOT LIKE '[%'""")
def transcripts(spark, d):
    """Conversations as lines of JSON, some of them broken, some with blocks for text, read back as plain text."""
    path = fresh(spark, "transcripts")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), "text")))
    rows = table(spark, d, "conversations").where("text not like '[%'").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, blocks).otherwise(F.col("text")).alias("content"))
    line = F.to_json(F.struct("conv_id", "turn", "content"))
    rows.select(F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("{"), line)).otherwise(line)).write.text(path)
    return files.jsonl(spark, path, "conv_id long, turn long, content string").select("conv_id", "turn", files.content_text("content").alias("text"))


_PLACES_SQL = "array_to_string(list_transform(range(1, least(p_size % 8, 5) + 1), lambda i: 'site' || i || ', Town' || (p_size % 3)), '; ')"


def _trials(spark, d):
    """Parts as trials of the registry's shape."""
    place = lambda i: F.struct(F.concat(F.lit("site"), i.cast("string")).alias("facility"), F.concat(F.lit("Town"), (F.col("p_size") % 3).cast("string")).alias("city"), F.lit(None).cast("string").alias("country"))
    sites = F.filter(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(i.alias("i"), place(i).alias("p"))), lambda x: x["i"] <= F.col("p_size") % 8)
    phases = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 4 == 1, F.array(F.lit("PHASE2"), F.lit("PHASE3"))).otherwise(F.array(F.lit("PHASE1")))
    section = F.struct(
        F.struct(F.concat(F.lit("NCT"), "p_partkey").alias("nctId"), F.col("p_name").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.when(F.col("p_size") % 5 != 0, "RECRUITING").alias("overallStatus")).alias("statusModule"), F.struct(phases.alias("phases")).alias("designModule"),
        F.struct(F.split("p_type", " ").alias("conditions")).alias("conditionsModule"), F.struct(F.transform(sites, lambda x: x["p"]).alias("locations")).alias("contactsLocationsModule"),
    )
    return files.trial_rows(table(spark, d, "part").select(F.to_json(F.struct(section.alias("protocolSection"))).alias("j")), "j")


@query(f"""SELECT 'NCT' || p_partkey AS trial, p_name AS title, CASE WHEN p_size % 5 <> 0 THEN 'RECRUITING' END AS status, CASE WHEN p_size % 4 = 1 THEN 'PHASE2' WHEN p_size % 4 > 1 THEN 'PHASE1' END AS phase, replace(p_type, ' ', '|') AS conditions, {_PLACES_SQL} AS places FROM part""")
def trial_listing(spark, d):
    return _trials(spark, d).select("trial", "title", "status", "phase", F.array_join("conditions", "|").alias("conditions"), F.array_join("places", "; ").alias("places"))


@query(f"""WITH t AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 5 <> 0 THEN 'RECRUITING' END AS status, CASE WHEN p_size % 4 = 1 THEN 'PHASE2' WHEN p_size % 4 > 1 THEN 'PHASE1' END AS phase, {_PLACES_SQL} AS places, string_split(p_type, ' ')[1:5] AS c FROM part)
SELECT 'NCT' || p_partkey AS external_id, p_name AS title, array_to_string(list_filter([status, phase, places], lambda x: x IS NOT NULL), ' | ') AS summary,
 CAST(to_json(list_filter(c || [lower(phase), lower(status)], lambda x: x IS NOT NULL)) AS VARCHAR) AS tags FROM t""")
def trial_research(spark, d):
    return files.trial_entries(_trials(spark, d)).select("external_id", "title", "summary", "tags")


# -- inserts and extraction ------------------------------------------------------------------


@query("""WITH b AS (SELECT l_suppkey, l_partkey, max(l_orderkey) AS first_seen FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), n AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_seen FROM lineitem GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT n.* FROM n ANTI JOIN b ON b.l_suppkey = n.l_suppkey AND b.l_partkey = n.l_partkey""")
def inserted_references(spark, d):
    """Cross references inserted in bulk: pairs that are there keep what they say."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    rows = dealt(rows, rows.count(), "l_suppkey", "l_partkey")  # for both groupings and the join
    there = rows.where("l_linenumber = 1").groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").alias("first_seen"))
    return relations.insert_missing(there, rows.groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("first_seen")), ["l_suppkey", "l_partkey"])


@query("""WITH e AS (SELECT event_id AS id, event_type, value, unnest([1, 2]) AS nth FROM events WHERE event_id % 9 <> 0)
SELECT id, event_type || nth AS parameter, CASE WHEN nth = 1 AND id % 3 = 0 THEN DATE '2024-01-05' WHEN id % 2 = 0 THEN DATE '2024-01-06' ELSE DATE '2024-01-07' END AS lab_date, CAST(id % 50 AS DOUBLE) + CASE WHEN nth = 1 THEN 0.5 ELSE 0 END AS value FROM e WHERE NOT (nth = 2 AND id % 4 = 0)""")
def extracted_labs(spark, d):
    """Values out of metadata: the block's date before the metadata's before the document's; what is no number is left out."""
    i = F.col("event_id")
    block = lambda n, day, value: F.struct(day.alias("date"), F.concat("event_type", F.lit(str(n))).alias("parameter"), value.alias("value"), F.lit("u").alias("unit"))
    labs = F.array(
        block(1, F.when(i % 3 == 0, "2024-01-05"), F.concat((i % 50).cast("string"), F.lit(",5"))),
        block(2, F.when(i % 5 == 0, "not a date"), F.when(i % 4 == 0, "negative").otherwise((i % 50).cast("string"))),
    )
    meta = F.to_json(F.struct(F.when(i % 2 == 0, "2024-01-06").alias("date"), labs.alias("labs")))
    docs = table(spark, d, "events").select(i.alias("id"), F.when(i % 9 == 0, "{broken").otherwise(meta).alias("metadata"), F.lit("2024-01-07").alias("document_date"))
    return services.extracted_values(docs, "metadata", "document_date").select("id", "parameter", "lab_date", "value")


# -- predicates ------------------------------------------------------------------------------


@query("""SELECT 'all' AS scope, count(*) AS n FROM events UNION ALL SELECT 'one', count(*) FROM events WHERE user_id = 7 UNION ALL SELECT 'blank', 0""")
def optional_tenant(spark, d):
    """All rows without a tenant, those of one, and those of the blank one, which has none here."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("tenant"))
    parts = [filters.for_tenant(rows, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("scope"), "n") for s, t in (("all", None), ("one", "7"), ("blank", ""))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%r_d%' OR p_type ILIKE '%r_d%'""")
def wildcard_filter(spark, d):
    """Per cent signs and underscores of a search are wildcards."""
    return filters.where_given(table(spark, d, "part"), text="R_d", text_columns=("p_name", "p_type")).select("p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def clamped_page(spark, d):
    """A page of 5000 rows is held to 200."""
    return filters.page(table(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 5000).select("o_orderkey")


@query("""SELECT n.conv_id, n.turn FROM conversations n JOIN documents r ON r.doc_id = n.conv_id WHERE r.source = 'src1' AND r.doc_id % 5 <> 0 AND contains(lower(n.text), 'en')""")
def record_notes(spark, d):
    """Notes of one tenant's live records that hold a text."""
    records = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("tenant"), F.when(F.col("doc_id") % 5 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    notes = table(spark, d, "conversations").withColumnRenamed("conv_id", "record_id")
    return filters.record_notes(notes, records, " EN ".strip(), "src1", "record_id").select(F.col("record_id").alias("conv_id"), "turn")


_LINE_SQL = "CASE event_id % 4 WHEN 0 THEN '2024-01-02 ' || event_type || ' 5' WHEN 1 THEN event_type ELSE event_type || '  ' || (event_id % 90) || '.5 g/l' END"


@query(f"""SELECT user_id, string_agg({_LINE_SQL}, chr(10) ORDER BY event_id) IS NOT NULL AND count(*) FILTER (event_id % 4 >= 2) >= 3 AS has_table FROM events GROUP BY 1""")
def lab_tables(spark, d):
    """Texts made of events of a user: with three lines or more of a name and a number they hold a table; lines that start with a date do not count."""
    i = F.col("event_id")
    line = F.when(i % 4 == 0, F.concat(F.lit("2024-01-02 "), "event_type", F.lit(" 5"))).when(i % 4 == 1, F.col("event_type")).otherwise(F.concat("event_type", F.lit("  "), (i % 90).cast("string"), F.lit(".5 g/l")))
    lines = table(spark, d, "events").select("user_id", F.struct("event_id", line.alias("line")).alias("x"))
    texts = lines.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    return texts.select("user_id", archive.has_lab_table().alias("has_table"))


MONTHS_SQL = "m AS (SELECT id, parent, CASE WHEN id = -1 THEN 'root' WHEN id % 4 = 0 THEN 'labs' WHEN id % 4 = 1 THEN 'private' ELSE '2024-0' || (id % 9 + 1) END AS name FROM f)"


def _months(spark, d):
    i = F.col("id")
    name = F.when(i == -1, "root").when(i % 4 == 0, "labs").when(i % 4 == 1, "private").otherwise(F.concat(F.lit("2024-0"), (i % 9 + 1).cast("string")))
    return tree(spark, d).select("id", "parent", name.alias("name"))


@query(f"""WITH RECURSIVE {TREE_SQL}, {MONTHS_SQL} SELECT c.id, CASE WHEN p.name LIKE '2024-%' THEN 'month_in_month' ELSE 'no_category' END AS why FROM m c JOIN m p ON p.id = c.parent WHERE c.name LIKE '2024-%' AND p.name <> 'labs'""")
def misplaced_months(spark, d):
    """Month folders below another month, or below what is no category."""
    return services.misplaced_folders(_months(spark, d), ["labs"]).select("id", "why")


@query(f"""WITH RECURSIVE {TREE_SQL.split(',' + chr(10))[0]}, {MONTHS_SQL}, t AS (SELECT id, lower(name) AS folded FROM m WHERE parent IS NULL UNION ALL SELECT m.id, t.folded || chr(1) || lower(m.name) FROM m JOIN t ON m.parent = t.id),
n AS (SELECT t.id, folded, (SELECT count(*) FROM m x WHERE x.parent = t.id) AS children FROM t), k AS (SELECT folded, arg_max(id, (children, -id)) AS keeper FROM n GROUP BY 1 HAVING count(*) > 1),
tw AS (SELECT n.id, k.keeper FROM n JOIN k ON k.folded = n.folded WHERE n.id <> k.keeper), kept AS (SELECT m.* FROM m ANTI JOIN tw ON tw.id = m.id),
items AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN -99 ELSE l_orderkey END AS parent FROM lineitem),
ch AS (SELECT id, parent FROM m UNION ALL SELECT id, parent FROM items), loose AS (SELECT ch.* FROM ch ANTI JOIN tw ON tw.id = ch.id),
mo AS (SELECT c.id, c.parent, p.name AS above FROM kept c JOIN m p ON p.id = c.parent WHERE c.name LIKE '2024-%'), ne AS (SELECT id, parent FROM mo WHERE above LIKE '2024-%')
SELECT 'merge' AS op, id, keeper AS target FROM tw UNION ALL SELECT 'trash', id, NULL FROM tw UNION ALL SELECT 'reparent', loose.id, tw.keeper FROM loose JOIN tw ON tw.id = loose.parent
UNION ALL SELECT 'raise', loose.id, ne.parent FROM loose JOIN ne ON ne.id = loose.parent UNION ALL SELECT 'trash_nested', id, NULL FROM ne
UNION ALL SELECT 'category', id, NULL FROM mo WHERE above NOT LIKE '2024-%' AND above <> 'labs' UNION ALL SELECT 'consolidate', id, -1 FROM items WHERE parent = -99""")
def folder_repairs(spark, d):
    """The plan that mends a tree of months: twins merged, nested months raised, strays marked, items outside the tree consolidated."""
    line = F.col("l_linenumber")
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("id"), F.when(line == 7, F.lit(-99).cast("long")).otherwise(F.col("l_orderkey")).alias("parent"))
    return folders.repair_plan(_months(spark, d), items, ["labs"])


# -- scalars ----------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, event_type, ts FROM events) SELECT event_id, lower(CASE WHEN event_id % 2 = 0 THEN event_type || '@x.org' ELSE 'Plain@x.org' END) AS sender,
 CASE WHEN event_id % 3 = 0 THEN '{"a": ' || event_id || '}' ELSE event_type END AS bare, regexp_replace(event_type || ' (' || event_id || ')/x', '[^A-Za-z0-9._-]+', '_', 'g') AS slug,
 CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS seen, CASE WHEN event_id % 5 = 0 THEN 'k1=old' WHEN event_id % 5 = 1 THEN 'k1=new,k2=x' ELSE 'k1=old,k2=x' END AS merged FROM e""")
def text_scalars(spark, d):
    """Senders, bare texts, slugs, times in ISO form with Z, an offset or none, and merged maps."""
    i, kind = F.col("event_id"), F.col("event_type")
    mail = F.when(i % 2 == 0, F.concat(F.lit("Some One <"), F.upper(kind), F.lit("@X.org>"))).otherwise(F.lit(" Plain@x.org "))
    fenced = F.when(i % 3 == 0, F.concat(F.lit('```json\n{"a": '), i.cast("string"), F.lit("}\n```"))).otherwise(kind)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ahead = F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i % 4 == 0, F.concat(at, F.lit("Z"))).when(i % 4 == 1, F.concat(ahead, F.lit("+02:00"))).when(i % 4 == 2, at).otherwise(F.lit("yesterday"))
    pair = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    new = F.when(i % 5 == 0, pair("k1", "old")).when(i % 5 == 1, pair("k1", "new", "k2", "x")).otherwise(pair("k2", "x"))
    merged = S.merged_maps(pair("k1", "old"), new)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    # told in UTC; a time without an offset is one of the session's zone
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), S.iso_time(text).cast("timestamp_ntz"))
    seen = F.when(i % 4 == 2, S.iso_time(text).cast("timestamp_ntz")).otherwise(utc)
    return table(spark, d, "events").select(
        "event_id", S.sender(mail).alias("sender"), S.without_fence(fenced).alias("bare"), S.slug(F.concat(kind, F.lit(" ("), i.cast("string"), F.lit(")/x"))).alias("slug"),
        seen.alias("seen"), shown.alias("merged"),
    )


@query("""WITH t AS (SELECT doc_id, replace(replace(replace(substr(text, 1, 200), 'e', 'é'), 'a', 'ǎ'), 'fi', 'ﬁ') || ' ł ß ①' AS t, substr(text, 1, 200) || ' ł ß 1' AS plain FROM documents) SELECT doc_id, lower(strip_accents(replace(replace(t, 'ﬁ', 'fi'), '①', '1'))) AS folded FROM t""")
def folded_letters(spark, d):
    """Letters composed, combined and in ligatures, without their marks; strokes and sharp s stay."""
    head = F.substring("text", 1, 200)
    t = F.concat(F.replace(F.replace(F.replace(head, F.lit("e"), F.lit("é")), F.lit("a"), F.lit("ǎ")), F.lit("fi"), F.lit("ﬁ")), F.lit(" ł ß ①"))
    return table(spark, d, "documents").select("doc_id", S.fold(t).alias("folded"))


# -- names of files, parsed by both engines ------------------------------------------------------

#: Names put together of five parts each, by the digits of doc_id: some 700 shapes.
SHAPED = """concat(CASE WHEN doc_id % 4 = 0 THEN concat('202401', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) WHEN doc_id % 4 = 1 THEN '202402XX' WHEN doc_id % 4 = 2 THEN concat('2024-3-', CAST(doc_id % 28 + 1 AS STRING)) ELSE '20241399' END,
 CASE WHEN floor(doc_id / 4) % 4 = 0 THEN '_AnnaTest_' WHEN floor(doc_id / 4) % 4 = 1 THEN ' AnnaTest-' WHEN floor(doc_id / 4) % 4 = 2 THEN '_' ELSE ' annatest-' END,
 CASE WHEN floor(doc_id / 16) % 4 = 0 THEN 'Alpha' WHEN floor(doc_id / 16) % 4 = 1 THEN 'elm' WHEN floor(doc_id / 16) % 4 = 2 THEN 'Unknown' ELSE 'Foo' END,
 CASE WHEN floor(doc_id / 64) % 5 = 0 THEN '_Labs_' WHEN floor(doc_id / 64) % 5 = 1 THEN '-Blood-' WHEN floor(doc_id / 64) % 5 = 2 THEN '_xyz_' WHEN floor(doc_id / 64) % 5 = 3 THEN '_usg_' ELSE '_' END,
 CASE WHEN floor(doc_id / 7) % 4 = 0 THEN 'letter one' WHEN floor(doc_id / 7) % 4 = 1 THEN 'scan_1' WHEN floor(doc_id / 7) % 4 = 2 THEN 'x-y' ELSE 'AnnaTest' END, CASE WHEN doc_id % 3 = 0 THEN '.PDF' WHEN doc_id % 3 = 1 THEN '.docx' ELSE '' END)"""


def _one_of(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _infer(value: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({value}), '{k}') THEN '{v}'" for k, v in KEYWORDS) + " ELSE 'other' END"


_CODE = _one_of("lower({0})", {c.lower(): c for c in CODES})
_DATE = "(\\d{8}|\\d{6}XX|\\d{4}-\\d{1,2}-\\d{1,2})"
NAMES_SQL = f"""n AS (SELECT doc_id AS id, {SHAPED} AS name FROM documents), s AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS st, nullif(lower(regexp_extract(name, '(\\.[^./]+)$', 1)), '') AS extension,
 CASE WHEN regexp_matches(name, '^\\d{{6}}XX') THEN CAST(try_strptime(substr(name, 1, 6) || '01', '%Y%m%d') AS DATE) WHEN regexp_matches(name, '^\\d{{8}}') THEN coalesce(CAST(try_strptime(substr(name, 1, 8), '%Y%m%d') AS DATE), CAST(try_strptime(substr(name, 1, 6) || '01', '%Y%m%d') AS DATE))
  ELSE CAST(try_strptime(regexp_extract(name, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})', 1), '%Y-%m-%d') AS DATE) END AS date FROM n),
p AS (SELECT *, string_split(regexp_replace(st, '^{_DATE}[_]*', ''), '_') AS p, string_split(regexp_replace(regexp_replace(st, '^{_DATE}[ _-]*', ''), '^(?i:{PERSON})-*', ''), '-') AS q0,
 list_filter(string_split_regex(CASE WHEN date IS NULL THEN st ELSE regexp_replace(st, '^{_DATE}[_ -]*', '') END, '[_\\-\\s]+'), lambda w: w <> '') AS w FROM s),
q AS (SELECT *, CASE WHEN len(q0) > 2 THEN [q0[1], q0[2], array_to_string(q0[3:], '-')] ELSE q0 END AS q FROM p),
f AS (SELECT *, CASE WHEN date IS NOT NULL AND (contains(st, '_{PERSON}_') OR starts_with(st, '{PERSON}_')) AND len(p) >= 2 AND lower(p[1]) = '{PERSON.lower()}' THEN 'standard' WHEN date IS NOT NULL AND contains(st, ' ') AND contains(lower(st), '{PERSON.lower()}') THEN 'bilingual' ELSE 'legacy' END AS form,
 {_one_of('lower(p[3])', naming.BY_TOKEN)} AS token, list_transform(w, lambda x: {_CODE.format('x')}) AS codes FROM q),
g AS (SELECT *, nullif(array_to_string(CASE WHEN token IS NULL THEN p[3:] ELSE p[4:] END, '_'), '') AS std, nullif(coalesce(q[3], q[2], q[1]), '') AS bil, list_position(list_transform(codes, lambda x: x IS NOT NULL), true) AS pos FROM f),
h AS (SELECT *, CASE WHEN pos > 0 THEN list_concat(w[1:pos - 1], w[pos + 1:]) ELSE w END AS left_over FROM g), k AS (SELECT *, list_transform(left_over, lambda x: {_one_of('lower(x)', ALIASES)}) AS kinds FROM h),
l AS (SELECT *, list_position(list_transform(kinds, lambda x: x IS NOT NULL), true) AS named FROM k), m AS (SELECT *, nullif(array_to_string(CASE WHEN named > 0 THEN list_concat(left_over[1:named - 1], left_over[named + 1:]) ELSE left_over END, ' '), '') AS free FROM l)"""


@query(f"""WITH {NAMES_SQL} SELECT id, name, form, date, extension, CASE form WHEN 'standard' THEN CASE WHEN len(p) >= 3 THEN p[2] END WHEN 'bilingual' THEN CASE WHEN len(q) >= 2 THEN coalesce({_CODE.format('q[1]')}, q[1]) END ELSE CASE WHEN pos > 0 THEN codes[pos] END END AS institution,
 CASE form WHEN 'standard' THEN CASE WHEN len(p) < 3 THEN 'other' ELSE coalesce(token, {_infer("coalesce(std, '')")}) END WHEN 'bilingual' THEN {_infer("coalesce(bil, '')")} ELSE CASE WHEN named > 0 THEN kinds[named] ELSE {_infer("coalesce(free, '')")} END END AS category,
 CASE form WHEN 'standard' THEN CASE WHEN len(p) >= 3 THEN std END WHEN 'bilingual' THEN bil ELSE free END AS description FROM m""")
def name_shapes(spark, d):
    """Names of several hundred shapes by the three grammars."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(SHAPED).alias("name"))
    return rows.select("id", "name", naming.parsed_name(F.col("name"), PERSON, CODES, ALIASES, KEYWORDS).alias("x")).select("id", "name", "x.*")


@query(f"""WITH {NAMES_SQL}, r AS (SELECT *, string_split(regexp_extract(st, '^\\d{{8}}_{PERSON}_(.*)$', 1), '_') AS r FROM p)
SELECT id, coalesce(len(r) >= 2 AND r[1] <> 'Unknown' AND {_one_of('lower(r[2])', naming.BY_TOKEN)} IS NOT NULL, false) AS is_standard, length(name) > 255 OR (length(st) - length(replace(st, '{PERSON}', ''))) / {len(PERSON)} >= 3 AS is_corrupt FROM r""")
def name_checks(spark, d):
    """Which of these names are standard, and which are corrupt."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(SHAPED).alias("name"))
    return rows.select("id", naming.is_standard_name(F.col("name"), PERSON).alias("is_standard"), naming.is_corrupt_name(F.col("name"), PERSON).alias("is_corrupt"))


# -- reports -----------------------------------------------------------------------------------

_BLANKED = "d AS (SELECT id, filename, CASE WHEN id % 5 = 1 THEN '' ELSE summary END AS summary, metadata, remote_id, document_date, institution FROM files)"


@query(f"""WITH {FILES_SQL}, {_BLANKED} SELECT count(*) AS total_documents, count(*) FILTER (summary <> '') AS with_ai_summary, count(*) FILTER (metadata <> '') AS with_structured_metadata, count(*) FILTER (document_date IS NOT NULL) AS with_date,
 count(*) FILTER (institution <> '') AS with_institution, count(*) FILTER (remote_id <> '') AS synced_to_gdrive, count(*) FILTER ({IN_STANDARD}) AS standard_filename,
 count(*) FILTER (summary <> '' AND metadata <> '' AND remote_id <> '' AND document_date IS NOT NULL AND institution <> '' AND {IN_STANDARD}) AS fully_complete FROM d""")
def stage_counts(spark, d):
    """How many documents have passed each stage; an empty text is none."""
    docs = file_rows(spark, d).withColumn("summary", F.when(F.col("id") % 5 == 1, "").otherwise(F.col("summary")))
    return hygiene.stage_counts(docs, PERSON)


_WEEK = "ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30'"


@query(f"""WITH {CALLS_SQL}, w AS (SELECT * FROM c WHERE {_WEEK}), s AS (SELECT call_type, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM w GROUP BY 1),
t AS (SELECT call_type, count(*) AS calls FROM w GROUP BY 1 ORDER BY calls DESC, call_type LIMIT 2),
r AS (SELECT count(*) AS runs, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-08')
SELECT 'weekly_2024-01-30' AS key, '{{"prompts":' || CAST((SELECT to_json(list({{'call_type': call_type, 'calls': calls, 'errors': errors, 'tokens_in': tokens_in}} ORDER BY call_type)) FROM s) AS VARCHAR)
 || ',"tools":' || CAST((SELECT to_json(list({{'call_type': call_type, 'calls': calls}} ORDER BY calls DESC, call_type)) FROM t) AS VARCHAR)
 || ',"pipeline":' || CAST((SELECT to_json({{'runs': runs, 'ok': ok, 'failed': failed}}) FROM r) AS VARCHAR) || '}}' AS value UNION ALL SELECT 'weekly_2024-01-23', 'kept'""")
def weekly_state(spark, d):
    """The week's prompts, tools and pipeline runs under one key, upserted into the stored state."""
    now = F.expr("timestamp_ntz'2024-01-30 00:00:00'")
    runs = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"))
    week = runs.where("ts >= timestamp_ntz'1998-01-01' and ts < timestamp_ntz'1998-01-08'").withColumn("ts", F.expr("timestamp_ntz'2024-01-24 00:00:00'"))
    state = spark.createDataFrame([("weekly_2024-01-23", "kept"), ("weekly_2024-01-30", "old")], "key string, value string")
    return relations.upsert(state, usage.whole_snapshot(call_rows(spark, d), week, now, 7, 2), "key", [])
