"""The queries of this subpackage, by name, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.llm import collocations, decontaminate, htmltext, langid, linededup, minhash, ngramjoin, pieces, secrets, sharding, suffixdedup, syncmers, tries
from medlake.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns and what the network adds."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.labelled_sample(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_char")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur elsewhere."""
    return suffixdedup.digest(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents; a document without any has no row."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every document and of its edited text."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, or one within two edits of it."""
    return linededup.digest(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document, as hashes of their ids, and the round trip of the best."""
    return pieces.encode_digest(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on shingles of two words."""
    return minhash.duplicates(table(spark, sf_dir, "documents"), 2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return tries.nodes(table(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the Jaccard join of all documents at 0.9, on shingles of three words."""
    return ngramjoin.joined(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_secrets that the fixed patterns decide."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_fingerprints that no hash of anchors decides."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document as op5_sharding counts it, and how many have its checksum and size: equal texts."""
    rows = op5_sharding(spark, sf_dir)
    same = rows.groupBy("size", "text_crc32").agg(F.count(F.lit(1)).alias("equal_texts"))
    return rows.join(same, ["size", "text_crc32"]).select("doc_id", "size", "equal_texts")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_language": op2_language,
    "op3_main_text": op3_main_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_pieces": op9_pieces,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_ngram_join": op13_ngram_join,
    "secrets_base": secrets_base,
    "edited_texts": edited_texts,
    "shard_sizes": shard_sizes,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: SQL for what SQL can express: near duplicates as a whole, the fixed patterns of the secret scan, the edited texts of
#: the fingerprints, and sizes and text equality of the shards.  The rest is held against plain versions in the tests.
ORACLES: dict[str, str] = {
    "op10_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM t),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.id, x.b FROM r JOIN both_ways x ON x.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM t JOIN c ON c.id = t.doc_id""",
    "op11_collocations": f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d),
g AS (SELECT lang, len(ws) AS m, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM g, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= m),
f AS (SELECT lang, k, phrase, count(*) AS f FROM p GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
u AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT u.lang, u.m, u.phrase, u.a, u.k, x.f AS l, y.f AS r, n.n, (1000 * u.a::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score FROM u
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:u.k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[u.k + 1:], ' ') JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM h)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000""",
    "op12_conversation_trie": """WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
z(conv_id, s, i, crc) AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295::BIGINT FROM t
 UNION ALL SELECT conv_id, s, i + 1, CASE WHEN i % 8 = 0 THEN CASE WHEN xor(crc, ascii(s[i // 8 + 1])::BIGINT) % 2 = 1 THEN xor(xor(crc, ascii(s[i // 8 + 1])::BIGINT) >> 1, 3988292384::BIGINT) ELSE xor(crc, ascii(s[i // 8 + 1])::BIGINT) >> 1 END
  WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END FROM z WHERE i < 8 * length(s)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295::BIGINT) % 6 AS h FROM z WHERE i = 8 * length(s)),
b AS (SELECT c.conv_id, t.pos, {'role': t.role, 'text': t.text} AS x FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
 UNION ALL SELECT c.conv_id, t.pos, {'role': t.role, 'text': t.text} FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT c.conv_id, coalesce(list(b.x ORDER BY b.pos) FILTER (b.pos IS NOT NULL), []) AS path FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY 1),
v AS (SELECT conv_id, len(path) AS len, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
n AS (SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, list(conv_id ORDER BY conv_id) FILTER (len = depth) AS ends FROM v GROUP BY 1, 2),
w AS (SELECT *, node[1:depth - 1] AS up, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth].text) END AS saved FROM n),
k AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM w WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT w.depth AS d, w.node, w.saved, k.n_children IS NULL AS leaf, unnest(range(0, w.depth + 1)) AS depth FROM w LEFT JOIN k ON k.up = w.node AND k.depth = w.depth),
s AS (SELECT depth, node[1:depth] AS node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM a GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(w.ends, ','), '')) AS ends_sha256
FROM w JOIN s ON s.depth = w.depth AND s.node = w.node LEFT JOIN k ON k.depth = w.depth AND k.up = w.node LEFT JOIN n u ON w.depth > 0 AND u.depth = w.depth - 1 AND u.node = w.up""",
    "op13_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM t),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.id, x.b FROM r JOIN both_ways x ON x.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM t JOIN c ON c.id = t.doc_id""",
    "secrets_base": """WITH k(nth, kind, re) AS (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'access', '(AKIA[A-Z0-9]+)'), (2, 'hex', '([0-9a-f]{32,})')),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, 0 AS nth, 'assign' AS kind, string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gaps, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
  regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS vals, 8 AS least FROM d
 UNION ALL SELECT doc_id, 1, 'access', string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 16 FROM d
 UNION ALL SELECT doc_id, 2, 'hex', string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), 32 FROM d),
u AS (SELECT doc_id, nth, kind, gaps, hits, vals, least, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(list_filter(vals, lambda v: length(v) >= least)) > 0),
s AS (SELECT doc_id, nth, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start, length(hits[i]) AS n FROM u WHERE length(vals[i]) >= least),
j AS (SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, nth) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN j ON j.doc_id = d.doc_id""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM d)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2)) AS edited_sha256 FROM n""",
    "shard_sizes": """SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS equal_texts FROM documents""",
}
