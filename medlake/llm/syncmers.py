"""Document fingerprints from closed syncmers over words, in DataFrame functions only.

The symbols are words, the inner substrings S consecutive words and the k-mers K
consecutive words.  A k-mer is an anchor if the smallest hash among its K-S+1 inner
substrings stands first or last; whether it is chosen depends on its own words alone,
so equal passages give equal anchors wherever they stand.  A fingerprint lists the
anchors in text order as position:hash.

Nulls and texts without a word: the empty fingerprint, likeness 1 to another empty one
and 0 to any other.  Texts of fewer than K words: one anchor of the whole word sequence.
Texts of K words or more none of whose k-mers is chosen, which have fewer than 2K-S-1
words: the k-mer of least hash.
Repeated rows: each has its own next row, ties by text.  An empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import broadcast_if_small, whole_text

S, K = 3, 12
#: Letters of scripts that put no space between words are words of their own.
ALONE = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"
WORD = f"[{ALONE}]|[^{ALONE}\\x20\\x09-\\x0D]+"
#: doc_ids to a bucket of neighbours are 2 to this power at most.
BUCKET_BITS = 10
#: Keys that one window over all of them may order.
TOP_KEYS_BITS = 16


def _inner(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def with_anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the anchors of a text column: longs with the hash in the upper and the word position in the lower half."""
    h, s, n = f"__{to}_h", f"__{to}_s", K - S + 1
    df = df.withColumn(h, _inner(F.col(text)))
    df = df.withColumn(
        s, F.transform(F.slice(h, 1, F.greatest(F.size(h) - (S - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    )
    last = F.size(s) - n

    def pack(v: Column, at: Column) -> Column:
        return F.shiftleft(v.bitwiseAND(F.lit(0x7FFFFFFF)), 32) + at.cast("long")

    def chosen(i: Column) -> Column:
        at = [F.get(s, i + j) for j in range(n)]
        return F.least(at[0], at[-1]) <= F.least(*at[1:-1])

    def kmer(i: Column) -> Column:
        return pack(F.xxhash64(*(F.get(s, i + j) for j in range(0, n, S))), i)

    every = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    picked = F.transform(F.filter(every, chosen), kmer)
    # Of K-S k-mers in a row one is chosen; only texts with fewer can have none.
    short = F.when(F.size(picked) > 0, picked).otherwise(F.array(F.array_min(F.transform(every, kmer))))
    return df.withColumn(
        to,
        F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(last < 0, F.array(pack(F.xxhash64(F.col(h)), F.lit(0))))
        .when(last < K - S - 1, short)
        .otherwise(picked),
    ).drop(h, s)


def as_text(anchors: str) -> Column:
    """Anchors as comma-joined position:hash, both in hexadecimal."""
    one = F.transform(anchors, lambda a: F.concat(F.hex(a.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(":"), F.hex(F.shiftright(a, 32))))
    return F.lower(F.array_join(one, ","))


def _hashes(anchors: str) -> Column:
    return F.array_distinct(F.transform(anchors, lambda a: F.shiftright(a, 32)))


def likeness(a: str, b: str) -> Column:
    """Share of the anchors of either text that both have, wherever they stand."""
    x, y = _hashes(a), _hashes(b)
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def shared_anchors(a: str, b: str) -> Column:
    """The anchors that two texts have alike, as (at_a, at_b, hash) by place in the first: equal differences of the places are one shared passage."""
    def packed(x: Column) -> Column:
        return F.struct(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"), F.shiftright(x, 32).alias("hash"))

    mine, theirs = F.transform(a, packed), F.transform(b, packed)
    met = F.transform(mine, lambda x: F.transform(F.filter(theirs, lambda y: y["hash"] == x["hash"]), lambda y: F.struct(x["at"].alias("at_a"), y["at"].alias("at_b"), x["hash"].alias("hash"))))
    return F.flatten(met)


def successors(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """key and next_key of a table of distinct longs that span `bits` bits; the first follows the last.

    Within a group of 2**TOP_KEYS_BITS keys a window finds the next; the last key of a group
    takes the first of the next group, which the same function finds among the groups.
    """
    if bits <= TOP_KEYS_BITS:
        w = Window.orderBy(key)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return keys.select(key, F.coalesce(F.lead(key).over(w), F.first(key).over(whole)).alias("next_key"))
    rows = keys.select(F.col(key).alias("k"), F.shiftright(key, TOP_KEYS_BITS).alias("up"))
    inside = rows.withColumn("n", F.lead("k").over(Window.partitionBy("up").orderBy("k")))
    heads = rows.groupBy("up").agg(F.min("k").alias("head"))
    after = successors(heads.select("up"), "up", bits - TOP_KEYS_BITS)
    starts = after.join(heads.select(F.col("up").alias("next_key"), "head"), "next_key").select("up", "head")
    return inside.join(starts, "up", "left").select(F.col("k").alias(key), F.coalesce("n", "head").alias("next_key"))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row by doc_id; the first row follows the last.

    Rows shuffle once, to buckets of neighbouring doc_ids; the first row of the next bucket comes along as a guest.
    """
    ids = docs.select(F.shiftright("doc_id", BUCKET_BITS).alias("b"), "doc_id")
    heads = ids.groupBy("b").agg(F.min("doc_id").alias("head"))
    low, high, n = heads.agg(F.min("b"), F.max("b"), F.count("b")).first()
    if not n:
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried})
    bits = max(1, (high - low).bit_length() + 1)
    after = successors(heads.select((F.col("b") - low).alias("b")), "b", bits)
    before = after.select((F.col("b") + low).alias("guest_of"), (F.col("next_key") + low).alias("b"))
    guests = heads.join(before, "b").select("guest_of", F.col("head").alias("doc_id"))
    rows = docs.join(broadcast_if_small(guests, n), "doc_id", "left")
    own = F.struct(F.shiftright("doc_id", BUCKET_BITS).alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("guest_of").alias("bucket"), F.lit(1).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    w = Window.partitionBy("at.bucket").orderBy("at.guest", "doc_id", "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return rows.where(F.col("at.guest") == 0).drop("at", "guest_of")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half the start of the next text replaces."""
    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"))
    rows = with_next(with_anchors(own, "text", "anchors"), ["text", "anchors"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring("next_text", F.lit(1), F.col("half"))),
    )
    rows = with_anchors(rows.drop("text", "next_text"), "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
