"""Document fingerprints (operator 2): threshold-scaled shingle sketches.

A text's words are its maximal runs of non-white-space, lower-cased; its
shingles are all runs of five words (a shorter text is one shingle, a text
without words has none). The sketch keeps every shingle hash below a fixed
fraction of the hash range, so the sketch of a union is the union of the
sketches (mergeable), and the share of a small text's sketch found in a much
larger one's estimates containment without a size limit on either.

The hash is the MD5 of the shingle, of which the sketch holds the first 16
hexadecimal digits (64 bits). A fingerprint is ``<head>:<hash><hash>...``: the
first 8 digits of the MD5 of the word sequence, then the sketch in ascending
order. The head tells apart texts too short to have a retained hash.

All functions return Columns of built-in functions: whole texts are sketched
in place, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.session import materialize

SHINGLE_WORDS = 5
#: Share of the hash range that a sketch keeps: 1/2.
FRACTION = 1 / 2
DIGITS = 16
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _threshold(fraction: float) -> str:
    """Smallest hash, as hexadecimal digits, that is not kept."""
    cut = round(fraction * 16 ** DIGITS)
    return "g" if cut >= 16 ** DIGITS else format(cut, f"0{DIGITS}x")


def sketch_of_words(words: Column, fraction: float = FRACTION) -> Column:
    """Ascending retained shingle hashes of an array of words."""
    n, cut = SHINGLE_WORDS, _threshold(fraction)

    def hash_at(w: Column, i: Column) -> Column:
        return F.substring(F.md5(F.array_join(F.slice(w, i, n), " ").cast("binary")), 1, DIGITS)

    def sketch(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        kept = F.filter(F.transform(starts, lambda i: hash_at(w, i)), lambda h: h < F.lit(cut))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(kept)))

    return sketch(words)


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; none for NULL."""
    raw = F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE)
    return F.filter(raw, lambda w: w != "")


def fingerprint_bytes(words: Column, sketch: Column) -> Column:
    """The head (4 bytes) and the ascending retained hashes (8 bytes each):
    half the size of the digits, which are no shorter when compressed."""
    head = F.substring(F.md5(F.array_join(words, " ").cast("binary")), 1, 8)
    return F.unhex(F.concat(head, F.array_join(sketch, "")))


def fingerprint_text(packed: Column) -> Column:
    """``<head>:<hash><hash>...`` from the bytes."""
    digits = F.lower(F.hex(packed))
    return F.concat(F.substring(digits, 1, 8), F.lit(":"), F.substr(digits, F.lit(9)))


def sketch_in(fingerprint: Column) -> Column:
    """The sketch of a fingerprint text, as an array (in one linear scan)."""
    return F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Containment of the smaller sketch in the larger (0 to 1), of two
    fingerprint texts with their sketches. With an empty sketch on a side: 1
    for equal fingerprints, else 0."""
    least = F.least(F.size(sketch_a), F.size(sketch_b))
    both = F.size(F.array_intersect(sketch_a, sketch_b))
    return F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(both / least)


def with_fingerprint(df: DataFrame, text: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the fingerprint bytes of column ``text`` as column ``out``.
    The words and the sketch are projected one after the other: an expression
    that is used more than once in the next step stays a column of its own."""
    keep = [F.col(c) for c in df.columns]
    w = df.select(*keep, words_of(F.col(text)).alias("__words"))
    s = w.select(*keep, "__words", sketch_of_words(F.col("__words"), fraction).alias("__sketch"))
    return s.select(*keep, fingerprint_bytes(F.col("__words"), F.col("__sketch")).alias(out))


def _next_keys(keys: DataFrame) -> DataFrame:
    """(id, key, n) of each row with ``next``, the key of the following row in
    descending (id, key) order; the last is followed by the first. Keys must be
    distinct.

    The narrow keys are range-partitioned once and stored with their partition
    number; within a partition the next row is a plain ``lead``. The last row
    of each partition continues with the first of the next one: a table of one
    row per partition."""
    order = [F.desc_nulls_last("id"), F.desc("key")]
    cut = materialize(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = cut.select("part", "id", "key", "n", F.lead("key").over(Window.partitionBy("part").orderBy(*order)).alias("follow"))
    # the first row of a partition: the maximum in (id not null, id, key)
    top = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "key")).getField("key")
    heads = cut.groupBy("part").agg(top.alias("head"))
    by_part = Window.orderBy("part")
    # one row per partition: its size is the number of partitions, not of rows
    heads = heads.select("part", F.coalesce(
        F.lead("head").over(by_part),
        F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("jump"))
    return inside.join(heads, "part").select("id", "key", "n", F.coalesce("follow", "jump").alias("next"))


def tail_edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last ``floor(n_chars / 3)`` code points replaced by
    the first as many (or all) code points of the next document in descending
    id order; the last document continues with the first. Returns ``id_col``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    Plan: narrow keys find each document's neighbour; every text is shuffled
    once by its own key, and what its predecessor needs of it (at most a third
    of the predecessor's length, and the fingerprint) once more by the
    predecessor's key. Both joins read the same exchange of the texts, which
    carries no fingerprints: hashes do not compress, so a text's own fingerprint
    is made again after the join instead of being shuffled with it.

    Defined cases: NULL text counts as empty; rows that repeat id and text are
    one document for the order, and each gets the result; equal ids with
    different texts are ordered by row digest, descending; a NULL id comes
    last; a single document is its own neighbour.
    """
    docs = df.select(R.quoted(id_col).alias("id"), F.coalesce(R.quoted(text_col), F.lit("")).alias("text"))
    key = R.digest(F.concat_ws("\x1f", F.coalesce(F.col("id").cast("string"), F.lit("\x1e")), F.col("text")))
    docs = docs.select("id", "text", key.alias("key"))
    ring = _next_keys(docs.select("id", "key", F.char_length("text").alias("n")).distinct())
    # what a document owes to its predecessor
    owed = ring.select(F.col("next").alias("key"), "id", F.col("key").alias("before"),
                       F.floor(F.col("n") / 3).cast("int").alias("take"))
    # the same columns for both joins, so that they share one exchange; ids come back with ``given``
    texts = docs.select("key", "text")
    given = (with_fingerprint(texts.join(owed, "key"), "text", "next_fp", fraction)
             .select(F.col("before").alias("key"), "id", F.substring("text", F.lit(1), F.col("take")).alias("tail"), "next_fp")
             .dropDuplicates(["key"]))
    n = F.char_length("text")
    both = with_fingerprint(texts.join(given, "key"), "text", "fp", fraction).select(
        "id", n.cast("long").alias("n"), "fp", "next_fp",
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("tail")).alias("edited"))
    three = with_fingerprint(both, "edited", "edited_fp", fraction).select(
        "id", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"),
        *[fingerprint_text(F.col(c)).alias(c) for c in ("fp", "edited_fp", "next_fp")])
    sketched = three.select("*", *[sketch_in(F.col(c)).alias(f"{c}_sketch") for c in ("fp", "edited_fp", "next_fp")])

    def near(other: str) -> Column:
        return likeness(F.col("fp"), F.col(other), F.col("fp_sketch"), F.col(f"{other}_sketch"))

    return sketched.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        near("edited_fp").alias("near_edited"), near("next_fp").alias("near_next"))
