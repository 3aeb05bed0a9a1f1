"""Line dedup (operator 1): repeated three-line windows across a corpus.

Every run of three consecutive lines is a window. A window that occurs more
than once in the corpus stays where it occurs first (smallest document id,
then text digest, then line number); all lines covered by its later
occurrences are removed. Covered positions of overlapping windows merge, so a
repeated passage of any length goes as a whole. Each removed line has an
earlier occurrence in the same window, so one copy of it always remains.

Plan: windows carry (128-bit window hash, document key, position), never
text, and are stored, since cutting and hashing them is most of the work. One map-side-combined aggregate finds the first occurrence of each
window, an equi-join marks later ones (a hot window is split by AQE, and the
partial aggregate above it needs no grouping), and the covered positions per
document are joined back to the texts.

Defined cases: NULL text stays NULL (0 lines); a text of fewer than three
lines has no window and stays as it is; a window of blank lines only is not
considered; rows that repeat both id and text are one document occurring
twice, so both get the same result; a NULL id comes before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.session import materialize

WINDOW_LINES = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(w, id, key, pos) for every window that has a non-blank line."""
    n = WINDOW_LINES
    lines = docs.select("id", "key", F.split("text", "\n").alias("lines"))
    at = F.posexplode(F.expr(
        f"transform(sequence(0, size(lines) - {n}), i -> array_join(slice(lines, i + 1, {n}), '\n'))"))
    return (lines.filter(F.size("lines") >= n)
            .select("id", "key", at.alias("pos", "window"))
            .filter(F.length(F.trim(F.translate("window", "\n\t\r", "   "))) > 0)
            .select(R.digest(F.col("window")).alias("w"), "id", "key", "pos"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, text without covered lines,
    ``n_lines`` (before) and ``n_removed``."""
    docs = df.select(R.quoted(id_col).alias("id"), R.quoted(text_col).alias("text"))
    docs = docs.select("id", "text", R.digest(F.col("text")).alias("key"))
    wins = materialize(_windows(docs))
    place = F.struct("id", "key", "pos")
    first = (wins.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("w", "first"))
    later = wins.join(first, "w").filter(~place.eqNullSafe(F.col("first")))
    covered = (later.groupBy("id", "key").agg(F.collect_set("pos").alias("starts"))
               .select(F.col("id").alias("cid"), F.col("key").alias("ckey"),
                       F.array_distinct(F.flatten(F.transform(
                           "starts", lambda p: F.sequence(p, p + (WINDOW_LINES - 1))))).alias("gone")))
    out = (docs.join(covered, F.col("id").eqNullSafe(F.col("cid")) & (F.col("key") == F.col("ckey")), "left")
           .select("id", "text", F.split("text", "\n").alias("lines"), "gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    keep = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(keep).alias(text_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
