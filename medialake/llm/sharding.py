"""Sharding (operator 7): extendible hashing into byte-limited shards.

A row's hash is the MD5 of its id and text, read as bits from the left. The
directory maps hash prefixes to shards: starting from one shard, only an
oversized shard is split, on the next bit, until each fits the byte limit.

Plan: the split needs only byte counts. Rows are counted per ``step`` bits of
prefix (map-side combined); every cell adds its bytes to its ancestors at all
shallower depths, and since an ancestor holds at least the bytes of its
descendants, a cell's shard lies one bit below its deepest oversized ancestor.
Cells that are still too large at this depth are counted again, alone, on
further bits. The directory is looked up for the distinct hashes, which are
narrow, and the rows get their shard by one equi-join on the hash.

Rows of equal hash are equal in id and text and no bit separates them. Where
such rows are together larger than the limit, they fill numbered overflow
shards: their cells are split by a running number over (identical) rows, which
is derived from counts, not from a window over the group. A single row larger
than the limit is a shard of its own, ``oversize``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.session import materialize

#: Byte limit of a shard (UTF-8 bytes of text).
SHARD_BYTES = 1 << 20
#: Bits per counting round, and bits in a hash.
STEP, HASH_BITS = 16, 128


def _bits(id_col: Column, text: Column) -> Column:
    """The hash as a string of 128 binary digits, most significant first."""
    h = F.md5(F.concat_ws("\x1f", F.coalesce(id_col.cast("string"), F.lit("\x1e")),
                          F.coalesce(text, F.lit("\x1e"))).cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)]
    return F.concat(*parts)


def _split_round(cells: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """(cell, shard, full) for cells of ``depth`` bits below prefixes of
    ``base`` bits that are split anyway (but for base 0): ``shard`` is the
    prefix where the cell ends up, ``full`` whether the cell itself is still
    too large. The children of oversized nodes that are not oversized are the
    shards; a cell looks itself up at the depths where there are any, so no
    lookup key stands for many cells."""
    up = cells.select("bytes", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"), "cell")
    node = F.substring("cell", F.lit(1), F.col("d")).alias("node")
    over = materialize(up.select("d", node, "bytes").groupBy("d", "node").agg(F.sum("bytes").alias("bytes"))
                       .filter(F.col("bytes") > limit).select("d", "node"))
    if over.isEmpty():
        return cells.select("cell", F.substring("cell", 1, base).alias("shard"), F.lit(False).alias("full"))
    child = F.explode(F.array(F.lit("0"), F.lit("1")))
    leaves = over.filter(F.col("d") < depth).select((F.col("d") + 1).alias("d"), F.col("node"), child.alias("bit"))
    leaves = leaves.select("d", F.concat("node", "bit").alias("node")).join(over, ["d", "node"], "left_anti")
    depths = [r["d"] for r in leaves.select("d").distinct().collect()]  # at most 128
    if depths:
        at = cells.select("cell", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])).alias("d"))
        fits = at.select("cell", "d", node).join(leaves, ["d", "node"]).select(
            "cell", F.col("node").alias("shard"), F.lit(False).alias("full"))
    full = over.filter(F.col("d") == depth).select(F.col("node").alias("cell"), F.col("node").alias("shard"), F.lit(True).alias("full"))
    return fits.unionByName(full) if depths else full


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               limit: int = SHARD_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` (the hash prefix as binary digits; ``""`` if one
    shard holds all; ``<prefix>+<k>`` for the k-th overflow shard of rows of
    equal hash), ``shard_depth`` (prefix bits) and ``shard_oversize``.
    ``carry`` names the columns to return beside these (default: all).

    A text's size is its UTF-8 bytes; NULL counts 0. Input columns of the
    added names are replaced. Equal rows may land in different overflow
    shards; which copy goes where cannot be told apart.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    added = ("shard", "shard_depth", "shard_oversize")
    columns = [c for c in (df.columns if carry is None else carry) if c.lower() not in added]
    text = R.quoted(text_col)
    packed = df.select(F.struct(*[R.quoted(c) for c in columns]).alias(R.ROW), _bits(R.quoted(id_col), text).alias("bits"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    narrow = materialize(packed.select("bits", "size"))
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    # four bits more than an even split needs, in steps
    need = max(0, math.ceil(math.log2(max(1, total / limit)))) + 4
    depth, base, found = min(HASH_BITS, math.ceil(need / STEP) * STEP), 0, []
    open_cells = None
    while True:
        cell = F.substring("bits", 1, depth).alias("cell")
        part = narrow
        if open_cells is not None:
            part = narrow.join(open_cells.select(F.col("cell").alias("up")),
                               F.substring("bits", 1, base) == F.col("up"), "left_semi")
        cells = materialize(part.groupBy(cell).agg(F.sum("size").alias("bytes")))
        placed = materialize(_split_round(cells, base, depth, limit))
        found.append((depth, placed.filter(~F.col("full") | F.lit(depth >= HASH_BITS))))
        open_cells = placed.filter("full").select("cell")
        if depth >= HASH_BITS or open_cells.isEmpty():
            break
        base, depth = depth, min(HASH_BITS, depth + 2 * STEP)
    # the directory of the rows that there are: narrow, so that the rows themselves are joined once
    where = narrow.select("bits").distinct()
    for k, (at, placed) in enumerate(found):
        one = placed.select(F.col("cell").alias("cell"), F.col("shard").alias(f"shard{k}"), F.col("full").alias(f"full{k}"))
        where = where.join(one, F.substring("bits", 1, at) == F.col("cell"), "left").drop("cell")
    deepest = range(len(found) - 1, -1, -1)
    where = where.select("bits", F.coalesce(*[F.col(f"shard{k}") for k in deepest]).alias("shard"),
                         F.coalesce(*[F.col(f"full{k}") for k in deepest]).alias("full"))
    # a shuffle whatever its size, so that small and large tables run alike
    out = packed.join(where.hint("merge"), "bits")
    if depth >= HASH_BITS:
        out = _overflow(out, limit)
    else:
        out = out.withColumn("overflow", F.lit(None).cast("long"))
    return R.unpack(out, columns,
                    shard=F.when(F.col("overflow").isNull(), F.col("shard")).otherwise(
                        F.concat("shard", F.lit("+"), F.col("overflow").cast("string"))),
                    shard_depth=F.length("shard").cast("int"), shard_oversize=F.col("size") > limit)


def _overflow(out: DataFrame, limit: int) -> DataFrame:
    """Overflow numbers for rows whose 128 bits are one too large cell: they
    are counted as (equal) rows and dealt out again by number."""
    rest = out.filter(~F.col("full")).withColumn("overflow", F.lit(None).cast("long")).drop("full")
    per = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("size"), F.lit(1))), F.lit(1))
    many = out.filter("full").groupBy(R.ROW, "bits", "size", "shard").agg(F.count("*").alias("copies"))
    # variants of one id and text (they differ in other columns), one after the other
    before = Window.partitionBy("bits").orderBy(F.xxhash64(R.ROW)).rowsBetween(Window.unboundedPreceding, -1)
    spread = many.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    dealt = spread.select(R.ROW, "bits", "size", "shard", "before",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i"))
    return rest.unionByName(dealt.select(R.ROW, "bits", "size", "shard",
                                         F.floor((F.col("before") + F.col("i")) / per).alias("overflow")))
