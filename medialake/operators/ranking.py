"""Skew-safe ranks, running sums and exact quantiles.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task,
so one hot key (a folder holding a third of all files) becomes one straggler.
Here the rows are range-partitioned by (keys, order) instead and stored once
with their partition number: a partition holds a bounded, contiguous stretch,
whatever the keys. Sums are taken within (partition, key). Only the first key
of a partition can have begun in an earlier one, so the missing offset is one
number per partition: the weight of that key in the partitions before.

The offsets are computed from the stored frame (cutting the ranges again could
cut elsewhere), and a recomputed task reads the same files.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.scalars import with_scalars
from medialake.session import stored as materialize


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _offsets(cut: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """(_opart, _okey, _before): for the first key of each partition that began
    earlier, its weight in earlier partitions. At most one row per partition."""
    key = _key(keys)
    ends = cut.groupBy("_part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    at_end = cut.join(F.broadcast(ends.select(F.col("_part").alias("_p"), "_hi")), F.col("_part") == F.col("_p"))
    tails = (at_end.where(key.eqNullSafe(F.col("_hi"))).groupBy(F.col("_part").alias("_q"))
             .agg(F.first("_hi").alias("_end"), F.sum(weight).alias("_t")))
    starts = ends.select(F.col("_part").alias("_opart"), F.col("_lo").alias("_okey"))
    earlier = starts.join(tails, F.col("_okey").eqNullSafe(F.col("_end")) & (F.col("_q") < F.col("_opart")))
    return earlier.groupBy("_opart").agg(F.first("_okey").alias("_okey"), F.sum("_t").alias("_before"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, out: str,
                inclusive: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over earlier rows of the key by ``order``
    (ascending; rows tied on ``order`` come in some fixed order); ``inclusive``
    adds the row's own weight. ``keys=[]`` runs over the whole table."""
    keys, order = list(keys), list(order)
    cut = materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    win = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = cut.withColumn("_local", F.coalesce(F.sum(weight).over(win), F.lit(0)))
    # bounded: one row per partition
    offsets = F.broadcast(_offsets(cut, keys, weight))
    j = local.join(offsets, F.col("_part") == F.col("_opart"), "left")
    carried = F.when(_key(keys).eqNullSafe(F.col("_okey")), F.col("_before"))
    return j.select(*[F.col(c) for c in df.columns], (F.col("_local") + F.coalesce(carried, F.lit(0))).alias(out))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Add ``out`` = 0-based position of the row within its ``keys`` group by
    ``order`` (ascending; rows tied on ``order`` get distinct consecutive
    ranks). ``keys=[]`` ranks the whole table."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(one, keys, order, "_one", out).drop("_one")


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], prefix: str = "q",
                    weight: Optional[str] = None) -> DataFrame:
    """One-row table of exact quantiles with linear interpolation between
    closest ranks (the ``percentile`` / ``quantile_cont`` definition).

    Values are reduced to (value, count) by a partial aggregate, then
    cumulative counts come from :func:`running_sum` over the value order, so
    no task holds all values. Columns ``{prefix}0, {prefix}1, ...`` and ``n``.
    ``weight`` names a count column when ``df`` is already (distinct value,
    count) pairs.
    """
    x = F.col(col)
    if weight is None:
        counts = df.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    else:
        counts = df.where(x.isNotNull()).select(x.alias("_v"), F.col(weight).cast("bigint").alias("_c"))
    ranked = running_sum(counts, [], ["_v"], "_c", "_before")
    total = ranked.agg(F.max(F.col("_before") + F.col("_c")).alias("_n"))
    pos = with_scalars(ranked, total)
    aggs = []
    for i, q in enumerate(qs):
        p = F.lit(float(q)) * (F.col("_n") - 1)
        lo_i, hi_i = F.floor(p), F.ceil(p)
        in_lo = (F.col("_before") <= lo_i) & (lo_i < F.col("_before") + F.col("_c"))
        in_hi = (F.col("_before") <= hi_i) & (hi_i < F.col("_before") + F.col("_c"))
        v_lo = F.max(F.when(in_lo, F.col("_v")))
        v_hi = F.max(F.when(in_hi, F.col("_v")))
        frac = F.first(p - lo_i)
        aggs.append(F.when(v_lo == v_hi, v_lo).otherwise(v_lo + frac * (v_hi - v_lo)).alias(f"{prefix}{i}"))
    return pos.agg(*aggs, F.first("_n").alias("n"))
