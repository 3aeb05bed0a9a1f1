"""Centroid clustering (operator 11): integer k-means in built-in expressions.

Vectors become arrays of whole numbers, ``floor(scale * x)``, stored once. The
centroids of a round are literal arrays in the plan: ``zip_with`` and
``aggregate`` give a vector's squared distance to each of them, and
``array_min`` over (distance, number) structs chooses the cluster, so ties go to
the smaller number. One aggregation per round sums the components by cluster;
sums are combined before the shuffle, so a task sends at most one row per
cluster, and k rows reach the driver.

All arithmetic is on 64-bit whole numbers, hence exact and independent of the
order of rows; a distance or sum beyond 64 bits raises (ANSI arithmetic).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R
from medialake.session import materialize


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v, vv): the vectors of exactly ``dims`` finite components, scaled to
    whole numbers, and their squared lengths. A NULL vector, component or another length drops the row."""
    x = R.quoted(vec_col)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    kept = df.select(R.quoted(id_col).alias("id"), x.alias("x")).filter(
        F.coalesce(F.size(x) == dims, F.lit(False)) & F.coalesce(finite, F.lit(False)))
    whole = kept.select("id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    return whole.select("id", "v", F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c).alias("vv"))


def _literal(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _nearest(v: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid: |v|^2 + |c|^2 - v . 2c."""
    def squared(c: Sequence[int]) -> Column:
        start = F.col("vv") + F.lit(sum(x * x for x in c)).cast("long")
        return F.aggregate(F.zip_with(v, _literal([2 * x for x in c]), lambda a, b: a * b), start, lambda s, d: s - d)

    return F.array_min(F.array(*[F.struct(squared(c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def first_centroids(vectors: DataFrame, k: int, salt: str = "1") -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``salt:<id>``; rows that
    repeat an id follow by their components, a NULL id comes last."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select("v", order.alias("o")).orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()]


def next_centroids(vectors: DataFrame, centroids: Sequence[Sequence[int]]) -> list[list[int]]:
    """Floor of the mean of each cluster's vectors; an empty cluster's centroid
    stays. The sums are ``dims`` columns of one aggregation."""
    dims = len(centroids[0])
    chosen = vectors.select(_nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    out = [list(c) for c in centroids]
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16,
                    rounds: int = 3, scale: int = 64) -> DataFrame:
    """One row per kept vector: ``id_col``, ``cluster``, ``distance`` (squared,
    to the cluster's final centroid), ``cluster_inertia`` and ``inertia``
    (distances summed over the cluster and over all), ``centroid`` (array).

    Defined cases: vectors that are NULL, of another length, or hold a NULL, NaN
    or infinite component are left out; rows that repeat an id are rows of their
    own; a NULL id is kept and starts no cluster unless fewer than ``k`` others
    do; with fewer than ``k`` vectors there are as many clusters as vectors; an
    empty table gives no rows. Other columns are ignored."""
    vectors = materialize(whole_vectors(df, id_col, vec_col, dims, scale))
    out_id = F.col("id").alias(id_col)
    centroids = first_centroids(vectors, k)
    if not centroids:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"),
                                                          ("inertia", "long"), ("centroid", "array<bigint>"))]
        return vectors.select(out_id, *none)
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    placed = materialize(vectors.select("id", _nearest(F.col("v"), centroids).alias("at")).select("id", "at.cluster", "at.distance"))
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = _literal([sums.get(i, 0) for i in range(len(centroids))])
    final = F.array(*[_literal(c) for c in centroids])
    return placed.select(out_id, "cluster", "distance", F.get(of, F.col("cluster")).alias("cluster_inertia"),
                         F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(final, F.col("cluster")).alias("centroid"))


def centroid_digest(centroid: Column) -> Column:
    """Lowercase hex SHA-256 of the components as decimal numbers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda c: c.cast("string")), ",").cast("binary"), 256)
