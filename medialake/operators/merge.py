"""Catalog merge: add + refresh, never prune (M1-M3, M6).

Rows are keyed by the normalized ``full_path``. On a repeated key the last row
wins: new rows over existing ones, later new rows over earlier ones. That is one
keep-last over both (``lookup.keep_last``), so a key is there once whether the
existing rows repeated it or the new ones. Rows with a NULL path collapse to one.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake import schemas
from medialake.functions import paths
from medialake.operators.lookup import keep_last


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by name; columns missing on one side become NULL (M1)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def upsert(existing: Optional[DataFrame], new: Optional[DataFrame], kind: str,
           order: Sequence[str] = (), case_insensitive: bool = False) -> DataFrame:
    """Merge ``new`` rows of one kind into ``existing`` (M2).

    ``order`` names columns of ``new`` giving its row order (later wins);
    without it, ties among new rows are broken by content, as are those among
    existing rows, by what they have of ``order`` first. The result has the
    kind's canonical columns (M3: order fixed, stray dropped, missing added).
    """
    schema = schemas.BY_KIND[kind]
    if existing is None and new is None:
        raise ValueError("nothing to merge")
    if new is None:
        return schemas.conform(existing, schema)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.when(F.col("full_path").isNotNull(),
                                            paths.normalize_path(F.col("full_path"), case_insensitive)))

    extra = [c for c in order if c not in schema.fieldNames()]
    rows = keyed(schemas.conform(new, schema, keep=tuple(extra))).withColumn("_new", F.lit(1))
    if existing is not None:
        rows = rows.unionByName(keyed(schemas.conform(existing, schema)).withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return schemas.conform(keep_last(rows, ["_key"], ["_new", *order]), schema)


def upsert_catalog(existing: dict[str, Optional[DataFrame]], new: dict[str, Optional[DataFrame]],
                   order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Three-table upsert; a kind without new rows keeps its table as is."""
    out = {}
    for kind in schemas.BY_KIND:
        e, n = existing.get(kind), new.get(kind)
        if n is None:
            out[kind] = e
        else:
            out[kind] = upsert(e, n, kind, [c for c in order if c in n.columns])
    return out
