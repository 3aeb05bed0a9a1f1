"""Export sinks: three-table export (K1), link column (K2), column width
profile (K3), display names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake import schemas
from medialake.functions import paths


def export_tables(frames: dict[str, DataFrame], out: str, fmt: str = "parquet",
                  display_names: bool = False, mode: str = "errorifexists") -> dict[str, str]:
    """Write ``images``, ``videos`` and ``others`` under ``out`` (always all
    three; a missing kind is written as an empty typed table)."""
    spark = next(iter(frames.values())).sparkSession
    written = {}
    for kind, table in schemas.TABLE_BY_KIND.items():
        df = frames.get(kind)
        df = schemas.conform(df, schemas.BY_KIND[kind]) if df is not None else schemas.empty(
            spark, schemas.BY_KIND[kind])
        if display_names:
            df = with_display_names(df)
        path = f"{out.rstrip('/')}/{table}"
        w = df.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(path)
        elif fmt == "json":
            w.json(path)
        else:
            w.parquet(path)
        written[kind] = path
    return written


def with_display_names(df: DataFrame) -> DataFrame:
    """``full_path`` -> ``Full path``, ``size_mb`` -> ``size (MB)``."""
    return df.select(*[F.col(c).alias(schemas.DISPLAY_NAMES.get(c, c)) for c in df.columns])


def with_link(df: DataFrame, path_col: str = "full_path", out: str = "link") -> DataFrame:
    """Hyperlink column ``file:///<path>``; NULL path -> NULL (K2)."""
    return df.withColumn(out, paths.link(F.col(path_col)))


def column_widths(df: DataFrame, pad: int = 2) -> DataFrame:
    """Display width per column: ``max(longest value as text, header) + pad``
    (K3), as one aggregate over the table unpivoted with ``stack``. NULLs
    count as empty text; an empty table gives header widths."""
    cols = [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    aggs = [F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(f"_w{i}")
            for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', _w{i}" for i, c in enumerate(cols))
    long = wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, max_len)")
    return long.select("column", (F.greatest(F.col("max_len"), F.length("column")) + pad).cast("bigint")
                       .alias("width"))


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of the three tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(schemas.TABLE_BY_KIND[k]).alias("table"),
                                                              "n_rows")
             for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
