"""Small helpers shared by the operators: packing whole rows, reading tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name (dots and backticks are no path)."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, **derived: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``__row``, beside the derived ones."""
    whole = F.struct(*[quoted(c) for c in df.columns]).alias(ROW)
    return df.select(whole, *[c.alias(k) for k, c in derived.items()])


def unpack(df: DataFrame, columns: list[str], **extra: Column) -> DataFrame:
    """The packed columns again, in their order, then the extra ones."""
    back = [F.col(ROW).getField(c).alias(c) for c in columns]
    return df.select(*back, *[c.alias(k) for k, c in extra.items()])


def digest(col: Column) -> Column:
    """128-bit MD5 of a string as binary; NULL counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")))


def unit(text: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 of ``text`` (a
    deterministic stand-in for a uniform random number)."""
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(1 << 52))
