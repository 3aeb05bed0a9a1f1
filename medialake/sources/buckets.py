"""Tables bucketed by a key, so that joins on it need no shuffle of the table (J1).

The rows are shuffled once, when they are written: Spark's bucketed Parquet
layout, one sorted file per bucket and partition value. A lookup, upsert or
anti-join on the key then moves only the other side. The table is external:
its files lie under the given path and can be read as plain Parquet, too;
another session names them again with :func:`open_bucketed`.

Spark keeps a bucketed side in place only if it has at least
``spark.sql.shuffle.partitions`` buckets; that is the default number.
"""

from __future__ import annotations

import uuid
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.session import CODEC, cleared


def _name() -> str:
    return f"medialake_{uuid.uuid4().hex}"


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str, partition_by: Sequence[str] = (),
                   buckets: Optional[int] = None, dealt: bool = False) -> str:
    """Write ``df`` under ``path`` in buckets of ``key``; returns the name of
    the session's table. A NULL key is a value like any other (one bucket). A
    hot key fills one bucket: for tables unique by key, as a catalog is.
    ``dealt`` says that the rows come from a ``repartition`` of this number by
    an expression of the key's value: they are not shuffled again."""
    n = buckets or default_buckets(df.sparkSession)
    name = _name()
    rows = df if dealt else df.repartition(n, F.col(key))
    w = rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).option("compression", CODEC)
    with cleared(df.sparkSession):
        (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)
    return name


def open_bucketed(spark: SparkSession, like: DataFrame, path: str, key: str, buckets: int,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """The table that was written under ``path``, with the columns of ``like``,
    in a session that does not know its name."""
    name = _name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} "
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
