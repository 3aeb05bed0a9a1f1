"""Mixing sources to target weights (operator 5): Poisson replication.

Source ``s`` with ``n_s`` documents and target share ``w_s`` of an epoch of
``T`` documents is repeated at the mean rate ``w_s * T / n_s``. Each document
draws its count by inverting the Poisson distribution of that mean at a
uniform number hashed from seed, id and text, so the draw is independent per
document, repeatable, and needs no coordination. The document is exploded by
its count and the copies are shuffled globally: partitioned and ordered by a
hash of (seed, id, text, copy).

The counts per source are one map-side-combined aggregate. Each source's
distribution is a short array of cumulative probabilities; a document's count
is the number of entries at or below its uniform number. A mean over
``PIECE`` is drawn as a sum of independent draws of smaller mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm import rows as R

SEED = 17
#: Default target shares: in proportion to n_s ** TEMPERATURE, which lifts small sources.
TEMPERATURE = 0.5
#: Largest mean drawn at once, and the number of sources up to which their table is broadcast.
PIECE, BROADCAST_SOURCES, SALTS = 16.0, 4096, 64


def _cdf(mean: Column) -> Column:
    """Cumulative Poisson probabilities 0, 1, 2, ... up to where the rest is
    below any 52-bit uniform number's resolution."""
    ks = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(ks, start, step, lambda acc: acc["c"])


def source_rates(df: DataFrame, source_col: str, targets: dict[str, float] | None, total: int | None,
                 temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate): documents per source and the mean repetition. With
    ``targets`` (relative weights by source), other sources have rate 0."""
    counts = df.groupBy(R.quoted(source_col).alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        known = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(known[F.col("source")], F.lit(0.0))
    w = counts.withColumn("weight", weight)
    sums = w.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n")).first()
    all_weight, size = sums["all_weight"] or 1.0, total if total is not None else (sums["all_n"] or 0)
    return w.select("source", "n", (F.col("weight") / F.lit(float(all_weight)) * F.lit(float(size)) / F.col("n")).alias("rate"))


def _with_rates(packed: DataFrame, rates: DataFrame) -> DataFrame:
    """Joins the rate table: broadcast while it is provably short, else salted
    so that a hot source is spread over ``SALTS`` keys."""
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return packed.join(F.broadcast(rates), F.col("src").eqNullSafe(F.col("source")))
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return packed.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(
        salted, F.col("src").eqNullSafe(F.col("source")) & (F.col("own") == F.col("salt")))


def poisson_mix(df: DataFrame, targets: dict[str, float] | None = None, total: int | None = None,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: int = SEED, with_copy: bool = False) -> DataFrame:
    """The rows of ``df``, each repeated by its Poisson count, shuffled.

    ``targets``: relative weights by source (None: ``n ** TEMPERATURE``).
    ``total``: expected number of output rows (None: as many as the input).
    ``with_copy`` adds ``copy`` (0, 1, ...).

    Defined cases: a NULL source is a source of its own (weight 0 under
    ``targets``); rows that repeat id and text draw the same count, each; NULL
    id and text take part in the hash as a fixed mark; no rows give no rows.
    """
    columns = [c for c in df.columns if not (with_copy and c.lower() == "copy")]
    key = F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(R.quoted(id_col).cast("string"), F.lit("\x1e")),
                      F.md5(F.coalesce(R.quoted(text_col), F.lit("\x1e")).cast("binary")))
    rates = source_rates(df, source_col, targets, total)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    rates = rates.filter("rate > 0").select("source", pieces.alias("pieces"), (F.col("rate") / pieces).alias("mean"))
    rates = rates.select("source", "pieces", _cdf(F.col("mean")).alias("cdf"))
    packed = R.pack(df.select(*[R.quoted(c) for c in columns]), key=key, src=R.quoted(source_col))
    drawn = _with_rates(packed, rates)

    def one(piece: Column) -> Column:
        u = R.unit(F.concat_ws("\x1f", F.col("key"), piece.cast("string")))
        return F.aggregate(F.transform(F.array(u), lambda x: F.size(F.filter("cdf", lambda c: c <= x))), F.lit(0),
                           lambda a, b: a + b)

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("pieces")), one), F.lit(0), lambda a, b: a + b)
    copies = (drawn.select(R.ROW, "key", count.alias("count")).filter("count > 0")
              .select(R.ROW, "key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy")))
    shuffled = copies.withColumn("place", F.xxhash64(F.lit(seed), "key", "copy"))
    shuffled = shuffled.repartition("place").sortWithinPartitions("place")
    return R.unpack(shuffled, columns, **({"copy": F.col("copy")} if with_copy else {}))
