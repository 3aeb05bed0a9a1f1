"""Date expressions: EXIF ``YYYY:MM:DD`` text, tolerant parsing, buckets."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_datetime(text) -> tuple[Column, Column]:
    """Split at the first blank: (date text, time text); no blank -> time NULL."""
    parts = F.split(_c(text), " ", 2)
    return F.get(parts, 0), F.get(parts, 1)


def parse_exif_date(text) -> Column:
    """``yyyy:M:d`` -> date; anything invalid (``0000:00:00``) -> NULL."""
    return F.try_to_date(_c(text), "yyyy:M:d")


def parse_date_text(text) -> Column:
    """Filter-side tolerant date: text after the first blank dropped, then
    ``y:m:d`` or ``y-m-d`` with integer parts; anything else -> NULL."""
    t = F.get(F.split(F.trim(_c(text)), " ", 2), 0)
    m = F.regexp_extract(t, r"^([0-9]+)[:-]([0-9]+)[:-]([0-9]+)$", 0)
    sep_ok = ~(t.contains(":") & t.contains("-"))
    norm = F.regexp_replace(m, ":", "-")
    return F.when((m != "") & sep_ok, F.try_to_date(norm, "y-M-d"))


def repair_mixed_date(text) -> Column:
    """Dashboard load rule: leading ``YYYY:MM:DD`` becomes ``YYYY-MM-DD``,
    then a tolerant parse to date; bad -> NULL."""
    fixed = F.regexp_replace(_c(text), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    d = F.coalesce(
        F.try_to_date(fixed, "yyyy-MM-dd"),
        F.to_date(F.try_to_timestamp(fixed, F.lit("yyyy-MM-dd HH:mm:ss"))),
        F.to_date(F.try_to_timestamp(fixed, F.lit("yyyy-MM-dd'T'HH:mm:ss"))),
    )
    return d


def year_text(d) -> Column:
    return F.year(_c(d)).cast("string")


def month_text(d) -> Column:
    return F.lpad(F.month(_c(d)).cast("string"), 2, "0")


def year_month_from_text(text) -> tuple[Column, Column]:
    """Text form: split on ``:`` if present, else ``-``; needs two parts."""
    t = _c(text)
    parts = F.when(t.contains(":"), F.split(t, ":")).when(t.contains("-"), F.split(t, "-"))
    ok = F.size(parts) >= 2
    return F.when(ok, F.get(parts, 0)), F.when(ok, F.get(parts, 1))


def month_start(d) -> Column:
    return F.trunc(_c(d), "MM")


def month_label(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def shift_month_text(text, from_month: str = "07", to_month: str = "06") -> Column:
    """EXIF date text whose characters 6-7 equal ``from_month`` get
    ``to_month`` there; other text unchanged."""
    t = _c(text)
    return F.when(t.substr(6, 2) == from_month, F.overlay(t, F.lit(to_month), 6, 2)).otherwise(t)


def fix_month(df: DataFrame, cols: Sequence[str], from_month: str = "07", to_month: str = "06") -> DataFrame:
    """``df`` with the month shifted in each of ``cols``, and ``modified``:
    whether any of them changed."""
    changed = [F.coalesce(F.col(c).substr(6, 2) == from_month, F.lit(False)) for c in cols]
    rest = [F.col(c) for c in df.columns if c not in cols]
    fixed = [shift_month_text(F.col(c), from_month, to_month).alias(c) for c in cols]
    return df.select(*rest, *fixed, reduce(operator.or_, changed).alias("modified"))
