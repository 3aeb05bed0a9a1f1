"""Geotagged points (G1) and hexagonal density binning (G2).

Hex cells follow the two-lattice rule of plotting hexbins: with ``nx``
columns and ``ny = int(nx / sqrt(3))`` rows over the padded data extent, a
point goes to the nearer of its lattice-1 cell ``(rint(u), rint(v))`` and its
lattice-2 cell ``(floor(u), floor(v))`` (centres offset by half a cell). The
extent is one broadcast row; the count is a partial/final aggregate per cell.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions import numbers
from medialake.functions.scalars import with_scalars


def geo_points(images: DataFrame, extra=("camera", "date_taken", "name")) -> DataFrame:
    """Rows with both coordinates numeric: (full_path, latitude, longitude, extra...)."""
    lat, lon = numbers.to_float(F.col("latitude")), numbers.to_float(F.col("longitude"))
    d = images.select("full_path", lat.alias("latitude"), lon.alias("longitude"), *extra)
    return d.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def _nonsingular(lo, hi, expander: float = 0.1):
    same = hi - lo <= F.greatest(F.abs(lo), F.abs(hi)) * F.lit(1e-15)
    zero = (lo == 0) & (hi == 0)
    nlo = F.when(same & zero, F.lit(-expander)).when(same, lo - F.abs(lo) * expander).otherwise(lo)
    nhi = F.when(same & zero, F.lit(expander)).when(same, hi + F.abs(hi) * expander).otherwise(hi)
    return nlo, nhi


def hexbin(points: DataFrame, x: str = "longitude", y: str = "latitude", gridsize: int = 45) -> DataFrame:
    """Non-empty hexagonal cells: (lattice, i, j, cx, cy, n)."""
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    ext = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    x0, x1 = _nonsingular(F.col("_x0"), F.col("_x1"))
    y0, y1 = _nonsingular(F.col("_y0"), F.col("_y1"))
    ext = ext.select(x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"))
    pad = (F.col("_x1") - F.col("_x0")) * F.lit(1e-9)
    ext = ext.select((F.col("_x0") - pad).alias("_xmin"), (F.col("_x1") + pad).alias("_xmax"), "_y0", "_y1")
    ext = ext.select("_xmin", "_y0",
                     ((F.col("_xmax") - F.col("_xmin")) / F.lit(float(nx))).alias("_sx"),
                     ((F.col("_y1") - F.col("_y0")) / F.lit(float(ny))).alias("_sy"))
    p = with_scalars(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), ext)
    u = (F.col(x) - F.col("_xmin")) / F.col("_sx")
    v = (F.col(y) - F.col("_y0")) / F.col("_sy")
    p = p.select("_xmin", "_y0", "_sx", "_sy", u.alias("_u"), v.alias("_v"))
    i1, j1 = F.bround(F.col("_u"), 0), F.bround(F.col("_v"), 0)
    i2, j2 = F.floor(F.col("_u")), F.floor(F.col("_v"))
    d1 = (F.col("_u") - i1) ** 2 + 3.0 * (F.col("_v") - j1) ** 2
    d2 = (F.col("_u") - i2 - 0.5) ** 2 + 3.0 * (F.col("_v") - j2 - 0.5) ** 2
    first = d1 < d2
    cells = p.select(
        F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("lattice"),
        F.when(first, i1).otherwise(i2).cast("bigint").alias("i"),
        F.when(first, j1).otherwise(j2).cast("bigint").alias("j"),
        "_xmin", "_y0", "_sx", "_sy")
    g = cells.groupBy("lattice", "i", "j", "_xmin", "_y0", "_sx", "_sy").agg(F.count(F.lit(1)).alias("n"))
    off = F.when(F.col("lattice") == 2, F.lit(0.5)).otherwise(F.lit(0.0))
    return g.select("lattice", "i", "j",
                    F.round(F.col("_xmin") + (F.col("i") + off) * F.col("_sx"), 6).alias("cx"),
                    F.round(F.col("_y0") + (F.col("j") + off) * F.col("_sy"), 6).alias("cy"),
                    "n")
