"""Declarative media filters compiled to a single Spark ``Column`` predicate.

All predicates are conjunctive and evaluated by Catalyst's ``Filter`` (codegen);
over a Parquet catalog the simple ones (kind, filetype, camera, ranges) are
pushed into the scan.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from datetime import date
from typing import Any, Callable, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import numbers

# Tag names accepted by the generic tag selector.
SELECT_FIELDS = ("Model", "LensModel", "ISOSpeedRatings", "FNumber", "ExposureTime",
                 "FocalLength", "DateTime", "DateTimeOriginal")


def normalize_extensions(exts: Optional[Sequence[str]]) -> Optional[list[str]]:
    """Option builder rule: blanks dropped, a missing leading dot added."""
    if not exts:
        return None
    out = []
    for e in exts:
        e = e.strip()
        if e:
            out.append(e if e.startswith(".") else "." + e)
    return out


@dataclass(frozen=True)
class FilterSpec:
    filetypes: Optional[Sequence[str]] = None
    extensions: Optional[Sequence[str]] = None
    date_range: Optional[tuple[Optional[date], Optional[date]]] = None
    cameras: Optional[Sequence[str]] = None
    lenses: Optional[Sequence[str]] = None
    aperture_range: Optional[tuple[Optional[float], Optional[float]]] = None
    iso_range: Optional[tuple[Optional[int], Optional[int]]] = None
    shutter_speed_range: Optional[tuple[Optional[str], Optional[str]]] = None
    # 'reject': undated rows fail a date range (report path);
    # 'mtime': fall back to the file modification date (organize path)
    undated: str = "reject"

    def is_empty(self) -> bool:
        return not (self.filetypes or self.extensions or self.date_range or self.cameras
                    or self.lenses or self.aperture_range or self.iso_range
                    or self.shutter_speed_range)

    def has_photo_options(self) -> bool:
        return bool(self.cameras or self.lenses or self.aperture_range or self.iso_range
                    or self.shutter_speed_range)

    def listing_only(self) -> "FilterSpec":
        """The part decidable from the listing alone (kind, extension), which
        can run before tag extraction or the metadata join."""
        return FilterSpec(filetypes=self.filetypes, extensions=self.extensions)

    def predicate(self, mtime_col: str = "modification_date", seconds_col: Optional[str] = None) -> Column:
        """One boolean ``Column`` over the wide media frame (``kind`` column).
        ``seconds_col`` names the stored exposure seconds, if the frame has
        them: the shutter range then compares numbers and reaches the scan."""
        conds: list[Column] = []
        kind = F.col("kind")
        if self.filetypes:
            conds.append(kind.isin(*self.filetypes))
        if self.has_photo_options():
            conds.append(kind == "image")
        if self.extensions:
            # stored lower-case, so the bare column can be pushed down
            conds.append(F.col("filetype").isin(*[e.lower() for e in self.extensions]))
        if self.date_range:
            start, end = self.date_range
            d = F.col("date_taken")
            if self.undated == "mtime":
                d = F.coalesce(d, F.to_date(F.col(mtime_col)))
            c = d.isNotNull()
            if start:
                c = c & (d >= F.lit(start))
            if end:
                c = c & (d <= F.lit(end))
            conds.append(c)
        for values, col in ((self.cameras, "camera"), (self.lenses, "lens")):
            if values:
                v = F.col(col)
                conds.append(v.isNotNull() & (v != "") & v.isin(*values))
        for rng, col in ((self.aperture_range, "aperture"), (self.iso_range, "iso")):
            if rng:
                lo, hi = rng
                v = F.col(col)
                c = v.isNotNull()
                if lo is not None:
                    c = c & (v >= F.lit(lo))
                if hi is not None:
                    c = c & (v <= F.lit(hi))
                conds.append(c)
        if self.shutter_speed_range:
            lo, hi = self.shutter_speed_range
            if seconds_col:
                v = F.col(seconds_col)
                conds.append(v.isNotNull())
            else:
                t = F.col("shutter_speed")
                v = numbers.parse_shutter(t, bad="zero")
                conds.append(t.isNotNull() & (t != ""))
            # bounds are parsed by the same expression, which folds to a constant
            if lo:
                conds.append(v >= numbers.parse_shutter(F.lit(lo), bad="zero"))
            if hi:
                conds.append(v <= numbers.parse_shutter(F.lit(hi), bad="zero"))
        if not conds:
            return F.lit(True)
        return functools.reduce(operator.and_, conds)

    def apply(self, media: DataFrame, mtime_col: str = "modification_date") -> DataFrame:
        if self.is_empty():
            return media
        return media.where(self.predicate(mtime_col, "exposure_s" if "exposure_s" in media.columns else None))


def select_where(tags: DataFrame, **preds: Any) -> DataFrame:
    """Generic tag predicate over a raw tag table.

    Each keyword names a tag; the value is a ``Callable[[Column], Column]``, a
    list (membership, NULL matches a listed ``None``) or a scalar (NULL-safe
    equality). Missing tags compare as NULL. Only ``.jpg`` rows qualify.
    """
    for k in preds:
        if k not in SELECT_FIELDS and k not in tags.columns:
            raise ValueError(f"unknown tag {k!r}")
    src = F.col("SourceFile")
    conds = [F.lower(F.regexp_extract(src, r"(\.[^./]*)$", 1)) == ".jpg"]
    for k, expected in preds.items():
        actual = F.col(k) if k in tags.columns else F.lit(None)
        if callable(expected):
            c = expected(actual)
        elif isinstance(expected, (list, tuple, set)):
            vals = [v for v in expected if v is not None]
            c = actual.isin(*vals) if vals else F.lit(False)
            if None in expected:
                c = c | actual.isNull()
        else:
            c = actual.eqNullSafe(F.lit(expected))
        conds.append(F.coalesce(c, F.lit(False)))
    return tags.where(functools.reduce(operator.and_, conds))


def dashboard_mask(images: DataFrame, month_range: Optional[tuple[date, date]] = None,
                   cameras: Optional[Sequence[str]] = None,
                   lenses: Optional[Sequence[str]] = None) -> DataFrame:
    """Dashboard masks on images: month range (inclusive) + camera + lens sets.

    The month mask applies only when the dated images span more than one
    month; it then also drops undated images. ``month_range=None`` selects the
    whole span. The span (one row) is read first, so that the masks are plain
    comparisons with constants, which reach the scan.
    """
    d = F.col("date_taken")
    span = images.agg(F.min(d).alias("lo"), F.max(d).alias("hi")).first()
    df = images
    if span["lo"] is not None and (span["lo"].year, span["lo"].month) != (span["hi"].year, span["hi"].month):
        lo, hi = month_range or (span["lo"], span["hi"])
        after = date(hi.year + hi.month // 12, hi.month % 12 + 1, 1)
        df = df.where((d >= F.lit(date(lo.year, lo.month, 1))) & (d < F.lit(after)))
    if cameras:
        df = df.where(F.col("camera").isin(*cameras))
    if lenses:
        df = df.where(F.col("lens").isin(*lenses))
    return df
