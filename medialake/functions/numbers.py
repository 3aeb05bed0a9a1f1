"""Numeric expressions: shutter text, sizes, tolerant casts, h/m/s parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MB = 1048576


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_float(x) -> Column:
    """Tolerant cast to double: bad text -> NULL, NaN -> NULL."""
    d = _c(x).try_cast("double")
    return F.when(~F.isnan(d), d)


def truthy(x, zero=0) -> Column:
    """NULL for a falsy value (``''`` or 0), the value otherwise."""
    return F.nullif(_c(x), F.lit(zero))


def first_truthy(*cols, zero=0) -> Column:
    """Python ``a or b or c``: the first truthy operand, else the last one."""
    cs = [_c(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit(zero)) for c in cs[:-1]], cs[-1])


def num_text(x) -> Column:
    """Number as text; whole values without ``.0`` (integer tag style)."""
    x = _c(x)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def format_shutter(exposure) -> Column:
    """Exposure seconds -> ``1/Ns`` below one second (N half-even), else ``Xs``.
    NULL stays NULL; 0 passes through as ``0``."""
    x = _c(exposure).cast("double")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(x == 0, F.lit("0"))
        .when(x < 1, F.concat(F.lit("1/"), F.bround(F.lit(1.0) / x, 0).cast("bigint").cast("string"), F.lit("s")))
        .otherwise(F.concat(num_text(x), F.lit("s")))
    )


def shown_exposure(exposure) -> Column:
    """The seconds that :func:`format_shutter`'s text stands for."""
    x = _c(exposure).cast("double")
    return F.when((x != 0) & (x < 1), F.lit(1.0) / F.bround(F.lit(1.0) / x, 0)).otherwise(x)


def parse_shutter(text, bad: str = "zero") -> Column:
    """Shutter text -> seconds.

    ``bad='zero'`` (filter rule): lower-case, every ``s`` removed, NULL/empty
    or unparsable -> 0.0. ``bad='null'`` (chart rule): trailing ``s`` stripped,
    case kept, unparsable -> NULL. Zero denominators count as unparsable.
    """
    t = _c(text).cast("string")
    if bad == "zero":
        s = F.regexp_replace(F.lower(t), "s", "")
    elif bad == "null":
        s = F.regexp_replace(t, "s+$", "")
    else:
        raise ValueError(bad)
    one_slash = s.rlike("^[^/]*/[^/]*$")
    num = F.substring_index(s, "/", 1).try_cast("double")
    den = F.substring_index(s, "/", -1).try_cast("double")
    val = F.when(one_slash, F.try_divide(num, F.nullif(den, F.lit(0.0)))) \
        .when(~s.contains("/"), s.try_cast("double"))
    val = F.nanvl(val, F.lit(None).cast("double"))
    if bad == "zero":
        return F.when(t.isNull() | (t == ""), F.lit(0.0)).otherwise(F.coalesce(val, F.lit(0.0)))
    return val


def size_mb(size_bytes) -> Column:
    """Bytes -> MB, two decimals, half-even; NULL stays NULL."""
    return F.bround(_c(size_bytes) / F.lit(float(MB)), 2)


def duration_ms(duration) -> Column:
    return _c(duration) * F.lit(1000.0)


def hms(total_seconds) -> tuple[Column, Column, Column]:
    """Integer hours, minutes, seconds of a total in seconds."""
    s = _c(total_seconds)
    return (
        F.floor(s / 3600).cast("bigint"),
        F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("bigint"),
        F.floor(F.pmod(s, F.lit(60.0))).cast("bigint"),
    )
