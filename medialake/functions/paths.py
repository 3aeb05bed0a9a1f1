"""Path expressions (``Column -> Column``), all JVM-side.

Rules follow POSIX path handling: the extension is the part from the last dot
of the base name, provided a non-dot character precedes that dot (so
``.bashrc`` has none, ``a.tar.gz`` has ``.gz``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    """Part after the last ``/`` (the whole text when there is none)."""
    return F.substring_index(_c(path), "/", -1)


def dirname(path) -> Column:
    """Everything before the last ``/``; trailing slashes dropped unless the
    head is made of slashes only (``/c`` -> ``/``, ``c`` -> ``''``)."""
    p = _c(path)
    head = p.substr(F.lit(1), F.length(p) - F.length(basename(p)))
    stripped = F.rtrim(head, F.lit("/"))
    return F.when(stripped == "", head).otherwise(stripped)


def _ext_of_base(base: Column) -> Column:
    # names its argument once: a filter on it is pushed down to where the path is
    # put together, and would make the path anew for each mention.
    # a dot counts only with a non-dot character before it (".bashrc": none)
    found = F.regexp_extract(base, r"(?s)^\.*+[^.].*(\.[^.]*)\z", 1)
    return F.coalesce(found, F.nullif(F.lit(""), F.lit(".")))  # always '', yet typed as nullable like all text


def extension(path) -> Column:
    """Suffix with its dot, case kept; ``''`` when there is none."""
    return _ext_of_base(basename(path))


def stem(path) -> Column:
    """Base name without its extension."""
    base = basename(path)
    ext = _ext_of_base(base)
    return base.substr(F.lit(1), F.length(base) - F.length(ext))


def filetype(path) -> Column:
    """Lower-cased suffix with dot."""
    return F.lower(extension(path))


def normalize_path(path, case_insensitive: bool = False, base: str = "/") -> Column:
    """Absolute, normalized path key: ``.``, ``..`` and repeated slashes
    collapsed; relative paths resolved against ``base``. With
    ``case_insensitive`` (Windows rule) ``\\`` becomes ``/`` and case is folded.
    """
    p = _c(path)
    if case_insensitive:
        p = F.lower(F.regexp_replace(p, r"\\", "/"))
    base = base.rstrip("/") + "/"
    # fast path: an absolute path without empty, '.' or '..' segments and
    # without a trailing slash is already normal (CASE evaluates the
    # segment walk below only for the other rows). It names the path seldom:
    # a join's null check of the key is pushed down to where the path is put together
    given, normal = p, p.startswith("/") & ~p.rlike(r"/\.{0,2}(?:/|\z)")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base), p))
    # POSIX keeps exactly two leading slashes, collapses three or more to one
    lead = F.when(p.rlike(r"^//[^/]") | (p == "//"), F.lit("//")).otherwise(F.lit("/"))
    parts = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(normal, given).otherwise(F.concat(lead, F.array_join(parts, "/")))


def link(path) -> Column:
    """Hyperlink text ``file:///<path>``; NULL path gives NULL."""
    return F.concat(F.lit("file:///"), _c(path))


def relative_to(path, root: str) -> Column:
    """Path relative to ``root`` (which must be a prefix); NULL otherwise."""
    r = root.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(r), p.substr(len(r) + 1, 1 << 30))
