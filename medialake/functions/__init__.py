"""Column-level helpers (``Column -> Column``), all built-in Spark functions."""

from medialake.functions import dates, numbers, paths, scalars, text, ticks  # noqa: F401
