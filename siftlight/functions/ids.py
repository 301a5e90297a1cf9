"""Normal forms of ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_id(c: Column | str) -> Column:
    """Trimmed of blanks and lower-cased; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def finite(c: Column | str) -> Column:
    """The value as double, null for null and NaN."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d), d)
