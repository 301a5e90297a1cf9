"""Features of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth(url: Column) -> Column:
    """Number of slashes; 0 for null and empty."""
    u = F.coalesce(url, F.lit(""))
    return (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))).cast("double")


def from_wikipedia(url: Column) -> Column:
    """1 if the lower-cased URL holds the encyclopedia's domain, else 0; 0 for null."""
    return F.coalesce(F.lower(url).contains("wikipedia.org").cast("double"), F.lit(0.0))


def domain_score(url: Column) -> Column:
    """1 for .edu and .mil anywhere in the URL, 0.95 for .org, else and for null 0."""
    u = F.coalesce(url, F.lit(""))
    return F.when(u.contains(".edu") | u.contains(".mil"), 1.0).when(u.contains(".org"), 0.95).otherwise(0.0)
