"""Equi-joins whose keys may be very uneven.

A key that holds a large share of all rows would send them to one task of a shuffled join. The keys are
therefore divided by their row counts: at most ``bound`` keys can hold ``total / bound`` rows or more, so
the lookup rows of those keys always fit a broadcast; all other keys are small and are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: A lookup table of at most so many rows and bytes is broadcast whole.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""

    def of(c: Column, t: Y.DataType) -> Column:
        if isinstance(t, Y.StringType | Y.BinaryType):
            size = F.octet_length(c) + 16
        elif isinstance(t, Y.ArrayType):
            size = F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + of(x, t.elementType).cast("long"))
        elif isinstance(t, Y.MapType):
            size = of(F.map_keys(c), Y.ArrayType(t.keyType)) + of(F.map_values(c), Y.ArrayType(t.valueType))
        elif isinstance(t, Y.StructType):
            size = sum((of(c[f.name], f.dataType) for f in t), F.lit(16))
        else:
            return F.lit(8)
        return F.coalesce(size, F.lit(8))

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    *,
    lookup_rows: int | None = None,
    bound: int = 10_000,
) -> DataFrame:
    """Inner join of ``facts`` with ``lookup``, whose rows of one key all have the same weight.

    ``weight`` is a column of ``lookup`` that says how many rows of ``facts`` have the key (an upper
    estimate will do); it decides which keys are broadcast. Neither side is collected. What is broadcast has
    at most BROADCAST_ROWS rows and about BROADCAST_BYTES bytes: the rows are measured first. Null keys
    match nothing. ``lookup_rows`` saves a count where the caller knows it and the rows are of fixed width.
    """
    keys = list(keys)
    fixed = all(isinstance(f.dataType, Y.NumericType | Y.BooleanType | Y.DateType | Y.TimestampType) for f in lookup.schema)
    if lookup_rows is not None and lookup_rows <= BROADCAST_ROWS and fixed:
        return facts.join(F.broadcast(lookup), keys)
    n, total, whole, widest = lookup.select(F.col(weight).alias("w"), row_bytes(lookup).alias("b")).agg(
        F.count("*"), F.sum("w"), F.sum("b"), F.max("b")
    ).first()
    if n <= BROADCAST_ROWS and (whole or 0) <= BROADCAST_BYTES:
        return facts.join(F.broadcast(lookup), keys)
    bound = max(1, min(bound, BROADCAST_BYTES // widest))
    # count(weight >= total / bound) <= bound, whatever the data
    hot = lookup.where(F.col(weight) >= F.lit(max(1.0, (total or 0) / bound)))
    cold = lookup.where(~(F.col(weight) >= F.lit(max(1.0, (total or 0) / bound))) | F.col(weight).isNull())
    near = facts.join(F.broadcast(hot), keys)
    far = facts.join(F.broadcast(hot.select(*keys).distinct()), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


#: Lists of one key are divided into so many parts, and those into lists of at most LENGTH items, so that
#: a table of BROADCAST_ROWS lists has a size bound too.
PARTS, LENGTH = 1024, 64


def listed(rows: DataFrame, keys: Sequence[str], spread: str, *items: str) -> DataFrame:
    """(keys, items): the ``items`` of every key as arrays of at most LENGTH structs, a popular key in many rows.

    ``spread`` is the column by whose hash a key's rows are divided, so no list grows with the whole group.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(PARTS)).alias("_part")
    grouped = rows.groupBy(*keys, part).agg(F.collect_list(F.struct(*items)).alias("items"))
    starts = F.sequence(F.lit(1), F.size("items"), F.lit(LENGTH))
    return grouped.select(*keys, F.explode(F.transform(starts, lambda i: F.slice("items", i, LENGTH))).alias("items"))
