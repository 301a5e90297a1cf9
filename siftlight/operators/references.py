"""References whose record is missing, deleted or not yet there."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlight.functions.ids import norm_id
from siftlight.operators.bloom import BloomFilter
from siftlight.scratch import materialize


def references(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(tab, ext_id, t, n) of tables that have an ``ext_id`` and the named time column.

    ``n`` rows refer to the id at that time. Null and blank ids are no references, and a row without a
    time can't be judged: both are left out. Equal references are joined before any shuffle by id, so a
    hot id costs only its distinct times.
    """
    parts = [
        df.select(F.lit(tab).alias("tab"), norm_id("ext_id").alias("ext_id"), F.col(at).cast("timestamp").alias("t"))
        for tab, (df, at) in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).where("ext_id is not null and t is not null")
    return rows.groupBy("tab", "ext_id", "t").agg(F.count("*").alias("n"))


def orphans(refs: DataFrame, records: DataFrame, max_bits: int | None = None) -> DataFrame:
    """(tab, ext_id, t, n, why) of the references that have no live record at their time.

    A record is live from ``indexed_at`` until before ``deleted_at`` (null: for ever). ``why`` is
    ``missing`` if no record has the id, else ``deleted`` if one was indexed by then, else ``late``.
    Records without indexed_at exist but are never live; one deleted when or before it was indexed was
    never live either. Repeated records change nothing.

    A broadcast Bloom filter of the record ids settles the references to ids it doesn't hold. Only the
    others are matched exactly: references and changes meet by id and hour, where a running count of live
    records is kept, carried over from the hours before. A task thus gets one hour of an id, never a whole id;
    equal times of an id are one row. With more ids than a filter of ``max_bits`` can serve all references
    are matched that way.
    """
    records = records.select(
        norm_id("ext_id").alias("ext_id"), F.col("indexed_at").cast("timestamp").alias("a"),
        F.col("deleted_at").cast("timestamp").alias("z"),
    ).where("ext_id is not null").distinct()
    records = materialize(records, "records")
    refs = materialize(refs, "references")
    seen = BloomFilter(records, "ext_id", max_bits).may_contain(F.col("ext_id"))
    tested = materialize(refs.withColumn("seen", seen), "references")
    columns = ["tab", "ext_id", "t", "n"]
    proved = tested.where("not seen").select(*columns, F.lit("missing").alias("why"))
    open_ = tested.where("seen").withColumn("hour", F.date_trunc("hour", "t"))

    # what an id's records change at a time: live ones, and ones that have begun
    lasting = F.col("z").isNull() | (F.col("z") > F.col("a"))
    begun = records.where("a is not null").select(
        "ext_id", F.col("a").alias("t"), lasting.cast("int").alias("live"), F.lit(1).alias("begun")
    )
    ended = records.where((F.col("z") > F.col("a"))).select(
        "ext_id", F.col("z").alias("t"), F.lit(-1).alias("live"), F.lit(0).alias("begun")
    )
    changes = begun.unionByName(ended).groupBy("ext_id", "t").agg(
        F.sum("live").alias("live"), F.sum("begun").alias("begun")
    ).withColumn("hour", F.date_trunc("hour", "t"))

    # state of an id at the start of each hour that has a reference
    hours = changes.groupBy("ext_id", "hour").agg(F.sum("live").alias("live"), F.sum("begun").alias("begun"))
    hours = hours.withColumns({"known": F.lit(1), "asked": F.lit(0)})
    exists = records.where("a is null").select("ext_id").distinct().select(
        "ext_id", F.lit(None).cast("timestamp").alias("hour"), F.lit(0).cast("long").alias("live"),
        F.lit(0).cast("long").alias("begun"), F.lit(1).alias("known"), F.lit(0).alias("asked"),
    )
    asked = open_.select("ext_id", "hour").distinct().withColumns(
        {"live": F.lit(0).cast("long"), "begun": F.lit(0).cast("long"), "known": F.lit(0), "asked": F.lit(1)}
    )
    both = hours.unionByName(exists).unionByName(asked).groupBy("ext_id", "hour").agg(
        *(F.sum(c).alias(c) for c in ("live", "begun")), *(F.max(c).alias(c) for c in ("known", "asked"))
    )
    per_id = Window.partitionBy("ext_id")
    earlier = per_id.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(
        "ext_id", "hour", "asked",
        F.coalesce(F.sum("live").over(earlier), F.lit(0)).alias("live"),
        F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("begun"),
        F.max("known").over(per_id).alias("known"),
    ).where("asked = 1")

    # rank: the carried state first, then changes, then the references that see them
    empty = {"tab": F.lit(None).cast("string"), "n": F.lit(None).cast("long")}
    start = carried.select("ext_id", "hour", "live", "begun", "known").withColumns(
        {"t": F.lit(None).cast("timestamp"), "rank": F.lit(0), **empty}
    )
    inside = changes.withColumns({"known": F.lit(0), "rank": F.lit(1), **empty})
    ask = open_.select(*columns, "hour").withColumns(
        {"live": F.lit(0).cast("long"), "begun": F.lit(0).cast("long"), "known": F.lit(0), "rank": F.lit(2)}
    )
    per_hour = Window.partitionBy("ext_id", "hour")
    so_far = per_hour.orderBy("t", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = start.unionByName(inside).unionByName(ask).withColumns(
        {
            "is_live": F.sum("live").over(so_far),
            "has_begun": F.sum("begun").over(so_far),
            "is_known": F.max("known").over(per_hour),
        }
    )
    why = F.when(F.col("is_known") == 0, "missing").when(F.col("has_begun") > 0, "deleted").otherwise("late")
    verified = state.where("rank = 2 and is_live = 0").select(*columns, why.alias("why"))
    return proved.unionByName(verified)


def with_month(orphan_rows: DataFrame) -> DataFrame:
    """Orphans with ``ref_month``, their time as yyyy-MM."""
    return orphan_rows.withColumn("ref_month", F.date_format("t", "yyyy-MM"))


def orphan_report(orphan_rows: DataFrame) -> DataFrame:
    """(tab, ref_month, why, refs, ids): orphan references and distinct orphan ids per table and month."""
    per_id = with_month(orphan_rows).groupBy("tab", "ref_month", "why", "ext_id").agg(F.sum("n").alias("n"))
    return per_id.groupBy("tab", "ref_month", "why").agg(F.sum("n").alias("refs"), F.count("*").alias("ids"))
