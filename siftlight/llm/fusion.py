"""One ranking from scores on different scales."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.functions.ids import finite, norm_id
from siftlight.operators.hotkeys import lookup_join
from siftlight.scratch import materialize

#: Median absolute deviation of a normal distribution of deviation 1.
MAD_OF_NORMAL = 0.6745
#: Rank error of a group's median: 1 / ACCURACY of the group; exact for groups of up to some 10,000 rows.
ACCURACY = 100_000

#: The scores of p6: stored score, pageRank, BM25 and Indri on body, title and inlink.
FEATURES = ("f1", "f4", "f5", "f6", "f8", "f9", "f14", "f15")


def fused(rows: DataFrame, group: str, item: str, weights: Mapping[str, float]) -> DataFrame:
    """(group, item, fused): a weighted geometric mean of the scores, each brought to (0, 1).

    Within its group every score is centred on the median, divided by the median absolute deviation and
    put through a logistic function, so that neither range nor outliers give a score more say. A score
    that is null, NaN or infinite for an item, or equal for all items of the group, has no part in that
    item's mean; an item without any score gets 0.5. Where more than half of a group's values are equal
    the mean absolute deviation stands in for the median one.

    Rows of one item are joined by the mean of each score. Rows without group or item don't count.
    Medians come from mergeable sketches of bounded size and are looked up by group, large groups by
    broadcast, so that no group is gathered in one task.
    """
    names = list(weights)
    plain = rows.select(
        F.col(group), F.col(item),
        *(F.when(F.abs(finite(c)) < F.lit(1e300), finite(c)).alias(c) for c in names),
    ).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    mean = [F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c) for c in names]
    items = materialize(plain.groupBy(group, item).agg(*mean), "fusion-items")

    def median(c):
        return F.percentile_approx(c, 0.5, ACCURACY)

    centres = items.groupBy(group).agg(
        F.count("*").alias("size"),
        *(median(F.col(c)).alias(f"m_{c}") for c in names),
        *((F.min(c) < F.max(c)).alias(f"v_{c}") for c in names),
    )
    centres = materialize(centres, "fusion-centres")
    groups = centres.count()
    centred = lookup_join(items, centres, [group], "size", lookup_rows=groups)
    away = {c: F.abs(F.col(c) - F.col(f"m_{c}")) for c in names}
    spreads = centred.groupBy(group).agg(
        F.count("*").alias("size"),
        *(median(away[c]).alias(f"d_{c}") for c in names),
        *(F.avg(away[c]).alias(f"a_{c}") for c in names),
    )
    spreads = materialize(spreads, "fusion-spreads")
    scaled = lookup_join(centred.drop("size"), spreads, [group], "size", lookup_rows=groups)

    def log_squashed(c):
        spread = F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}") / MAD_OF_NORMAL).otherwise(F.col(f"a_{c}") * 1.2533)
        z = (F.col(c) - F.col(f"m_{c}")) / spread
        # ln(1 / (1 + e^-z)), written so that neither side overflows
        log = F.when(z >= 0, -F.log1p(F.exp(-z))).otherwise(z - F.log1p(F.exp(z)))
        return F.when(F.col(f"v_{c}") & F.col(c).isNotNull(), log)

    logs = {c: log_squashed(c) for c in names}
    total = sum((F.coalesce(logs[c] * F.lit(float(w)), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    say = sum((F.when(logs[c].isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return scaled.select(group, item, F.when(say > 0, F.exp(total / say)).otherwise(F.lit(0.5)).alias("fused"))


def first_items(features: DataFrame) -> DataFrame:
    """(qid, ext_id): the first item of every query under ``fused`` with equal weights.

    Ties, to 12 digits, go to the id that comes first.
    """
    rows = features.withColumn("ext_id", norm_id("ext_id"))
    scored = fused(rows, "qid", "ext_id", dict.fromkeys(FEATURES, 1.0))
    tied = scored.groupBy("qid", F.round("fused", 12).alias("fused")).agg(F.min("ext_id").alias("ext_id"))
    return tied.groupBy("qid").agg(F.max_by("ext_id", "fused").alias("ext_id"))
