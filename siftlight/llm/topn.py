"""The N first items of every group, found by bisecting all groups at once."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlight.functions.ids import finite, norm_id
from siftlight.operators.hotkeys import lookup_join
from siftlight.scratch import materialize

#: Midpoints tried at once divide a group's interval into so many sections; infinite scores have one more on either side.
SECTIONS = 256
#: Bytes of an identifier in one part of the code: with their number they make 51 bits, exact in a double.
CHUNK = 6
_MOST = float(2 ** (8 * CHUNK + 3))


def _chunk(identifier: Column, level: Column) -> Column:
    """Bytes CHUNK * (level - 1) and on of an identifier, and how many there are, as a number in the order of the bytes.

    Of two identifiers that differ only in closing zero bytes the shorter one comes first.
    """
    part = F.substring(F.encode(identifier, "utf-8"), (level - 1) * CHUNK + 1, F.lit(CHUNK))
    return F.conv(F.rpad(F.hex(part), 2 * CHUNK, "0"), 16, 10).cast("double") * 8 + F.length(part)


def _code(level: Column, score: Column, identifier: Column) -> Column:
    """The part of an item's code that its group is at: level 0 the score downwards, then the identifier."""
    return F.when(level == 0, -score + F.lit(0.0)).otherwise(_chunk(identifier, level))


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _octave(x: Column) -> Column:
    """A number that grows with x and by 1 where |x| doubles; 0 for 0."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


#: How a group's interval is divided: by octave or not, what a value is multiplied by, where it begins, sections per unit.
_RULE = ["octave", "factor", "base", "slope"]


def _rule(lo: Column, hi: Column, by_octave: bool) -> list[Column]:
    """The columns of _RULE for [lo, hi]; lo and hi never share a section unless they are equal.

    Sections are of equal width, or with ``by_octave`` as wide as a value is large where lo and hi lie far
    apart: in turn, the two find the cutoff among scores of any scale within some ten rounds. Halves keep
    the width from overflowing, a factor keeps it from vanishing.
    """
    tiny = F.when(F.greatest(F.abs(lo), F.abs(hi)) < 2.0**-500, F.lit(2.0**500)).otherwise(F.lit(1.0)) / 2
    octave = F.coalesce(_octave(hi) - _octave(lo) > 10, F.lit(False)) & F.lit(by_octave)
    base = F.when(octave, _octave(lo)).otherwise(lo * tiny)
    width = F.when(octave, _octave(hi)).otherwise(hi * tiny) - base
    return [c.alias(n) for c, n in zip((octave, tiny, base, F.when(width > 0, SECTIONS / width).otherwise(0.0)), _RULE)]


def _section(x: Column) -> Column:
    """The section that x falls into by the columns of _RULE; infinite values have their own."""
    inf = F.lit(float("inf"))
    value = F.when(F.col("octave"), _octave(x)).otherwise(x * F.col("factor"))
    at = F.coalesce((value - F.col("base")) * F.col("slope"), F.lit(0.0))
    inside = F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(SECTIONS - 1.0))).cast("int")
    return F.when(x == -inf, -1).when(x == inf, SECTIONS).otherwise(inside)


def _next_state(counts: DataFrame, groups: list[str], by_octave: bool) -> DataFrame:
    """From section counts the section in which the group's cutoff lies, and where to look inside it.

    The window runs over at most SECTIONS + 2 rows of a group.
    """
    before = Window.partitionBy(*groups).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = cum.where("before < need and before + n >= need")
    need = F.col("need") - F.col("before")
    single = F.col("lo") == F.col("hi")
    lo, hi = F.when(single, F.lit(0.0)).otherwise(F.col("lo")), F.when(single, F.lit(_MOST)).otherwise(F.col("hi"))
    return hit.select(
        *groups, F.col("section").alias("cut"), F.col("n").alias("size"), need.alias("need"), (need == F.col("n")).alias("done"),
        F.when(single, F.col("level") + 1).otherwise(F.col("level")).alias("level"),
        *_rule(lo, hi, by_octave),
    )


def top_n(items: DataFrame, groups: list[str], score: str, identifier: str, n: int) -> DataFrame:
    """The ``n`` first rows of each group by ``score`` downwards, then ``identifier`` in byte order.

    ``items`` must have one row per group and identifier (ValueError if the cutoff falls among repeats),
    with a score that is neither null nor NaN; infinite ones are first or last. A group with up to ``n``
    items comes out whole, before the first round. All others are refined together: an item's code is its
    score and then its identifier, each round counts the items of every group between the midpoints of the
    group's interval, and the interval shrinks to the one section that holds the cutoff. Items below it
    are taken, items above it are dropped, so that only undecided ones are read in the next round. No group
    is ever sorted or gathered: counts are combined map-side, and the cutoffs of large groups reach their
    items by broadcast. A round reads its items once, and writes with them the section that the next
    round counts.

    Columns named like the internal ones (level, lo, hi, need, section, x, sure and those of _RULE) must be renamed before.
    """
    columns = [*groups, score, identifier]
    key = [F.col(g) for g in groups]
    first = _code(F.lit(0), F.col(score), F.col(identifier))
    edges = items.groupBy(*key).agg(
        F.count("*").alias("size"), F.min(_finite(first)).alias("lo"), F.max(_finite(first)).alias("hi"),
        F.max(F.octet_length(identifier)).alias("bytes"),
    )
    edges = materialize(edges, "topn-groups")
    count, most = edges.agg(F.count("*"), F.max("bytes")).first()
    if not count:
        return items.select(*columns).limit(0)
    rules = edges.select(*groups, "size", *_rule(F.col("lo"), F.col("hi"), False))
    placed = lookup_join(items.select(*columns), rules, groups, "size", lookup_rows=count).select(
        *columns, (F.col("size") <= n).alias("sure"), _section(first).alias("section"), first.alias("x"), F.lit(n).cast("long").alias("need"), F.lit(0).alias("level"),
    )
    taken: list[DataFrame] = []
    for turn in itertools.count(1):
        placed = materialize(placed, "topn-items")
        taken.append(placed.where("sure").select(*columns))
        open_ = placed.where("not sure")
        counted = open_.groupBy(*key, "section").agg(
            F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
            F.first("level").alias("level"), F.first("need").alias("need"),
        )
        after = materialize(_next_state(counted, groups, turn % 2 == 1), "topn-groups")
        count, level = after.agg(F.count("*"), F.max(F.when(~F.col("done"), F.col("level")))).first()
        if not count:
            return reduce(DataFrame.unionByName, taken)
        if level is not None and level > 1 + -(-(most or 0) // CHUNK):
            raise ValueError(f"repeated values of {identifier} in a group")
        at = lookup_join(open_.select(*columns, "section"), after, groups, "size", lookup_rows=count)
        undecided = (F.col("section") == F.col("cut")) & ~F.col("done")
        x = _code(F.col("level"), F.col(score), F.col(identifier))
        coded = at.where(F.col("section") <= F.col("cut")).withColumn("x", F.when(undecided, x))
        placed = coded.select(
            *columns, (~undecided).alias("sure"), F.when(undecided, _section(F.col("x"))).alias("section"), "x", "need", "level"
        )


def ranked_items(runs: DataFrame) -> DataFrame:
    """(run_id, qid, ext_id, score): an item once per ranking, with its highest score.

    Rows without run_id, qid, id or score (null or NaN) and those of the item ``dummy`` don't count.
    Aggregating by item also spreads a ranking that holds a large share of all rows.
    """
    rows = runs.select("run_id", "qid", norm_id("ext_id").alias("ext_id"), finite("score").alias("score"))
    real = rows.where(
        "run_id is not null and qid is not null and score is not null and ext_id is not null and ext_id <> 'dummy'"
    )
    return real.groupBy("run_id", "qid", "ext_id").agg(F.max("score").alias("score"))


def top_ranked(runs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` first items of every run and query; see ``ranked_items`` and ``top_n``."""
    items = materialize(ranked_items(runs), "topn-items")
    return top_n(items, ["run_id", "qid"], "score", "ext_id", n)
