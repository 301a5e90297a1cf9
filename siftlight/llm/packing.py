"""Containers of fixed capacity filled with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlight.operators.hotkeys import lookup_join
from siftlight.scratch import materialize

#: Items that are packed together in one task, on average.
GROUP = 4000
#: Containers filled less than this are opened again and packed with those of other groups.
REOPEN = 0.97
#: Kinds of container that may be given.
MAX_KINDS = 1000
#: Groups whose containers are numbered in one task.
NUMBERED = 10_000


class _Bins:
    """Bins of one group: contents, gaps, and the moves of the local search.

    Every move raises the sum of the squared fills, so the search ends.
    """

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bin_of = np.full(len(sizes), -1)
        self.gaps: np.ndarray = np.zeros(0, np.int64)

    def fill_first(self) -> None:
        """Best fit, longest item first."""
        open_: list[tuple[int, int]] = []
        gaps: list[int] = []
        for i in np.argsort(-self.sizes, kind="stable"):
            size = int(self.sizes[i])
            at = bisect_left(open_, (size, -1))
            if at < len(open_):
                gap, b = open_.pop(at)
            else:
                gap, b = self.capacity, len(gaps)
                gaps.append(0)
            gaps[b] = gap - size
            self.bin_of[i] = b
            if gaps[b]:
                insort(open_, (gaps[b], b))
        self.gaps = np.array(gaps, np.int64)

    def _put(self, item: int, to: int) -> None:
        self.gaps[self.bin_of[item]] += self.sizes[item]
        self.gaps[to] -= self.sizes[item]
        beside = np.flatnonzero(self.bin_of == to)
        self.bin_of[item] = to
        self._pairs.append((np.full(len(beside), item), beside))

    def _all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The items of every pair that lies in one bin, and pairs that are parted since; none is missing."""
        if len(self._pairs) > 64:
            self._pairs = [tuple(np.concatenate(x) for x in zip(*self._pairs))]
        if len(self._pairs) > 1:
            self._pairs = [self._pairs[0], tuple(np.concatenate(x) for x in zip(*self._pairs[1:]))]
        return tuple(np.concatenate(x) for x in zip(*self._pairs))

    def _index_pairs(self) -> None:
        """Start the list of pairs from the bins as they are."""
        order = np.argsort(self.bin_of, kind="stable")
        held = np.bincount(self.bin_of, minlength=len(self.gaps))
        ends = np.cumsum(held)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in np.unique(held[held > 1]):
            bins = np.flatnonzero(held == n)
            inside = order[(ends[bins] - n)[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            parts.append((inside[:, i].ravel(), inside[:, j].ravel()))
        self._pairs = [tuple(np.concatenate(x) for x in zip(*parts))]

    def _step(self, a: int, items: np.ndarray, dead: np.ndarray) -> bool:
        """One move, or exchange for one or two shorter items, that shortens bin ``a`` and raises the squared fill.

        A move takes the bin it fills best; an exchange brings the shortest items back. All items of all other
        bins are looked at.
        """
        room = np.where(dead, -1, self.gaps)
        room[a] = -1
        own = self.gaps[a]
        sizes = np.unique(self.sizes[items])[::-1]  # equal items can do the same

        def item(size: int) -> int:
            return int(items[np.argmax(self.sizes[items] == size)])

        for size in sizes:
            fits = np.flatnonzero((room >= size) & (room - size < own))
            if len(fits):
                self._put(item(size), int(fits[np.argmin(room[fits])]))
                return True
        gap = room[self.bin_of]
        for size in sizes:
            more = size - self.sizes
            swap = np.flatnonzero((more > 0) & (gap >= more) & (gap - more < own))
            if len(swap):
                y = int(swap[np.argmin(self.sizes[swap])])
                b, x = int(self.bin_of[y]), item(size)
                self._put(y, a)
                self._put(x, b)
                return True
        first, second = self._all_pairs()
        together = self.bin_of[first] == self.bin_of[second]
        first, second = first[together], second[together]
        self._pairs = [(first, second)]
        both, gap = self.sizes[first] + self.sizes[second], room[self.bin_of[first]]
        for size in sizes:
            more = size - both
            swap = np.flatnonzero((more > 0) & (gap >= more) & (gap - more < own))
            if len(swap):
                k = swap[np.argmin(both[swap])]
                b, x = int(self.bin_of[first[k]]), item(size)
                self._put(int(first[k]), a)
                self._put(int(second[k]), a)
                self._put(x, b)
                return True
        return False

    def _loosen(self, a: int, size: int, dead: np.ndarray) -> bool:
        """One exchange between two other bins after which one of them has room for ``size``, the last item of ``a``.

        The fuller one takes the longer item, which raises the sum of the squared fills. All pairs of items
        that could do it are looked at: those in a bin whose longest item and the shortest of all leave enough room.
        """
        room = np.where(dead, -1, self.gaps)
        room[a] = -1
        others = np.flatnonzero(room[self.bin_of] >= 0)
        if not len(others):
            return False
        sizes, bins = self.sizes[others], self.bin_of[others]
        gap = room[bins]
        need = size - gap
        able = np.flatnonzero(sizes - sizes.min() >= need)
        if not len(able):
            return False
        # of the items short enough, the one with most room to grow: without it there is no exchange
        order = np.argsort(sizes, kind="stable")
        reach = np.maximum.accumulate((sizes + gap)[order])
        at = np.searchsorted(sizes[order], sizes[able] - need[able], side="right") - 1
        able = able[(at >= 0) & (reach[np.maximum(at, 0)] >= sizes[able])]
        for k in able[np.argsort(-gap[able], kind="stable")]:
            more = sizes[k] - sizes
            ok = (bins != bins[k]) & (more >= need[k]) & (more <= gap) & (more > gap - gap[k])
            if ok.any():
                x = int(others[np.flatnonzero(ok)[np.argmin(more[ok])]])
                to, b = int(self.bin_of[x]), int(bins[k])
                self._put(x, b)
                self._put(int(others[k]), to)
                return True
        return False

    def search(self) -> None:
        """Try to empty every bin, the least filled first, again and again until nothing more can be moved.

        It also ends when there are as few bins as the sum of the sizes allows.
        """
        dead = np.zeros(len(self.gaps), bool)
        least = -(-int(self.sizes.sum()) // self.capacity)
        moved = True
        if len(self.gaps) > least:
            self._index_pairs()
        while moved:
            moved = False
            for a in np.argsort(-self.gaps, kind="stable"):
                if (~dead).sum() <= least:
                    return
                while not dead[a] and self.gaps[a] > 0:
                    items = np.flatnonzero(self.bin_of == a)
                    if not len(items):
                        dead[a] = True
                    elif not self._step(a, items, dead) and not (len(items) == 1 and self._loosen(a, int(self.sizes[items[0]]), dead)):
                        break
                    else:
                        moved = True


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item, numbered from 0; no bin holds more than ``capacity``.

    Items as long as the capacity have a bin of their own. Items of size 0 join the first bin.
    """
    sizes = np.asarray(sizes, np.int64)
    result = np.zeros(len(sizes), np.int64)
    full, some = sizes == capacity, (sizes > 0) & (sizes < capacity)
    result[full] = np.arange(full.sum())
    if some.any():
        bins = _Bins(sizes[some], capacity)
        bins.fill_first()
        bins.search()
        result[some] = np.unique(bins.bin_of, return_inverse=True)[1] + full.sum()
    return result


def _packed(items: DataFrame, turn: int, size: int) -> DataFrame:
    """Items with group and bin; groups hold about ``size`` items of one kind of container each."""
    counts = {r["container"]: r["n"] for r in items.groupBy("container").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return items.withColumns({"turn": F.lit(turn), "grp": F.lit(0).cast("long"), "bin": F.lit(0).cast("long")})
    groups = F.lit(1)
    for kind, n in counts.items():
        groups = F.when(F.col("container") == kind, max(1, -(-n // size))).otherwise(groups)
    grp = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), groups).alias("grp")
    schema = "container string, capacity int, doc_id long, piece int, tokens long, grp long, bin long"

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        return pdf.assign(bin=pack(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0])))

    named = items.select("container", "capacity", "doc_id", "piece", "tokens", grp.cast("long"))
    return named.groupBy("container", "grp").applyInPandas(of_group, schema).withColumn("turn", F.lit(turn))


def filled(sizes: DataFrame, kinds: DataFrame, group: int = GROUP) -> DataFrame:
    """(container, capacity, container_no, doc_id, piece, tokens): items in containers of every kind.

    ``sizes`` is (doc_id, tokens), one row per item; ``kinds`` is (container, capacity), a table of at
    most MAX_KINDS rows; kinds without a positive capacity are left out. An item longer than the capacity
    is cut into pieces of the capacity and a rest, any other is one piece, 0. Items of null size count
    as empty, and an empty item takes no room. Containers are numbered from 0 within their kind.

    Items are packed in groups of bounded size that are drawn by hash, so no task holds more; containers
    that came out badly filled are opened and packed once more, in other groups.
    """
    known = kinds.where("container is not null and capacity > 0").distinct().limit(MAX_KINDS + 1).collect()
    if len(known) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    kind = F.explode(
        F.array(*(F.struct(F.lit(r["container"]).alias("container"), F.lit(int(r["capacity"])).alias("capacity")) for r in known))
        if known
        else F.expr("cast(array() as array<struct<container: string, capacity: int>>)")
    )
    each = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), kind.alias("k"))
    cap = F.col("k.capacity")
    pieces = F.greatest(F.ceil(F.col("tokens") / cap), F.lit(1)).cast("int")
    items = each.select(
        F.col("k.container").alias("container"), cap.alias("capacity"), "doc_id", "tokens",
        F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"),
    ).withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity")))
    first = materialize(_packed(items, 1, group), "packed")
    bins = first.groupBy("container", "grp", "bin").agg(
        F.sum("tokens").alias("fill"), F.first("capacity").alias("capacity"), F.count("*").alias("size")
    )
    loose = bins.where(F.col("fill") < F.col("capacity") * REOPEN).select("container", "grp", "bin", "size")
    loose = materialize(loose, "loose-bins")
    columns = ["container", "capacity", "doc_id", "piece", "tokens"]
    keys = ["container", "grp", "bin"]
    again = lookup_join(first, loose, keys, "size").select(*columns)
    second = materialize(_packed(again, 2, group), "packed")
    kept = first.join(loose.select(*keys), keys, "left_anti")
    every = kept.select(*columns, "turn", "grp", "bin").unionByName(second.select(*columns, "turn", "grp", "bin"))

    # dense numbers: bins of a group in order, groups one after the other, in two levels so that no task has all groups
    used = every.groupBy("container", "turn", "grp").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("size"))
    used = materialize(used.withColumn("part", F.floor(F.col("grp") / NUMBERED)), "bin-bases")
    parts = used.groupBy("container", "turn", "part").agg(F.sum("bins").alias("bins"), F.count("*").alias("size"))

    def running(window: Window) -> Column:
        return F.coalesce(F.sum("bins").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    whole = Window.partitionBy("container").orderBy("turn", "part")  # a row for NUMBERED groups
    starts = parts.select("container", "turn", "part", "size", running(whole).alias("start"))
    within = Window.partitionBy("container", "turn", "part").orderBy("grp")
    inner = used.withColumn("inner", running(within)).withColumnRenamed("size", "rows").drop("bins")
    base = lookup_join(inner, materialize(starts, "bin-bases"), ["container", "turn", "part"], "size")
    base = base.select("container", "turn", "grp", F.col("rows").alias("size"), (F.col("start") + F.col("inner")).alias("base"))
    numbered = lookup_join(every, materialize(base, "bin-bases"), ["container", "turn", "grp"], "size")
    inside = Window.partitionBy("container", "turn", "grp").orderBy("bin")  # the items of one group
    number = F.col("base") + F.dense_rank().over(inside) - 1
    return numbered.select("container", "capacity", number.cast("long").alias("container_no"), "doc_id", "piece", "tokens")
