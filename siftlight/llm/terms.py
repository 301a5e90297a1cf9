"""Term statistics over term vectors.

``newest`` and ``flat_terms`` turn the raw vectors into the terms of each page. ``TermCounts`` keeps
occurrences and page counts of every term under additions, changes and deletions of pages.
``parsimonious`` scores the terms of a page against the whole collection.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.operators.hotkeys import lookup_join
from siftlight.scratch import materialize, names, new_path, read_text, remove, write_text

#: Share of the page's own model in the mixture with the collection's.
OWN_SHARE = 0.005
#: Expectation-maximisation stops when no term moves more than this. A page that still moves after MAX_STEPS is an error.
TOLERANCE = 1e-6
MAX_STEPS = 1_000_000
#: Terms whose pages are worked on at once; a page is never divided.
PORTION = 300_000
#: Terms of a bucket of a new store, and its buckets at least.
BUCKET_TERMS, LEAST_BUCKETS = 250_000, 16
_COUNTS = "stem string, occurrences long, pages long"


def vectors(tv: DataFrame, field: str) -> DataFrame:
    """The rows of one field; rows without doc_id are left out."""
    same = F.lower(F.trim("field")) == field
    return tv.where(same & F.col("doc_id").isNotNull()).select("doc_id", "indexed_at", "stems", "stems_freq")


def newest(rows: DataFrame) -> DataFrame:
    """One row per doc_id, that of the newest indexed_at (null is oldest; ties by content).

    The maximum is combined map-side, so repeats of one hot page don't meet in one task.
    """
    state = F.max(F.struct("indexed_at", "stems", "stems_freq")).alias("s")
    return rows.groupBy("doc_id").agg(state).select("doc_id", "s.*")


def _with_one(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _added_up(raw: Column) -> Column:
    """An array of (stem, tf) with equal stems added up; where all differ, as most do, it is the array itself."""
    words = F.transform(raw, lambda p: p["stem"])

    def repeated(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda w, i: (i > 0) & (w == F.get(ordered, i - 1))))

    def whole(word: Column) -> Column:
        own = F.filter(raw, lambda p: p["stem"] == word)
        return F.struct(word.alias("stem"), F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + p["tf"]).alias("tf"))

    def merged(twice: Column) -> Column:
        return F.concat(F.filter(raw, lambda p: ~F.array_contains(twice, p["stem"])), F.transform(twice, whole))

    several = _with_one(_with_one(F.sort_array(words), repeated), merged)
    return F.when(F.size(F.array_distinct(words)) == F.size(words), raw).otherwise(several)


def flat_terms(states: DataFrame, *by: str) -> DataFrame:
    """(doc_id, by, terms): an array of (stem, tf), stems trimmed and lower-cased and equal ones added up.

    Null and blank stems, the stopword slot and counts below 1 are left out; a page without any term has an
    empty array. ``states`` must have one row per page (and ``by``); a row's terms are worked out inside
    the row, so nothing is shuffled or sorted.
    """
    keys = ["doc_id", *by]
    zipped = F.coalesce(F.arrays_zip("stems", "stems_freq"), F.expr("cast(array() as array<struct<stems: string, stems_freq: int>>)"))
    pairs = F.transform(zipped, lambda e: F.struct(F.lower(F.trim(e["stems"])).alias("stem"), e["stems_freq"].cast("long").alias("tf")))
    raw = F.filter(pairs, lambda p: F.coalesce((p["stem"] != "") & (p["tf"] > 0), F.lit(False)))
    return states.select(*keys, raw.alias("raw")).select(*keys, _added_up(F.col("raw")).alias("terms"))


def page_terms(states: DataFrame) -> DataFrame:
    """(doc_id, stem, tf) of one row per page; see ``flat_terms``."""
    return flat_terms(states).select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*")


def term_counts(terms: DataFrame) -> DataFrame:
    """(stem, occurrences, pages) of page terms; a stem is pre-aggregated before it is shuffled."""
    return terms.groupBy("stem").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("pages"))


class TermCounts:
    """Occurrences and pages of every term, in a store that signed deltas bring up to date.

    A store is a folder: ``data/v<version>/bucket=<number>`` holds (stem, occurrences, pages) of the terms
    of a bucket, and ``manifest/<version>.json`` says of every bucket which version of it counts, and how
    many pages have a vector. A merge writes the buckets that a batch of changes touches and then a new
    manifest; readers see the old or the new version, never a part. A later session opens the store by its
    path. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, pages: int, buckets: int, held: dict[int, int]):
        self.spark, self.path, self.version, self.pages, self.buckets, self.held = spark, path, version, pages, buckets, held

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("stem"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, numbers: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/data/v{self.held[b]}/bucket={b}" for b in sorted(numbers) if b in self.held]
        if not paths:
            return self.spark.createDataFrame([], _COUNTS)
        return self.spark.read.schema(_COUNTS).parquet(*paths)

    @property
    def counts(self) -> DataFrame:
        """(stem, occurrences, pages) of every term."""
        return self._read(self.held)

    def _write(self, counts: DataFrame, version: int, touched: Iterable[int] | None, pages: int) -> TermCounts:
        """The store after ``counts`` (bucket, ..) took the place of the ``touched`` buckets (None: all)."""
        folder, manifest = f"{self.path}/data/v{version}", f"{version:09d}.json"
        if manifest in names(self.spark, f"{self.path}/manifest"):
            raise FileExistsError(f"version {version} of {self.path} was written by another")
        remove(self.spark, folder)  # of a writer that didn't come to its manifest
        counts.write.partitionBy("bucket").parquet(folder)
        written = {int(n.removeprefix("bucket=")) for n in names(self.spark, folder) if n.startswith("bucket=")}
        gone = set(self.held if touched is None else touched)
        held = {b: v for b, v in self.held.items() if b not in gone} | dict.fromkeys(written, version)
        state = {"pages": pages, "buckets": self.buckets, "held": held}
        write_text(self.spark, f"{self.path}/manifest/{manifest}", json.dumps(state))
        return TermCounts(self.spark, self.path, version, pages, self.buckets, held)

    def clean(self) -> None:
        """Remove what only older versions read; call it when no reader has one open."""
        kept = {f"v{v}" for v in self.held.values()}
        for name in names(self.spark, f"{self.path}/data"):
            if name not in kept:
                remove(self.spark, f"{self.path}/data/{name}")
        for v in kept:
            for name in names(self.spark, f"{self.path}/data/{v}"):
                if name.startswith("bucket=") and f"v{self.held.get(int(name.removeprefix('bucket=')))}" != v:
                    remove(self.spark, f"{self.path}/data/{v}/{name}")
        for name in names(self.spark, f"{self.path}/manifest"):
            if name != f"{self.version:09d}.json":
                remove(self.spark, f"{self.path}/manifest/{name}")

    @classmethod
    def load(cls, states: DataFrame, path: str | None = None) -> TermCounts:
        """First load of the newest vectors, one row per page; see ``load_terms``."""
        return cls.load_terms(page_terms(states), states.select("doc_id").distinct().count(), path)

    @classmethod
    def load_terms(cls, terms: DataFrame, pages: int, path: str | None = None) -> TermCounts:
        """First load, from page terms (doc_id, stem, tf) and the number of pages, into ``path``.

        The number of buckets is fixed here, by the number of terms. Without a path the store is a scratch
        table of this application.
        """
        spark = terms.sparkSession
        path = path or new_path(spark, "term-counts")
        counts = materialize(term_counts(terms), "term-counts")
        store = cls(spark, path, 0, 0, max(LEAST_BUCKETS, -(-counts.count() // BUCKET_TERMS)), {})
        rows = counts.select(store._bucket(), "stem", "occurrences", "pages")
        return store._write(rows.repartition(store.buckets, "bucket"), 1, None, pages)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TermCounts:
        """The newest version of a store; raises FileNotFoundError where there is none."""
        manifests = [n for n in names(spark, f"{path}/manifest") if n.endswith(".json")]
        if not manifests:
            raise FileNotFoundError(path)
        state = json.loads(read_text(spark, f"{path}/manifest/{manifests[-1]}"))
        held = {int(b): v for b, v in state["held"].items()}
        return cls(spark, path, int(manifests[-1].removesuffix(".json")), state["pages"], state["buckets"], held)

    @staticmethod
    def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
        """(stem, occurrences, pages) to add: what the changed pages have now, less what they had.

        ``before`` and ``after`` are page terms of changed pages only; an added page has none in
        ``before``, a deleted one none in ``after``. Terms whose counts don't change come out not at all.
        """
        signed = after.withColumn("sign", F.lit(1)).unionByName(before.withColumn("sign", F.lit(-1)))
        total = signed.groupBy("stem").agg(
            F.sum(F.col("sign") * F.col("tf")).alias("occurrences"), F.sum("sign").cast("long").alias("pages")
        )
        return total.where("occurrences <> 0 or pages <> 0")

    def merge(self, before: DataFrame, after: DataFrame) -> TermCounts:
        """The next version from the vectors of changed pages, one row each; see ``merge_terms``.

        An added page is missing in ``before``, a deleted one in ``after``.
        """
        change = after.select("doc_id").distinct().count() - before.select("doc_id").distinct().count()
        return self.merge_terms(page_terms(before), page_terms(after), change)

    def merge_terms(self, before: DataFrame, after: DataFrame, more_pages: int) -> TermCounts:
        """The next version: the counts after a batch of changes; see ``deltas``.

        ``more_pages`` is by how much the number of pages with a vector grows. Only the batch's pages and
        the buckets of their terms are read and written. Counts that come to zero are dropped.
        """
        delta = materialize(self.deltas(before, after).select(self._bucket(), "stem", "occurrences", "pages"), "term-deltas")
        touched = {r["bucket"] for r in delta.select("bucket").distinct().collect()}  # at most the number of buckets
        if not touched and not more_pages:
            return self
        both = self._read(touched).select(self._bucket(), "stem", "occurrences", "pages").unionByName(delta)
        # the bucket alone decides where a row goes, so that this shuffle serves the sums and the files
        spread = both.repartition(max(1, len(touched)), "bucket")
        merged = spread.groupBy("bucket", "stem").agg(F.sum("occurrences").alias("occurrences"), F.sum("pages").alias("pages"))
        kept = merged.where("pages > 0 or occurrences > 0")
        return self._write(kept, self.version + 1, touched, self.pages + more_pages)

    def marked(self, min_pages: int = 3, min_occurrences: int = 5, common_share: float = 0.1) -> DataFrame:
        """Every term with its counts and ``mark``: rare, common or null.

        A term is rare in fewer than ``min_pages`` pages or with fewer than ``min_occurrences``
        occurrences, else common in more than ``common_share`` of all pages.
        """
        rare = (F.col("pages") < min_pages) | (F.col("occurrences") < min_occurrences)
        common = F.col("pages") > F.lit(float(common_share * self.pages))
        mark = F.when(rare, "rare").when(common, "common")
        return self.counts.select("stem", "occurrences", "pages", mark.alias("mark"))


def incremental_counts(tv: DataFrame, field: str, share: float = 0.8, path: str | None = None) -> TermCounts:
    """Counts over the newest vectors of ``field``, as a first load and one batch of changes.

    The first load is what stood in the index when about ``share`` of the rows were written; all later
    rows come as a batch of added and changed pages. For changed pages the state before is looked up by
    doc_id. The result equals a count over the newest row of every page.

    The vectors are shuffled once: an aggregation by page gives both its newest early and its newest late
    state.
    """
    rows = vectors(tv, field)
    # any cut gives the same result; an approximate quantile only sets the size of the batch
    seconds = F.unix_micros(F.col("indexed_at").cast("timestamp"))
    cut = rows.agg(F.percentile_approx(seconds, share, 100)).first()[0]
    late = F.coalesce(seconds > F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    # per page and side one state; a page's two sides lie in one partition
    state = F.max(F.struct("indexed_at", "stems", "stems_freq")).alias("s")
    sides = rows.groupBy("doc_id", late.alias("late")).agg(state).select("doc_id", "late", "s.*")
    pages = materialize(flat_terms(sides, "late"), "page-terms")
    flat = pages.select("doc_id", "late", F.explode("terms").alias("t")).select("doc_id", "late", "t.stem", "t.tf")
    changed = pages.where("late").select("doc_id")
    early = pages.where("not late").select("doc_id")
    store = TermCounts.load_terms(flat.where("not late").drop("late"), early.count(), path)
    if not changed.limit(1).count():
        return store
    known = materialize(early.join(changed, "doc_id", "left_semi"), "changed-pages")
    before = flat.where("not late").join(known, "doc_id", "left_semi").drop("late")
    return store.merge_terms(before, flat.where("late").drop("late"), changed.count() - known.count())


def _converged(page: np.ndarray, tf: np.ndarray, background: np.ndarray, own: float, steps: int, tolerance: float) -> np.ndarray:
    """The probabilities of the terms of whole pages, whose rows lie together."""
    width = np.diff(np.append(np.flatnonzero(np.append(True, page[1:] != page[:-1])), len(page)))
    first = np.cumsum(width) - width
    p = tf / np.repeat(np.add.reduceat(tf, first), width)
    # of the pages that still move: their entries, and the arrays of those
    at, n, q, c, bg = np.arange(len(p)), width, p, tf, (1.0 - own) * background
    for _ in range(steps):
        start = np.cumsum(n) - n
        expected = c * own * q / (own * q + bg)
        new = expected / np.repeat(np.add.reduceat(expected, start), n)
        moving = np.maximum.reduceat(np.abs(new - q), start) >= tolerance
        q = new
        if moving.all():
            continue
        p[at] = q  # a page that has converged stays
        kept = np.repeat(moving, n)
        at, q, c, bg, n = at[kept], q[kept], c[kept], bg[kept], n[moving]
        if not len(n):
            return p
    raise ArithmeticError(f"{len(n)} pages still move by {tolerance} after {steps} steps")


def _solve(own: float, steps: int, tolerance: float):
    """A function over Arrow batches, sorted by page, that runs the expectation-maximisation of many pages at once."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        page, tf, background = (rows.column(c).to_numpy() for c in ("doc_id", "tf", "background"))
        p = _converged(page, tf.astype(float), background, own, steps, tolerance)
        columns = [rows.column(c).combine_chunks() for c in ("doc_id", "stem", "tf", "pages")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(p)], names=["doc_id", "stem", "tf", "pages", "score"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < PORTION:
                continue
            rows = pa.Table.from_batches(held)
            page = rows.column("doc_id").to_numpy()
            cut = int(np.searchsorted(page, page[-1]))  # the last page may go on
            if cut:
                yield solved(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), 0
        if any(map(len, held)):
            yield solved(pa.Table.from_batches(held))

    return solve


def parsimonious(
    states: DataFrame,
    docs: DataFrame | None = None,
    own: float = OWN_SHARE,
    steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(doc_id, stem, tf, pages, score): how much of the page's own model each of its terms holds.

    A page's terms are a mixture of its own model and the collection's; expectation-maximisation leaves
    to the own model only what the collection doesn't explain, so the scores of widespread terms go to
    zero. A term's probability in the collection is its share of all (page, term) pairs: a term counts as
    widespread by the pages that hold it, not by much use in a few. The statistics are of all pages in
    ``states`` (one row per page); ``docs`` (doc_id) restricts only what is scored. Pages without terms
    come out with no row. The scores of a page add up to 1. ArithmeticError if a page still moves by
    ``tolerance`` after ``steps``.

    The vectors are shuffled once, into a table of the terms of each page that serves both the statistics
    and the scores. The background is joined, not collected: stems in a large share of the pages by
    broadcast, the others by shuffle. A page's terms are rows, so no batch grows with the vocabularies.
    """
    pages = materialize(flat_terms(states), "page-terms")
    entries = F.explode("terms").alias("t")
    counts = materialize(term_counts(pages.select("doc_id", entries).select("doc_id", "t.*")), "background")
    n, pairs = counts.agg(F.count("*"), F.sum("pages")).first()
    if docs is not None:
        asked = docs.select("doc_id").where("doc_id is not null").distinct()
        pages = pages.join(asked, "doc_id", "left_semi")
    terms = pages.select(F.col("doc_id").cast("long").alias("doc_id"), entries).select("doc_id", "t.stem", "t.tf")
    background = counts.select("stem", "pages", (F.col("pages") / F.lit(float(pairs or 1))).alias("background"))
    joined = lookup_join(terms, background, ["stem"], "pages", lookup_rows=n).select("doc_id", "stem", "tf", "background", "pages")
    together = joined.repartition("doc_id").sortWithinPartitions("doc_id", "stem")
    return together.mapInArrow(_solve(own, steps, tolerance), "doc_id long, stem string, tf long, pages long, score double")


def most_distinctive(scores: DataFrame, min_pages: int = 2) -> DataFrame:
    """(doc_id, stem): the best term of each page among those in ``min_pages`` pages or more.

    Ties: fewer pages, then the stem that comes first. Pages without such a term come out with no row.
    """
    best = F.max_by("stem", F.struct("score", (-F.col("pages")).alias("few")))
    rows = scores.where(F.col("pages") >= min_pages)
    # equal score and pages: the smallest stem
    tied = rows.groupBy("doc_id", "score", "pages").agg(F.min("stem").alias("stem"))
    return tied.groupBy("doc_id").agg(best.alias("stem"))
