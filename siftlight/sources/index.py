"""The inverted index as tables, and how it is built.

    forward      field, doc_id, start, n, whole, terms    tokens of a field, or of a piece of it; null where a stopword stood
    docs         doc_id, ext_id, raw_url, spam_score, lens map<field, tokens after stopping>
    postings     field, bucket, term, doc_id, tf, positions
    term_stats   field, bucket, term, df, ctf
    field_stats  field, doc_count, sum_ttf
    index.json   buckets, analyzer

``postings`` and ``term_stats`` are partitioned by field and a hash bucket of the term and sorted by term
inside a file, so the lookup of a few terms prunes partitions and row groups. ``forward`` answers for
documents what the others answer for terms.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlight.functions import analysis
from siftlight.functions.analysis import Analyzer
from siftlight.functions.ids import norm_id
from siftlight.operators.hotkeys import lookup_join
from siftlight.plans import tree as T
from siftlight.scratch import materialize, new_path, read_text, write_text
from siftlight.sources.tables import table

#: Tokens that a task of the build gets on average; buckets and tasks follow from it and the tokens there are.
TASK_TOKENS = 2_000_000
#: Buckets of an index.
LEAST_BUCKETS, MOST_BUCKETS = 8, 512
#: Rows of ``forward`` from which the layout is planned: frequent terms are spread over more tasks. The
#: sample decides only where rows lie, not what they are.
PLAN_ROWS = 50_000


_SCHEMAS = {
    "docs": "doc_id long, ext_id string, raw_url string, spam_score int, lens map<string, bigint>",
    "postings": "term string, doc_id long, tf int, positions array<int>, field string, bucket int",
    "term_stats": "term string, df long, ctf long, field string, bucket int",
    "field_stats": "field string, doc_count long, sum_ttf long",
    "forward": "doc_id long, start int, n int, whole boolean, terms array<string>, field string",
}


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class FieldStats:
    doc_count: int
    sum_ttf: int

    @property
    def average(self) -> float:
        return self.sum_ttf / self.doc_count if self.doc_count else 0.0


@dataclass(frozen=True)
class Index:
    """Tables of one snapshot of a collection; ``postings`` and ``term_stats`` are missing in a forward index."""

    docs: DataFrame
    postings: DataFrame | None
    term_stats: DataFrame | None
    field_stats: DataFrame
    forward: DataFrame | None = None
    buckets: int = LEAST_BUCKETS
    analyzer: Analyzer = analysis.DEFAULT

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        about = json.loads(read_text(spark, f"{path}/index.json"))
        tables = (spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _SCHEMAS.items())
        return cls(*tables, about["buckets"], Analyzer.of(about["analyzer"]))

    @cached_property
    def n_docs(self) -> int:
        """All documents, those without a token included."""
        return self.docs.count()

    @cached_property
    def fields(self) -> dict[str, FieldStats]:
        """Statistics of each field, at most five rows."""
        return {r["field"]: FieldStats(r["doc_count"], r["sum_ttf"]) for r in self.field_stats.collect()}

    def stats(self, field: str) -> FieldStats:
        return self.fields.get(field, FieldStats(0, 0))

    def bucket(self, term: Column) -> Column:
        return bucket(term, self.buckets)

    def lists(self, terms: Sequence[T.Term]) -> DataFrame:
        """Postings of the given terms; only their partitions and row groups are read."""
        return self.postings.where(self._of(terms))

    def pieces(self, asked: DataFrame | None = None, field: str | None = None) -> DataFrame:
        """Rows of ``forward``, of all documents or those in ``asked`` (doc_id), of all fields or one."""
        rows = self.forward if field is None else self.forward.where(F.col("field") == field)
        return rows if asked is None else rows.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")

    def vectors(self, asked: DataFrame | None = None, field: str | None = None) -> DataFrame:
        """(doc_id, field, term, tf), the forward view of all documents, or of those in ``asked`` (doc_id).

        A field that is one row is counted inside the row; only fields made up of pieces are shuffled.
        """
        rows = self.pieces(asked, field).select("doc_id", "field", "whole", F.array_compact("terms").alias("terms"))
        counted = rows.where("whole").select("doc_id", "field", F.explode(_counts(F.col("terms"))).alias("t"))
        each = rows.where("not whole").select("doc_id", "field", F.explode("terms").alias("term"))
        summed = each.groupBy("doc_id", "field", "term").agg(F.count("*").cast("int").alias("tf"))
        return counted.select("doc_id", "field", "t.term", "t.tf").unionByName(summed)

    def stats_of(self, terms: Sequence[T.Term]) -> DataFrame:
        return self.term_stats.where(self._of(terms))

    def _of(self, terms: Sequence[T.Term]) -> Column:
        """The terms' rows; the buckets are literals once the optimizer has folded them."""
        by_field: dict[str, list[str]] = {}
        for t in terms:
            by_field.setdefault(t.field, []).append(t.term)
        cond = F.lit(False)
        for field, words in sorted(by_field.items()):
            words = sorted(set(words))
            held = F.col("bucket").isin([self.bucket(F.lit(w)) for w in words])
            cond |= (F.col("field") == field) & held & F.col("term").isin(words)
        return cond


def _counts(terms: Column) -> Column:
    """(term, tf) of an array of terms: it is sorted, and a term's run is as long as it is frequent."""

    def runs(ordered: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(at, lambda i: F.coalesce(F.get(ordered, i) != F.get(ordered, i - 1), F.lit(True)))

        def each(begins: Column) -> Column:
            return F.transform(
                begins, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(begins, k + 1), F.size(ordered)) - i).alias("tf"))
            )

        return F.element_at(F.transform(F.array(starts), each), 1)

    filled = F.element_at(F.transform(F.array(F.sort_array(terms)), runs), 1)
    return F.when(F.size(terms) > 0, filled)


def _lists(terms: Column) -> Column:
    """(term, positions) of an array of terms that may hold nulls: sorted with their places, and cut where the term changes."""

    def runs(ordered: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(at, lambda i: F.coalesce(F.get(ordered, i)["term"] != F.get(ordered, i - 1)["term"], F.lit(True)))

        def each(begins: Column) -> Column:
            def run(i: Column, k: Column) -> Column:
                own = F.slice(ordered, i + 1, F.coalesce(F.get(begins, k + 1), F.size(ordered)) - i)
                return F.struct(F.get(ordered, i)["term"].alias("term"), F.transform(own, lambda x: x["pos"]).alias("positions"))

            return F.transform(begins, run)

        return F.element_at(F.transform(F.array(starts), each), 1)

    placed = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("pos"))), lambda x: x["term"].isNotNull())
    filled = F.element_at(F.transform(F.array(F.sort_array(placed)), runs), 1)
    return F.when(F.exists(terms, lambda t: t.isNotNull()), filled)


def field_terms(texts: DataFrame, fields: Sequence[str], analyzer: Analyzer) -> DataFrame:
    """(doc_id, field, terms) of a table with one text column per field; null and empty texts have no row."""
    have = [f for f in fields if f in texts.columns]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in have)).cast("array<struct<field: string, text: string>>"))
    flat = texts.select("doc_id", each.alias("e")).where("e.text <> ''")
    return flat.select("doc_id", F.col("e.field").alias("field"), analyzer.kept(F.col("e.text")).alias("terms"))


def placed_pieces(pieces: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, field, start, terms) of (doc_id, field, part, place, text): pieces that make up a field together.

    A piece starts where those before it end, as if their texts were one, but no text is joined and no
    document's pieces meet in one task: tokens are counted per part, then inside a part. ``part`` is a
    number that grows with ``place``, so that a document has a bounded number of parts and a part few pieces.
    """
    keys = ["doc_id", "field"]
    counted = pieces.select(*keys, "part", "place", analyzer.kept(F.col("text")).alias("terms")).withColumn("all", F.size("terms"))
    counted = materialize(counted.where("all > 0"), "pieces")

    def running(window) -> Column:
        return F.coalesce(F.sum("all").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = counted.groupBy(*keys, "part").agg(F.sum("all").alias("all"))
    starts = parts.select(*keys, "part", running(Window.partitionBy(*keys).orderBy("part")).alias("begin"))
    inside = counted.withColumn("inside", running(Window.partitionBy(*keys, "part").orderBy("place")))
    whole = inside.join(starts, [*keys, "part"])
    return whole.select(*keys, (F.col("begin") + F.col("inside")).cast("int").alias("start"), "terms")


def build_forward(
    docs: DataFrame,
    path: str,
    fields: Sequence[str] = T.FIELDS,
    pieces: DataFrame | None = None,
    analyzer: Analyzer = analysis.DEFAULT,
    stored: DataFrame | None = None,
) -> Index:
    """Write what needs no shuffle of texts or tokens: the forward index, the documents with their lengths, the fields' statistics.

    ``docs`` is (doc_id, ext_id, raw_url, spam_score and a text column per field). ``stored`` gives raw_url
    and spam_score by doc_id where ``docs`` lacks them, and the url's text; only ids are joined with it, never
    texts. ``pieces`` adds fields that are made up of many small texts; see ``placed_pieces``. Rows without
    doc_id are left out; doc_id must be unique, and the documents of ``pieces`` must be among them.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    toks = field_terms(docs, fields, analyzer)
    if stored is not None:
        docs = materialize(docs.select("doc_id", "ext_id").join(stored.select("doc_id", "raw_url", "spam_score"), "doc_id", "left"), "documents")
        toks = toks.unionByName(field_terms(docs.withColumnRenamed("raw_url", "url"), [f for f in fields if f == "url"], analyzer))
    toks = toks.select("doc_id", "field", F.lit(0).alias("start"), F.lit(True).alias("whole"), "terms")
    if pieces is not None:
        toks = toks.unionByName(placed_pieces(pieces, analyzer).withColumn("whole", F.lit(False)))
    kept = F.size(F.array_compact("terms")).alias("n")
    toks.select("doc_id", "field", "start", kept, "whole", "terms").where("n > 0").write.partitionBy("field").parquet(f"{path}/forward")
    forward = spark.read.schema(_SCHEMAS["forward"]).parquet(f"{path}/forward")

    lens = forward.groupBy("doc_id", "field").agg(F.sum("n").alias("len"))
    maps = lens.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "len"))).alias("lens"))
    empty = F.expr("cast(map() as map<string, bigint>)")
    stored = [c if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("raw_url", "string"), ("spam_score", "int"))]
    whole = docs.select("doc_id", "ext_id", *stored).join(maps, "doc_id", "left")
    whole.withColumn("lens", F.coalesce("lens", empty)).write.parquet(f"{path}/docs")

    written = spark.read.schema(_SCHEMAS["docs"]).parquet(f"{path}/docs")
    each = written.select(F.explode("lens").alias("field", "len"))
    each.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("len").alias("sum_ttf")).coalesce(1).write.parquet(f"{path}/field_stats")
    sizes = spark.read.schema(_SCHEMAS["field_stats"]).parquet(f"{path}/field_stats")
    return Index(written, None, None, sizes, forward, analyzer=analyzer)


def invert(index: Index, path: str, task_tokens: int = TASK_TOKENS) -> Index:
    """Write the postings of a forward index beside it.

    The positions of a term are gathered inside the row of a field; only those of fields made up of pieces are
    grouped. The lists are shuffled once, by field, bucket and slice, for the layout of the files. There are as many buckets and slices as the tokens need; a term's rows lie in one
    slice of its bucket, those of a frequent term are spread over all of them by document.
    """
    forward = index.forward
    spark = forward.sparkSession
    total, rows = forward.agg(F.sum("n"), F.count("*")).first()
    tasks = max(1, math.ceil((total or 0) / task_tokens))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (tasks // 4).bit_length()))
    slices = math.ceil(tasks / buckets)
    by_term = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(slices))
    columns = ["field", "term", "doc_id", "positions"]
    listed = forward.where("whole").select("doc_id", "field", F.explode(_lists(F.col("terms"))).alias("x")).select("field", "x.term", "doc_id", "x.positions")
    each = forward.where("not whole").select("doc_id", "field", "start", F.posexplode("terms").alias("at", "term")).where("term is not null")
    grouped = each.groupBy("field", "term", "doc_id").agg(F.sort_array(F.collect_list(F.col("start") + F.col("at"))).alias("positions"))
    long = listed.unionByName(grouped.select(*columns))
    if slices > 1:
        share = min(1.0, PLAN_ROWS / rows)
        sample = forward.sample(share, seed=1).select("field", F.explode(F.array_compact("terms")).alias("term"))
        often = sample.groupBy("field", "term").agg((F.count("*") / F.lit(share)).alias("about"))
        # at most 4 * tasks terms can be as frequent as that
        often = materialize(often.where(F.col("about") >= task_tokens / 4).select("field", "term", F.lit(True).alias("often")), "frequent-terms")
        long = long.join(F.broadcast(often), ["field", "term"], "left")
        by_term = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(slices))).otherwise(by_term)
    placed = long.select(*columns, bucket(F.col("term"), buckets).alias("bucket"), by_term.cast("int").alias("slice"))
    least = spark.sparkContext.defaultParallelism
    spread = placed.repartition(max(2 * tasks, least), "field", "bucket", "slice")
    rows = spread.select("field", "bucket", "term", "doc_id", F.size("positions").alias("tf"), "positions")
    rows.sortWithinPartitions("field", "bucket", "term", "doc_id").write.partitionBy("field", "bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{path}/postings")

    stats = postings.groupBy("field", "bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    stats = stats.repartition(max(tasks, least), "field", "bucket")
    stats.sortWithinPartitions("field", "bucket", "term").write.partitionBy("field", "bucket").parquet(f"{path}/term_stats")
    write_text(spark, f"{path}/index.json", json.dumps({"buckets": buckets, "analyzer": index.analyzer.describe()}))
    return Index.open(spark, path)


def build(
    docs: DataFrame,
    path: str,
    fields: Sequence[str] = T.FIELDS,
    pieces: DataFrame | None = None,
    analyzer: Analyzer = analysis.DEFAULT,
    task_tokens: int = TASK_TOKENS,
) -> Index:
    """Write the whole index of ``docs``: texts are analysed once, into the forward index, which is then inverted."""
    return invert(build_forward(docs, path, fields, pieces, analyzer), path, task_tokens)


def url_key(url: Column) -> Column:
    """A URL without scheme and closing slash, lower-cased, to compare links with."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), "^https?://", ""), "/$", "")


#: A link in page text, [anchor](address).
LINK = r"\[([^\]\n]*)\]\(([^)\s]+)\)"


#: Parts of a long field; see ``placed_pieces``.
PARTS = 1024


def _links(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, anchor, address) of the links in the texts of (doc_id, text)."""
    found = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(LINK), F.lit(i)).alias(n) for i, n in ((1, "anchor"), (2, "address"))))
    each = docs.where(F.col("text").contains("](")).select("doc_id", F.posexplode(found).alias("pos", "link"))
    return each.select("doc_id", "pos", "link.anchor", "link.address")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, indexed_at, raw_url, spam_score, deleted_at): of repeated records the one indexed last."""
    rows = table(spark, folder, "doc_store").where("doc_id is not null")
    state = F.max(F.struct("indexed_at", "raw_url", "spam_score", "deleted_at")).alias("s")
    return rows.groupBy("doc_id").agg(state).select("doc_id", "s.*")


def collection(spark: SparkSession, folder: str, live: DataFrame | None = None) -> DataFrame:
    """(doc_id, ext_id, body, keywords, title) of the pages of a data folder, or of those in ``live`` (doc_id).

    body and title are the page's own; keywords are the anchors of the page's own links. The url is the
    address of a page's record, and inlink has the anchors of links that lead there; see ``inlinks``.
    """
    docs = table(spark, folder, "documents").where("doc_id is not null")
    if live is not None:
        docs = docs.join(live.select("doc_id"), "doc_id", "left_semi")
    anchors = F.array_join(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)), " ")
    own = F.when(F.col("text").contains("]("), anchors)
    return docs.select("doc_id", norm_id("ext_id").alias("ext_id"), F.col("text").alias("body"), own.alias("keywords"), "title")


def inlinks(spark: SparkSession, folder: str, pages: DataFrame) -> DataFrame:
    """(doc_id, field, part, place, text): of ``pages`` (doc_id, raw_url) the anchors of links on any page that lead to its address.

    A row per link, in the order of the linking pages; an address that very many pages link to is joined by
    broadcast and stays many rows.
    """
    links = _links(table(spark, folder, "documents").where("doc_id is not null"))
    low, high = table(spark, folder, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    width = ((high or 0) - (low or 0)) // PARTS + 1
    links = links.select(
        url_key(F.col("address")).alias("key"), F.floor((F.col("doc_id") - F.lit(low or 0)) / width).alias("part"),
        F.struct(F.col("doc_id").alias("from"), "pos").alias("place"), F.col("anchor").alias("text"),
    )
    links = materialize(links, "links")
    sizes = links.groupBy("key").agg(F.count("*").alias("links"))
    targets = pages.where("raw_url is not null").select("doc_id", url_key(F.col("raw_url")).alias("key")).join(sizes, "key")
    led = lookup_join(links, materialize(targets, "link-targets"), ["key"], "links")
    return led.select("doc_id", F.lit("inlink").alias("field"), "part", "place", "text")


_built: dict[tuple[str, str, bool], tuple[Index, str]] = {}


def index_of(spark: SparkSession, folder: str, live_only: bool = False, inverted: bool = True) -> Index:
    """The index of a data folder, built once per application into the shared folder; its postings only if asked for."""
    key = (spark.sparkContext.applicationId, folder, live_only)
    if key not in _built:
        held = materialize(records(spark, folder), "records")
        ids = table(spark, folder, "documents").select("doc_id").where("doc_id is not null")
        if live_only:  # a page without a record is live
            ids = ids.join(held.where("deleted_at is not null"), "doc_id", "left_anti")
        targets = ids.join(held, "doc_id").select("doc_id", "raw_url")
        path = new_path(spark, "index")
        pages = collection(spark, folder, ids if live_only else None)
        _built[key] = build_forward(pages, path, pieces=inlinks(spark, folder, targets), stored=held), path
    index, path = _built[key]
    if inverted and index.postings is None:
        _built[key] = index, path = invert(index, path), path
    return index


def scan(texts: DataFrame, terms: Sequence[T.Term], analyzer: Analyzer = analysis.DEFAULT) -> Index:
    """A small index of only the terms asked, straight from the texts and without a shuffle of tokens.

    ``texts`` is (doc_id, ext_id and a text column per field). Every text is analysed once; what is kept of
    it are its length and the positions of the terms.
    """
    by_field: Mapping[str, list[str]] = {f: sorted({t.term for t in terms if t.field == f}) for f in sorted({t.field for t in terms})}

    def hits(words: Column, field: str) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.cast("int").alias("pos")))
        known = F.filter(numbered, lambda h: h["term"].isin(by_field[field]))

        def of(word: str) -> Column:
            own = F.transform(F.filter(known, lambda h: h["term"] == word), lambda h: h["pos"])
            return F.struct(F.lit(field).alias("field"), F.lit(word).alias("term"), own.alias("positions"))

        return F.filter(F.array(*map(of, by_field[field])), lambda h: F.size(h["positions"]) > 0)

    words = texts.select("doc_id", "ext_id", *(analyzer.kept(F.col(f)).alias(f"w_{f}") for f in by_field))
    lens = F.create_map(*(x for f in by_field for x in (F.lit(f), F.size(F.array_compact(f"w_{f}")).cast("long"))))
    rows = words.select("doc_id", "ext_id", lens.alias("lens"), F.concat(*(hits(F.col(f"w_{f}"), f) for f in by_field)).alias("hits"))
    rows = materialize(rows, "scan")
    docs = rows.select("doc_id", "ext_id", F.map_filter("lens", lambda _, n: n > 0).alias("lens"))
    sizes = docs.select(F.explode("lens").alias("field", "len")).groupBy("field")
    flat = rows.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    postings = flat.select("field", F.lit(0).alias("bucket"), "term", "doc_id", F.size("positions").alias("tf"), "positions")
    stats = postings.groupBy("field", "bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    return Index(docs, postings, stats, sizes.agg(F.count("*").alias("doc_count"), F.sum("len").alias("sum_ttf")), buckets=1, analyzer=analyzer)
