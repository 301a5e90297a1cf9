"""Pseudo-relevance feedback: terms of the first documents, as a weighted query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlight.plans import tree as T
from siftlight.plans.models import Indri, Model, UnsupportedOperator
from siftlight.sources.index import Index

FIELD = "body"


def initial_ranking(
    run: DataFrame, docs: DataFrame, k: int, order_by: Sequence[Column | str] = ("line",), by: Sequence[str] = ("qid",)
) -> DataFrame:
    """(qid, doc_id, score) of the first ``k`` lines of every query in a run (qid, ext_id, score, line).

    ``docs`` is (doc_id, ext_id) of all documents. ``by`` are the columns that tell rankings apart, where there are more than one of a query.

    Lines count in file order, or in that of ``order_by``, before unknown ids are dropped. Only the first
    ``k`` lines of each task's share of a query are shuffled.
    """
    order = Window.partitionBy(*by).orderBy(*order_by)
    first = run.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return first.join(docs.select("doc_id", "ext_id"), "ext_id").select(*by, "doc_id", "score")


def term_scores(
    index: Index, feedback: DataFrame, mu: float, k: int, by: Sequence[str] = ("qid",), significant: int | None = None
) -> DataFrame:
    """(qid, term, score, rank): the ``k`` best expansion terms from (qid, doc_id, score).

    ``by`` are the columns that tell rankings apart, where there are more than one of a query. Scores are
    rounded to 12 digits before they are ranked, or to ``significant`` ones, for documents' scores of any size.

    A term's score is the sum over all feedback documents of its smoothed probability there, times the
    document's score, times ln(1 / p). The part of documents that lack the term is the same factor for
    all terms of a query, so no pair of term and document is made that isn't in the index. Terms with a
    dot or comma after the first sign are left out; ties go to the term that comes first.
    """
    length = F.coalesce(F.col("lens").getItem(FIELD), F.lit(0)).cast("double")
    docs = feedback.join(index.docs.select("doc_id", "lens"), "doc_id").select(
        *by, "doc_id", (F.col("score") / (length + mu)).alias("share")
    )
    base = docs.groupBy(*by).agg(F.sum("share").alias("base"))
    # the terms of the feedback documents come from the forward index
    seen = index.vectors(docs, FIELD).withColumn("bucket", index.bucket(F.col("term"))).join(docs, "doc_id")
    sums = seen.where(~F.col("term").rlike("^.+[.,]")).groupBy(*by, "bucket", "term").agg(F.sum(F.col("tf") * F.col("share")).alias("own"))
    stats = index.term_stats.where(F.col("field") == FIELD).select("bucket", "term", "ctf")
    p = F.col("ctf") / F.lit(float(index.stats(FIELD).sum_ttf or 1))
    score = F.log(1 / p) * (F.col("own") + F.lit(mu) * p * F.col("base"))
    rounded = F.round(score, 12) if significant is None else F.format_string(f"%.{significant - 1}e", score).cast("double")
    rows = sums.join(stats, ["bucket", "term"]).join(base, list(by)).select(*by, "term", rounded.alias("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def learned_text(terms: DataFrame, by: Sequence[str] = ("qid",), form: str = "%.12f") -> DataFrame:
    """(by, learned): the expansion as query text, terms by rank, weights in the given form."""
    pair = F.concat_ws(" ", F.format_string(form, "score"), "term")
    got = F.sort_array(F.collect_list(F.struct("rank", pair.alias("p"))))
    body = F.array_join(F.transform(got, lambda e: e["p"]), " ")
    return terms.groupBy(*by).agg(F.concat(F.lit("#WAND( "), body, F.lit(" )")).alias("learned"))


def expanded(original: T.Node, terms: list[tuple[str, float]], weight: float, model: Model) -> T.Node:
    """The original with ``weight`` beside its expansion terms; only for smoothed language models."""
    if not isinstance(model, Indri):
        raise UnsupportedOperator("WAND", model)
    if not terms:
        return original
    learned = T.WAnd(tuple(T.Term(t, FIELD) for t, _ in terms), tuple(s for _, s in terms))
    return T.WAnd((original, learned), (weight, 1 - weight))
