"""Queries of the training-data operators over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlight.llm import fusion, mixing, packing, sentences, stuffing, terms, tokens, topn
from siftlight.scratch import materialize
from siftlight.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    states = terms.newest(terms.vectors(table(spark, folder, "term_vectors"), "body"))
    return terms.most_distinctive(terms.parsimonious(states, table(spark, folder, "probe_docs")))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    states = terms.newest(terms.vectors(table(spark, folder, "term_vectors"), "body"))
    return terms.parsimonious(states)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = terms.incremental_counts(table(spark, folder, "term_vectors"), "body")
    return counts.marked().where("mark is not null").select("stem", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    scores = table(spark, folder, "doc_store").select("doc_id", "spam_score")
    return stuffing.stuffed_pages(docs, scores).select("doc_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_ranked(table(spark, folder, "runs")).select("run_id", "qid", "ext_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.first_items(table(spark, folder, "features"))


def _sizes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("doc_id is not null")
    return materialize(tokens.with_tokens(docs.select("doc_id", *columns, "text")), "sizes")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.filled(_sizes(spark, folder), table(spark, folder, "pack_capacity"))


def _mixture(spark: SparkSession, folder: str):
    return mixing.mixture(_sizes(spark, folder, "source"), table(spark, folder, "mix_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.units(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_scores": p1_scores,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p6_found": p6_found,
        "p7_containers": p7_containers,
        "p8_mixture": p8_mixture,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
    }


def _fusion_sql() -> str:
    """Lower medians by rank, then the mean log of the logistic values, one row per query, item and score."""
    clean = ", ".join(f"avg(case when not isnan({f}) and abs({f}) < 1e300 then {f} end) as {f}" for f in fusion.FEATURES)
    return f"""
with item as (
  select qid, lower(trim(ext_id)) as ext_id, {clean} from features
  where qid is not null and trim(ext_id) <> '' group by 1, 2),
long as (unpivot item on {", ".join(fusion.FEATURES)} into name f value x),
mid as (select qid, f, quantile_disc(x, 0.5) as m, min(x) < max(x) as varies from long group by 1, 2),
dev as (select qid, f, quantile_disc(abs(x - m), 0.5) as d, avg(abs(x - m)) as a from long join mid using (qid, f) group by 1, 2),
z as (
  select qid, ext_id, (x - m) / (case when d > 0 then d / {fusion.MAD_OF_NORMAL} else a * 1.2533 end) as z
  from long join mid using (qid, f) join dev using (qid, f) where varies),
score as (select qid, ext_id, exp(avg(case when z >= 0 then -ln(1 + exp(-z)) else z - ln(1 + exp(z)) end)) as s from z group by 1, 2)
select qid, ext_id from item left join score using (qid, ext_id)
qualify row_number() over (partition by qid order by round(coalesce(s, 0.5), 12) desc, ext_id) = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _fusion_sql(),
        "p2_found": """
with newest as (
  select doc_id, stems, stems_freq,
         row_number() over (partition by doc_id order by indexed_at desc nulls last) as k
  from term_vectors where lower(trim(field)) = 'body' and doc_id is not null),
flat as (select doc_id, unnest(stems) as s, unnest(stems_freq) as f from newest where k = 1),
page as (select doc_id, lower(trim(s)) as stem, sum(f) as tf from flat
         where trim(s) <> '' and f > 0 group by all),
total as (select stem, sum(tf) as occurrences, count(*) as pages from page group by stem),
n as (select count(*) as pages from newest where k = 1)
select stem, case when t.pages < 3 or occurrences < 5 then 'rare' else 'common' end as mark
from total t, n where t.pages < 3 or occurrences < 5 or t.pages > 0.1 * n.pages""",
        "p4_found": """
with item as (
  select run_id, qid, lower(trim(ext_id)) as ext_id, max(score) as score from runs
  where run_id is not null and qid is not null and score is not null and not isnan(score)
    and trim(ext_id) <> '' and lower(trim(ext_id)) <> 'dummy' group by all),
ranked as (select *, row_number() over (partition by run_id, qid order by score desc, ext_id) as k from item)
select run_id, qid, ext_id from ranked where k <= 10""",
    }
