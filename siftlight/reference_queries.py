"""Queries of the reference check over a folder of tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlight.operators import references as R
from siftlight.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs = R.references(
        {
            "qrels": (table(spark, folder, "qrels"), "judged_at"),
            "pagerank": (table(spark, folder, "pagerank"), "computed_at"),
        }
    )
    return R.orphans(refs, table(spark, folder, "doc_store"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_month(_orphans(spark, folder)).select("tab", "ref_month", "ext_id", "why").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_ORPHANS = """
with refs as (
  select 'qrels' as tab, lower(trim(ext_id)) as ext_id, judged_at as t from qrels
  union all select 'pagerank', lower(trim(ext_id)), computed_at from pagerank),
rec as (select lower(trim(ext_id)) as ext_id, indexed_at, deleted_at from doc_store where trim(ext_id) <> ''),
first as (select ext_id, min(indexed_at) as since from rec group by ext_id),
orphan as (
  select r.tab, r.ext_id, r.t, strftime(r.t, '%Y-%m') as ref_month,
         case when f.ext_id is null then 'missing' when f.since <= r.t then 'deleted' else 'late' end as why
  from refs r left join first f using (ext_id)
  where r.ext_id <> '' and r.t is not null and not exists (
    select 1 from rec d where d.ext_id = r.ext_id and d.indexed_at <= r.t
      and (d.deleted_at is null or d.deleted_at > r.t)))
"""
SQL = {
    "p5_found": _ORPHANS + "select distinct tab, ref_month, ext_id, why from orphan",
    "p5_report": _ORPHANS
    + """select tab, ref_month, why, count(*) as refs, count(distinct ext_id) as ids
from orphan group by tab, ref_month, why""",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
