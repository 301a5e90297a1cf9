"""Text files of a retrieval experiment: parameters, queries, judgements, PageRank, runs, features, models.

Readers give DataFrames; lines that lack the needed columns are left out. Writers take a save mode and
overwrite by default, so a repeated run doesn't append to an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions.ids import norm_id


def parameters(lines: Iterable[str]) -> dict[str, str]:
    """``key=value`` lines; others, and those with more than one ``=``, don't count."""
    pairs = (line.strip().split("=") for line in lines)
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2 and p[0].strip()}


def read_parameters(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        return parameters(f)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def _numbered(df: DataFrame) -> DataFrame:
    """With ``line``, increasing in the order of the lines: by file, part of the file, and row.

    Rows alone wouldn't do, as longer files and parts are read first.
    """
    return df.withColumn("line", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("part"), F.monotonically_increasing_id().alias("row")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, ord) of ``qid:query`` lines; only the first colon divides."""
    rows = _numbered(_lines(spark, path))
    got = rows.select(F.regexp_extract("value", r"^\s*(\d+)\s*:(.*)$", 1).alias("q"), F.regexp_extract("value", r"^\s*\d+\s*:(.*)$", 1).alias("query"), "line")
    return got.where("q <> ''").select(F.col("q").cast("int").alias("qid"), F.trim("query").alias("query"), F.col("line").alias("ord"))


def _columns(df: DataFrame) -> Column:
    return F.split(F.trim("value"), r"\s+")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, iter, ext_id, rel)."""
    c = _columns(df := _lines(spark, path))
    rows = df.select(c.alias("c")).where(F.size("c") >= 4)
    return rows.select(
        F.col("c")[0].try_cast("int").alias("qid"), F.col("c")[1].alias("iter"),
        F.col("c")[2].alias("ext_id"), F.col("c")[3].try_cast("int").alias("rel"),
    ).where("qid is not null")


def read_pagerank(spark: SparkSession, path: str) -> DataFrame:
    """(ext_id, pagerank)."""
    c = _columns(df := _lines(spark, path))
    rows = df.select(c.alias("c")).where(F.size("c") >= 2)
    return rows.select(F.col("c")[0].alias("ext_id"), F.col("c")[1].try_cast("double").alias("pagerank"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ext_id, score, line) of a run file, with the order of its lines."""
    df = _numbered(_lines(spark, path))
    rows = df.select(_columns(df).alias("c"), "line").where(F.size("c") >= 5)
    return rows.select(
        F.col("c")[0].try_cast("int").alias("qid"), norm_id(F.col("c")[2]).alias("ext_id"),
        F.col("c")[4].try_cast("double").alias("score"), "line",
    ).where("qid is not null")


#: A support vector of a model file: its weight, then numbered values; and the line that names the kernel.
_VECTOR = r"^\s*[-+0-9.eE]+(?:\s+qid:\S+)?(?:\s+\d+:[-+0-9.eE]+)+\s*$"
_KERNEL = r"^\s*(\S+)\s*#\s*kernel(?:\s+type)?\s*$"


def read_svm_model(spark: SparkSession, path: str) -> DataFrame:
    """(alpha, values) of a model file, a row per support vector; another than the linear kernel raises ValueError.

    Lines of the header are told from support vectors by their form, so the file is read by the executors
    however many vectors it has.
    """
    lines = _lines(spark, path)
    kernel = lines.select(F.regexp_extract("value", _KERNEL, 1).alias("k")).where("k <> ''").limit(1).collect()
    if kernel and kernel[0]["k"] != "0":
        raise ValueError("only the linear kernel has weights")
    body = F.regexp_replace("value", "#.*$", "")
    words = F.split(F.trim(body), r"\s+")
    pairs = F.filter(F.slice(words, 2, F.size(words)), lambda w: ~w.startswith("qid:"))
    each = F.transform(pairs, lambda w: F.struct(F.split(w, ":")[0].cast("int").alias("k"), F.split(w, ":")[1].cast("double").alias("v")))
    return lines.where(body.rlike(_VECTOR)).select(words[0].cast("double").alias("alpha"), F.map_from_entries(each).alias("values"))


def run_lines(run: DataFrame) -> DataFrame:
    """(value): tab-separated lines of (qid, q0, ext_id, rank, score, run_id), by query and rank."""
    cols = [F.col(c).cast("string") for c in ("qid", "q0", "ext_id", "rank", "score", "run_id")]
    return run.orderBy("qid", "rank").select(F.concat_ws("\t", *cols).alias("value"))


def write_run(run: DataFrame, path: str, mode: str = "overwrite") -> None:
    run_lines(run).write.mode(mode).text(path)


def write_expansions(learned: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``qid: query`` lines of (qid, learned)."""
    line = F.concat(F.col("qid").cast("string"), F.lit(": "), F.col("learned"))
    learned.orderBy("qid").select(line.alias("value")).write.mode(mode).text(path)


def write_svm_model(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(alpha, values) as a model file of the linear kernel, with the lines of the header that are read."""
    order = F.sort_array(F.map_entries("values"))
    text = F.array_join(F.transform(order, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")
    lines = vectors.select(F.concat_ws(" ", F.col("alpha").cast("string"), text, F.lit("#")).alias("value"))
    head = vectors.sparkSession.createDataFrame([("SVM-light",), ("0 # kernel type",)], "value string").coalesce(1)
    head.unionByName(lines).write.mode(mode).text(path)


def write_lines(rows: DataFrame, path: str, columns: Iterable[str], mark: str = " ", mode: str = "overwrite") -> None:
    """The columns of rows that have all of them, divided by ``mark``: queries, judgements, PageRank values."""
    columns = list(columns)
    line = F.concat_ws(mark, *(F.col(c).cast("string") for c in columns))
    rows.dropna(subset=columns).select(line.alias("value")).write.mode(mode).text(path)


def write_features(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The lines of ``letor.svmlight``."""
    lines.write.mode(mode).text(path)
