"""A document's term vector: its distinct stems in order, with their counts, and the stem at each position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlight.sources.index import Index


def stems(index: Index, asked: DataFrame | None = None, field: str | None = None) -> DataFrame:
    """(doc_id, field, i, stem, freq, df, ctf): stem ``i`` of a vector, from 1 (0 is the stopwords' slot), in the order of its signs.

    ``df`` and ``ctf`` are the stem's documents and occurrences in the collection. Documents and fields without
    tokens have no vector.
    """
    held = index.vectors(asked, field).withColumnRenamed("term", "stem")
    order = Window.partitionBy("doc_id", "field").orderBy("stem")  # the vocabulary of one document
    numbered = held.withColumn("i", F.row_number().over(order))
    stats = index.term_stats.select("field", F.col("term").alias("stem"), "df", "ctf")
    return numbered.join(stats, ["field", "stem"]).select("doc_id", "field", "i", "stem", F.col("tf").alias("freq"), "df", "ctf")


def positions(index: Index, asked: DataFrame | None = None, field: str | None = None) -> DataFrame:
    """(doc_id, field, pos, stem) of every position that holds a stem; stopwords leave gaps."""
    rows = index.pieces(asked, field).select("doc_id", "field", "start", F.posexplode("terms").alias("at", "stem"))
    return rows.where("stem is not null").select("doc_id", "field", (F.col("start") + F.col("at")).alias("pos"), "stem")
