"""Feedback over a table of rankings without an index."""

import os

import pytest

from siftlight import retrieval_queries
from siftlight.operators import feedback, feedback_blocks
from siftlight.scratch import materialize, new_path
from siftlight.sources import index as sources

from .conftest import DATA

BY = ("run_id", "qid")
#: One with a term more than 255 times, one of more terms than a part may have, some without any, terms with equal scores.
TEXTS = ["cat " * 700 + "dog", "dog fish " + " ".join(f"w{i:02}" for i in range(40)), None, "the of", "fish's bird bird", "cow", "x y z cat", "狗 dog ไทย"]
RUNS = [
    ("a", 1, 0, 3.0), ("a", 1, 1, 2.0), ("a", 1, 1, 1.5), ("a", 2, 2, 1.0), ("a", 3, 3, 1.0), ("a", 3, 5, 0.5), ("b", 1, 4, -9.0), ("b", 1, 6, -3.0),
    ("b", 2, 1, 1e-20), ("b", 2, 7, 3e-20), ("b", 3, 7, 0.0), ("b", 3, 0, 0.0), (None, 1, 0, 1.0), ("b", None, 0, 1.0),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3, "doc_id")
    return docs, materialize(spark.createDataFrame(RUNS, "run_id string, qid int, doc_id long, score double"), "test-lines")


@pytest.mark.parametrize(("most", "chunk", "k"), [(1 << 16, 1_000_000, 20), (3, 5, 20), (10, 1, 3)])
def test_same_as_over_an_index(spark, tables, most, chunk, k):
    docs, lines = tables
    pages = docs.selectExpr("doc_id", "string(doc_id) as ext_id", "text as body")
    terms = feedback.term_scores(sources.build(pages, new_path(spark, "test-index"), ("body",)), lines, 10.0, k, BY, 9)
    terms = materialize(terms, "test-terms")
    want = terms.join(feedback.learned_text(terms, BY, "%.8e"), list(BY)).select(*BY, "term", "rank", "score", "learned")
    got = feedback_blocks.term_scores(docs, lines, 10.0, k, BY, 9, most, chunk)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_lines_and_no_documents(spark, tables):
    docs, lines = tables
    assert feedback_blocks.term_scores(docs, lines.limit(0), 10.0, 20, BY).count() == 0
    assert feedback_blocks.term_scores(docs.limit(0), lines.limit(0), 10.0, 20, BY).count() == 0


def test_disk_of_all_queries(spark, tmp_path, monkeypatch):
    """What is written stays small beside the input: an index of all terms would take several times as much."""
    folder = tmp_path / "data"
    folder.symlink_to(DATA)
    shared = tmp_path / "shared"
    monkeypatch.setattr("siftlight.scratch.scratch_dir", lambda spark: f"file://{shared}")
    monkeypatch.setattr("siftlight.scratch._own_folders", set())
    assert retrieval_queries.prf_all_queries(spark, str(folder)).count()
    written = sum(p.stat().st_size for p in shared.rglob("*.parquet") if p.is_file())
    assert written < 4 * sum(os.path.getsize(f"{DATA}/{name}.parquet") for name in ("documents", "runs"))
    assert not [key for key in sources._built if key[1] == str(folder)]
