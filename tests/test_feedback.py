"""Feedback over a table of rankings."""

import math

import pytest

from siftlight.operators import feedback
from siftlight.scratch import new_path
from siftlight.sources.index import build

TEXTS = ["cat cat dog", "dog fish", "fish bird bird", "cow"]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, ext_id string, body string")
    return build(docs, new_path(spark, "test-feedback"), ("body",))


RUNS = [("a", 1, "d0", 3.0, 1), ("a", 1, "d1", 2.0, 2), ("a", 1, "d2", 1.0, 3), ("b", 1, "d2", 9.0, 1), ("b", 1, "d9", 8.0, 2), ("b", 2, "d3", 1.0, 1)]


def rankings(spark, index):
    rows = spark.createDataFrame(RUNS, "run_id string, qid int, ext_id string, score double, line int")
    return feedback.initial_ranking(rows, index.docs, 2, by=("run_id", "qid"))


def test_first_lines_of_every_run(spark, index):
    got = sorted(tuple(r) for r in rankings(spark, index).collect())
    assert got == [("a", 1, 0, 3.0), ("a", 1, 1, 2.0), ("b", 1, 2, 9.0), ("b", 2, 3, 1.0)]


def test_terms_of_every_run(spark, index):
    mu, words = 10.0, [t.split() for t in TEXTS]
    total = sum(map(len, words))
    want = {}
    for key, docs in {("a", 1): {0: 3.0, 1: 2.0}, ("b", 1): {2: 9.0}, ("b", 2): {3: 1.0}}.items():
        for term in {w for d in docs for w in words[d]}:
            p = sum(t.count(term) for t in words) / total
            want[*key, term] = sum((words[d].count(term) + mu * p) / (len(words[d]) + mu) * s * math.log(1 / p) for d, s in docs.items())
    got = feedback.term_scores(index, rankings(spark, index), mu, 20, ("run_id", "qid")).collect()
    assert {(r.run_id, r.qid, r.term): r.score for r in got} == pytest.approx(want)
    assert [r.term for r in sorted(got, key=lambda r: r["rank"]) if (r.run_id, r.qid) == ("a", 1)] == sorted(
        (t for r, q, t in want if (r, q) == ("a", 1)), key=lambda t: -want["a", 1, t]
    )


def test_terms_under_tiny_scores(spark, index):
    rows = rankings(spark, index)
    tiny = rows.withColumn("score", rows.score * 1e-20)
    ranks = [{(r.run_id, r.qid, r.term): r["rank"] for r in feedback.term_scores(index, x, 10.0, 20, ("run_id", "qid"), 9).collect()} for x in (rows, tiny)]
    assert ranks[0] == ranks[1]
