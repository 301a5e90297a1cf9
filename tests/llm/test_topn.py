import random

import pytest
from pyspark.sql import functions as F

from siftlight.llm import topn

SCHEMA = "run_id string, qid int, ext_id string, score double"


def runs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"level": F.lit(9), "lo": F.lit("x"), "size": F.lit(1)})


def brute(rows, n):
    best = {}
    for run, qid, e, s in rows:
        if run is None or qid is None or e is None or s is None or s != s:
            continue
        e = e.strip().lower()
        if e and e != "dummy":
            best[run, qid, e] = max(s, best.get((run, qid, e), s))
    groups = {}
    for (run, qid, e), s in best.items():
        groups.setdefault((run, qid), []).append((-s, e.encode(), e))
    return {(*g, e) for g, items in groups.items() for _, _, e in sorted(items)[:n]}


def found(spark, rows, n=10):
    got = [tuple(r) for r in topn.top_ranked(runs(spark, rows), n).select("run_id", "qid", "ext_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ties_skew_and_repeats(spark):
    rnd = random.Random(4)
    rows = []
    for q in range(12):
        for _ in range(rnd.choice([0, 3, 10, 60, 900 if q == 1 else 50])):
            score = rnd.choice([rnd.randint(0, 3), rnd.random(), -rnd.random() * 1e-9])
            rows.append((rnd.choice("ab"), q, f"doc{'x' * rnd.randint(0, 9)}{rnd.randint(0, 400)}", float(score)))
    rows += rnd.sample(rows, 100)
    assert found(spark, rows) == brute(rows, 10)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, x, s) for x, s in (("A ", 1.0), ("a", 3.0), ("dummy", 9.0), (None, 9.0), (" ", 9.0), ("b", None), ("c", nan), ("d", -0.0), ("e", 0.0), ("f", inf), ("g", -inf), ("h", 1.7e308))]
    rows += [(None, 1, "x", 1.0), ("a", None, "x", 1.0), ("b", 1, "dummy", 0.0)]
    assert found(spark, rows, 4) == brute(rows, 4)
    assert found(spark, rows, 100) == brute(rows, 100)


def test_ties_broken_deep_in_the_identifier(spark):
    """Equal scores and ids that differ only after many signs, in several scripts."""
    rows = [("a", 1, "same-long-prefix-" * 3 + s, 1.0) for s in ("", "b", "ba", "é", "漢", "z", "漢字", "0")]
    for n in range(1, 8):
        assert found(spark, rows, n) == brute(rows, n)


def test_identifiers_that_differ_in_zero_bytes(spark):
    """Prefixes, closing zero bytes and lengths around the parts of the code: the search always ends."""
    ids = ["a", "a\0", "a\0\0", "a\0b", "abcdef", "abcdef\0", "abcdefg", "abcdef\0\0\0\0\0\0", "abcdefghijkl", "abcdefghijkl\0", "\0"]
    rows = [("a", 1, x, 1.0) for x in ids]
    for n in (1, 2, 4, 7, 9):
        assert found(spark, rows, n) == brute(rows, n)


def test_every_score_has_its_place(spark):
    """Infinite scores and the largest doubles are told apart; equal ones go by identifier."""
    inf, big = float("inf"), 1.7976931348623157e308
    scores = [inf, inf, big, 1.75e308, 1.7e308, 1e308, 5e-324, 0.0, -0.0, -5e-324, -1.75e308, -big, -inf, -inf]
    rows = [("a", 1, f"d{i % 5}{i}", s) for i, s in enumerate(scores)] + [("b", 1, f"e{i}", inf) for i in range(6)] + [("c", 1, f"e{i}", -inf) for i in range(6)]
    for n in (1, 3, 7, 8, 10, 12):
        assert found(spark, rows, n) == brute(rows, n)


def test_repeats_are_an_error(spark):
    items = spark.createDataFrame([("a", 1, "x", 1.0)] * 3, SCHEMA)
    with pytest.raises(ValueError, match="repeated"):
        topn.top_n(items, ["run_id", "qid"], "score", "ext_id", 2)


@pytest.mark.parametrize("n", [1, 3])
def test_empty(spark, n):
    assert found(spark, [], n) == set()
