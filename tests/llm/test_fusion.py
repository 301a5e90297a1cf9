import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftlight.llm import fusion

COLS = "qid int, ext_id string, " + ", ".join(f"{c} double" for c in fusion.FEATURES)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS).withColumns({"size": F.lit(3), "m_f1": F.lit("x"), "fused": F.lit(1)})


def pad(*values):
    return (*values, *(None,) * (8 - len(values)))


def first(spark, rows):
    return {r.qid: r.ext_id for r in fusion.first_items(frame(spark, rows)).collect()}


def test_range_gives_no_say(spark):
    """One item leads in a score of huge range, another in all the others."""
    rows = [(1, f"d{i}", *pad(i / 10, i * 2.0, i / 5, float(10**6 if i == 0 else i))) for i in range(10)]
    assert first(spark, rows) == {1: "d9"}


def test_affine_scales_dont_matter(spark):
    rnd = random.Random(5)
    rows = [(q, f"d{i}", *(rnd.gauss(0, 1) for _ in range(8))) for q in range(6) for i in range(9)]
    scaled = [(r[0], r[1], *(x * 10.0 ** (k - 3) + k for k, x in enumerate(r[2:]))) for r in rows]
    assert first(spark, rows) == first(spark, scaled)


def test_missing_and_constant_count_neither_way(spark):
    nan = float("nan")
    rows = [(1, "a", *pad(5.0, 1.0, None)), (1, "b", *pad(4.0, 1.0, 9.0)), (1, "c", *pad(1.0, 1.0, nan)), (1, "d", *pad(2.0, 1.0, 1.0))]
    assert first(spark, rows)[1] in {"a", "b"}
    only = [(1, "a", *pad(5.0)), (1, "b", *pad(4.0, 7.0)), (1, "c", *pad(1.0, 7.0))]
    assert first(spark, only) == {1: "a"}


def test_cases(spark):
    inf = float("inf")
    rows = [
        (1, "X ", *pad(1.0)), (1, "x", *pad(1.0)), (1, "y", *pad(1.0)),  # all equal: the first id
        (2, "b", *pad()), (2, "a", *pad()),
        (3, None, *pad(1.0)), (None, "a", *pad(1.0)),
        (4, "solo", *pad(2.0)),
        (5, "p", *pad(inf, 1.0)), (5, "q", *pad(1.0, 2.0)), (5, "r", *pad(0.0, 0.0)),
    ]
    got = first(spark, rows)
    assert got[1] == "x" and got[2] == "a" and got[4] == "solo" and got[5] == "q" and set(got) == {1, 2, 4, 5}


def test_values(spark):
    rows = [(1, f"d{i}", *pad(float(x))) for i, x in enumerate((1, 2, 4, 8, 100))]
    got = {r.ext_id: r.fused for r in fusion.fused(frame(spark, rows), "qid", "ext_id", {"f1": 2.0}).collect()}
    mad = statistics.median(abs(x - 4) for x in (1, 2, 4, 8, 100))
    for i, x in enumerate((1, 2, 4, 8, 100)):
        z = (x - 4) * fusion.MAD_OF_NORMAL / mad
        assert got[f"d{i}"] == pytest.approx(1 / (1 + 2.718281828459045**-z))


def test_mostly_equal_values(spark):
    rows = [(1, f"d{i}", *pad(0.0 if i < 8 else float(i))) for i in range(10)]
    assert first(spark, rows) == {1: "d9"}


def test_empty(spark):
    assert first(spark, []) == {}
