import math

import pytest
from pyspark.sql import functions as F

from siftlight.llm import mixing, tokens


def frames(spark, sizes, targets):
    s = spark.createDataFrame(sizes, "doc_id long, source string, tokens long").withColumns({"u": F.lit(1), "cdf": F.lit("x"), "k": F.lit(0), "copy": F.lit(1)})
    return s, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


SIZES = [(i, " Web " if i % 3 else "news", 50 + i % 7) for i in range(3000)] + [(5000 + i, "MAIL", 40) for i in range(60)]
SIZES += [(9001, None, 10), (9002, "web", None), (9003, "web", 0), (9004, "other", 99)]
TARGETS = [("web", 0.5, 1), ("News ", 0.3, 2), ("mail", 0.15, 4), ("books", 0.05, 3), (None, 0.1, 1), ("x", None, 1), ("y", 0.1, 0)]


def test_shares_and_caps(spark):
    mixed, draws = mixing.mixture(*frames(spark, SIZES, TARGETS))
    rows = mixed.collect()
    caps = {"web": 1, "news": 2, "mail": 4}
    seen = {}
    for r in rows:
        assert 1 <= r.copy <= r.repeats <= caps[r.source]
        seen.setdefault(r.doc_id, set()).add(r.copy)
    assert all(max(v) == len(v) for v in seen.values())
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    got = {r.source: r for r in mixing.shares(mixed, draws).collect()}
    assert set(got) == {"web", "news", "mail", "books"} and got["books"].share == 0
    for s, share in (("web", 0.5), ("news", 0.3), ("mail", 0.15)):
        assert got[s].share == pytest.approx(share / 0.95, rel=0.03)
    assert sum(r.share for r in got.values()) == pytest.approx(1)


def test_repeatable_and_neighbours_apart(spark):
    a = [tuple(r) for r in mixing.mixture(*frames(spark, SIZES, TARGETS))[0].collect()]
    b = [tuple(r) for r in mixing.mixture(*frames(spark, SIZES[::-1], TARGETS))[0].collect()]
    assert a == b


def test_small_source_falls_short(spark):
    """A source with next to no text gives all it may; the others keep their proportions."""
    sizes = [(i, "a" if i % 2 else "b", 100) for i in range(2000)] + [(9999, "tiny", 10)]
    mixed, draws = mixing.mixture(*frames(spark, sizes, [("a", 0.4, 1), ("b", 0.4, 1), ("tiny", 0.2, 3)]))
    got = {r.source: r for r in mixing.shares(mixed, draws).collect()}
    assert got["tiny"].drawn == 30
    assert got["a"].share == pytest.approx(got["b"].share, rel=0.03)


def test_poisson():
    assert mixing.capped_mean(0.7, 50) == pytest.approx(0.7)
    for rate, cap in ((0.2, 1), (0.99, 1), (1.5, 2), (3.9, 4)):
        assert mixing.capped_mean(mixing.mean_for(rate, cap), cap) == pytest.approx(rate, abs=1e-6)
    assert list(mixing.poisson_cdf(float("inf"), 2)) == [0.0, 0.0]
    assert mixing.capped_mean(3000.0, 100_000) == pytest.approx(3000)  # exp(-3000) is 0 in a double
    assert mixing.mean_for(900.0, 1000) == pytest.approx(900, rel=1e-3)


@pytest.mark.parametrize(("mean", "cap"), [(0.0, 3), (0.3, 1), (0.7, 50), (2.5, 4), (2.5, 1_000_000), (1500.0, 1_000_000), (math.inf, 3)])
def test_copies_are_those_of_the_law(spark, mean, cap):
    """The expression gives what counting in the law's table gives, without a table."""
    u = [0.0, 1e-9, 0.1, 0.35, 0.5, 0.73, 0.9, 0.999] + ([1 - 2**-52] if mean < 1000 else [])
    law = mixing.poisson_cdf(mean, cap)
    df = spark.createDataFrame([(x, float(mean), cap) for x in u], "u double, mean double, cap int")
    got = [r.n for r in df.select(mixing._copies(F.col("mean"), F.col("cap")).alias("n")).collect()]
    want = [0 if mean == 0 else int((x >= law).sum()) for x in u]
    assert got == pytest.approx(want, abs=1 if mean > 1000 else 0)  # sums of a thousand terms round differently


def test_who_decides_the_size(spark):
    """The report names a source too small to limit the mixture; with least 0 it limits it."""
    sizes = [(i, "a", 100) for i in range(2000)] + [(9999, "tiny", 10)]
    targets = [("a", 0.8, 1), ("tiny", 0.2, 3)]
    for least, decides in ((0.1, False), (0.0, True)):
        mixed, draws = mixing.mixture(*frames(spark, sizes, targets), least=least)
        got = {r.source: r for r in mixing.shares(mixed, draws).collect()}
        assert got["tiny"].decides is decides and got["a"].decides
        assert (got["a"].drawn > 100_000) is not decides


def test_unfitted_means_are_the_rates(spark):
    """Without the fit the mean is the repetition rate itself where no page is cut."""
    _, draws = mixing.mixture(*frames(spark, SIZES, [("web", 0.5, 1000), ("news", 0.5, 1000)]), total=100_000.0, fitted=False)
    for d in draws:
        assert d.mean == pytest.approx(d.wanted / d.available, rel=1e-6)


@pytest.mark.parametrize(("sizes", "targets"), [([], TARGETS), (SIZES, []), ([], [])])
def test_empty(spark, sizes, targets):
    mixed, draws = mixing.mixture(*frames(spark, sizes, targets))
    assert mixed.count() == 0
    assert mixing.shares(mixed, draws).count() == len(draws)


def test_token_counts(spark):
    long = "word and more, " * 20_000
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (4, long, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df).collect()}
    whole = tokens.encoding(tokens.RANKS).encode_ordinary
    assert got == {1: len(whole("hello world")), 2: 0, 3: 0, 4: len(whole(long))}
