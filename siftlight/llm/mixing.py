"""Sources mixed to target shares by replicating their pages."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.scratch import materialize

SEED = 20_240_601
#: Targets that may be given, and repeats of a page.
MAX_SOURCES, MAX_REPEATS = 10_000, 1_000_000
#: A source that would hold the whole mixture below this part of all tokens counts as too small.
LEAST = 0.1
#: Means tried at once, and passes, when a source's mean is fitted to what its pages really give.
GRID, ROUNDS = 9, 3


@dataclass(frozen=True)
class Draw:
    """How a source is drawn: tokens wanted, the mean of the Poisson law, copies of a page at most.

    ``decides`` is false for a source that is too small to have a say in the size of the mixture.
    """

    source: str
    target_share: float
    max_repeats: int
    available: int
    wanted: float
    mean: float
    decides: bool = True


def _steps(mean: float) -> int:
    """A count that a Poisson number exceeds with less than 2 ** -53."""
    return int(mean + 9 * math.sqrt(mean) + 18)


def poisson_cdf(mean: float, cap: int) -> np.ndarray:
    """P(count <= k) for k below ``cap``: a uniform number has as many copies as values it reaches.

    It ends where nothing is left above; from there on all values are 1.
    """
    if math.isinf(mean):
        return np.zeros(cap)
    n = min(cap, _steps(mean))
    logs = np.log(mean) * np.arange(n) - np.append(0.0, np.cumsum(np.log(np.arange(1, n)))) if mean > 0 else np.append(0.0, np.full(max(n - 1, 0), -np.inf))
    return np.cumsum(np.exp(logs - mean))[:n]


def capped_mean(mean: float, cap: int) -> float:
    """Expected copies when a Poisson count is cut at ``cap``."""
    return float((1 - poisson_cdf(mean, cap)).sum())


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose count, cut at ``cap``, has the expectation ``rate``."""
    if rate >= cap:
        return math.inf
    lo, hi = rate, max(1.0, 2 * rate)
    while capped_mean(hi, cap) < rate and hi < 100 * (cap + 10):
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < rate else (lo, mid)
    return hi


def plan(
    targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None, least: float = LEAST
) -> list[Draw]:
    """The draw of each source.

    Without ``total`` the mixture is as large as it can be while every source that isn't too small
    reaches its share. A source is too small if the mixture it would allow holds less than ``least`` of
    all targets' tokens; it gives all it may and falls short, which the report shows. With ``least`` 0
    every source that has any text decides.
    """
    most = {s: available.get(s, 0) * r for s, _, r in targets}
    whole = sum(available.get(s, 0) for s, _, _ in targets)
    decides = {s: most[s] > 0 and most[s] / w >= least * whole for s, w, _ in targets}
    if total is None:
        total = min((most[s] / w for s, w, _ in targets if decides[s]), default=0.0)
    draws = []
    for source, share, cap in targets:
        wanted = min(share * total, float(most[source]))
        rate = wanted / available[source] if available.get(source) else 0.0
        mean = mean_for(rate, cap) if rate > 0 else 0.0
        draws.append(Draw(source, share, cap, available.get(source, 0), wanted, mean, decides[source]))
    return draws


def _uniform(seed: int) -> Column:
    """A number in [0, 1) that depends only on seed and doc_id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _copies(mean: Column, cap: Column) -> Column:
    """Copies of a page: the Poisson law's values that the page's number u reaches, at most ``cap``.

    The law's terms are added up only as far as a count can come; what is broadcast is its mean.
    """
    u = F.col("u")
    far = F.least(cap.cast("double"), mean + 9 * F.sqrt(mean) + 18).cast("int")

    def add(s: Column, k: Column) -> Column:
        log = s["log"] + F.log(mean) - F.log(k.cast("double"))
        total = s["total"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("total"), (s["n"] + (u >= total).cast("int")).alias("n"))

    none = F.exp(-mean)
    start = F.struct((-mean).alias("log"), none.alias("total"), (u >= none).cast("int").alias("n"))
    more = F.sequence(F.lit(1), F.greatest(far - 1, F.lit(1)))
    counted = F.when(far > 1, F.aggregate(more, start, add, lambda s: s["n"])).otherwise((u >= none).cast("int"))
    return F.when(mean <= 0, 0).when(mean == F.lit(math.inf), cap).otherwise(counted)


def fit(sizes: DataFrame, draws: list[Draw]) -> list[Draw]:
    """The means at which the pages, with their fixed random numbers, give the tokens wanted.

    A page's copies grow with the mean, so a source's tokens do; in each of ROUNDS passes GRID means are
    tried on all pages and the closest kept. A heavy page can thus not carry a small source past its share.
    """
    spark = sizes.sparkSession
    rows = sizes.withColumn("u", _uniform(SEED))
    live = {d.source: d for d in draws if 0 < d.mean < math.inf}
    span = {s: (0.0, 3 * d.mean + 1) for s, d in live.items()}
    best = {s: (math.inf, d.mean) for s, d in live.items()}
    for turn in range(ROUNDS if live else 0):
        grid = {s: [lo + (hi - lo) * k / (GRID - 1) for k in range(GRID)] for s, (lo, hi) in span.items()}
        if turn == 0:
            grid = {s: sorted([*g[:-1], live[s].mean]) for s, g in grid.items()}
        law = spark.createDataFrame([(s, live[s].max_repeats, g) for s, g in grid.items()], "source string, cap int, means array<double>")
        tried = rows.join(F.broadcast(law), "source")  # at most MAX_SOURCES rows of GRID means
        sums = [F.sum(F.col("tokens") * _copies(F.col("means")[k], F.col("cap"))).alias(f"n{k}") for k in range(GRID)]
        got = {r["source"]: [r[f"n{k}"] or 0 for k in range(GRID)] for r in tried.groupBy("source").agg(*sums).collect()}
        for s, g in grid.items():
            given = got.get(s, [0] * GRID)
            off = [abs(n - live[s].wanted) for n in given]
            k = min(range(GRID), key=off.__getitem__)
            best[s] = min(best[s], (off[k], g[k]))
            below = max((i for i in range(GRID) if given[i] <= live[s].wanted), default=0)
            span[s] = (g[below], g[min(below + 1, GRID - 1)])
    return [d if d.source not in best else replace(d, mean=best[d.source][1]) for d in draws]


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """Sources trimmed and lower-cased with share and repeats; the table must have a bounded size.

    Rows without a source, with a share or repeats that are null or not positive, are left out; of a
    source that stands there repeatedly the largest share counts.
    """
    clean = targets.select(
        F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("w"),
        F.col("max_repeats").cast("int").alias("r"),
    ).where("source <> '' and w > 0 and not isnan(w) and r > 0")
    best = clean.groupBy("source").agg(F.max(F.struct("w", "r")).alias("b"))
    rows = best.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    if any(r["b"]["r"] > MAX_REPEATS for r in rows):
        raise ValueError(f"max_repeats above {MAX_REPEATS}")
    return sorted((r["source"], r["b"]["w"], r["b"]["r"]) for r in rows)


def mixture(
    sizes: DataFrame, targets: DataFrame, total: float | None = None, least: float = LEAST, fitted: bool = True
) -> tuple[DataFrame, list[Draw]]:
    """(doc_id, source, copy, repeats, tokens, place), and the draws behind it.

    ``sizes`` is (doc_id, source, tokens). A page is drawn as often as a Poisson law says at the page's
    hashed random number, at most max_repeats times, and comes out once for every copy; ``place`` is the
    copy's place in a global shuffle, and rows are sorted by it. Pages without tokens, without a source
    or of a source that is no target are not drawn. For ``total`` and ``least`` see ``plan``.

    The law's mean is the rate at which a source's pages must be repeated, solved for the cut at
    max_repeats. ``fitted`` moves it to the mean at which the pages with their fixed numbers give the
    tokens nearest to the target, which matters where a source has few or very uneven pages.
    """
    spark = sizes.sparkSession
    wanted = read_targets(targets)
    names = [s for s, _, _ in wanted]
    clean = sizes.select("doc_id", F.lower(F.trim("source")).alias("source"), "tokens")
    live = materialize(clean.where(F.col("source").isin(names) & (F.col("tokens") > 0)), "mix-sizes")
    have = {r["source"]: r["n"] for r in live.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    draws = plan(wanted, have, total, least)
    draws = fit(live, draws) if fitted else draws
    law = spark.createDataFrame([(d.source, d.max_repeats, float(d.mean)) for d in draws], "source string, cap int, mean double")
    numbered = live.withColumn("u", _uniform(SEED)).join(F.broadcast(law), "source")  # at most MAX_SOURCES rows
    drawn = numbered.withColumn("repeats", _copies(F.col("mean"), F.col("cap")))
    copies = drawn.where("repeats > 0").select(
        "doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"), "repeats", "tokens"
    )
    place = F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("copy"))
    return copies.withColumn("place", place).orderBy("place", "doc_id", "copy"), draws


def shares(mixed: DataFrame, draws: list[Draw]) -> DataFrame:
    """(source, target_share, max_repeats, available, decides, drawn, copies, share): what each target got.

    A source that doesn't decide was too small to limit the mixture and may fall short of its share.
    """
    spark = mixed.sparkSession
    rows = [(d.source, d.target_share, d.max_repeats, d.available, d.decides) for d in draws]
    asked = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available long, decides boolean")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.count("*").alias("copies"))
    got = materialize(got, "mix-shares")  # a row per target
    whole = got.agg(F.sum("drawn")).first()[0] or 1
    joined = asked.join(F.broadcast(got), "source", "left").fillna(0, ["drawn", "copies"])
    return joined.withColumn("share", F.col("drawn") / F.lit(float(whole)))
