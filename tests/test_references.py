import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftlight.operators import hotkeys
from siftlight.operators import references as R
from siftlight.operators.bloom import BloomFilter
from siftlight.operators.hotkeys import lookup_join


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


RECORDS = [
    ("A ", at(10), at(20)), ("a", at(10), at(20)), ("a", at(30), None),
    ("b", at(5), None), ("c", None, None), (None, at(1), None), (" ", at(1), None),
    ("d", at(9), at(9)), ("e", at(12, 6), at(12, 8)),
]
REFS = [
    ("a", at(5)), ("a", at(10)), ("a", at(15)), ("A", at(20)), (" a", at(25)), ("a", at(30)), ("b", at(4, 23)), ("b", at(5)),
    ("zz", at(3)), ("zz", at(3)), ("c", at(3)), ("d", at(9)), (None, at(1)), ("", at(1)), ("a", None),
    ("e", at(12, 5)), ("e", at(12, 6)), ("e", at(12, 8)),
]


def frames(spark, refs, records):
    q = spark.createDataFrame(refs, "ext_id string, judged_at timestamp").withColumn("tab", F.lit("clash"))
    return R.references({"qrels": (q, "judged_at")}), spark.createDataFrame(records, "ext_id string, indexed_at timestamp, deleted_at timestamp").withColumn("t", F.lit(1))


def brute():
    out = {}
    recs = [(e.strip().lower(), a, z) for e, a, z in RECORDS if e and e.strip()]
    for e, t in REFS:
        if not e or not e.strip() or t is None:
            continue
        e = e.strip().lower()
        own = [r for r in recs if r[0] == e]
        if any(a is not None and a <= t and (z is None or z > t) for _, a, z in own):
            continue
        why = "missing" if not own else "deleted" if any(a is not None and a <= t for _, a, _ in own) else "late"
        out[e, t, why] = out.get((e, t, why), 0) + 1
    return out


def test_cases(spark):
    refs, records = frames(spark, REFS, RECORDS)
    got = R.orphans(refs, records).collect()
    assert {(r.ext_id, r.t, r.why): r.n for r in got} == brute()
    report = R.orphan_report(R.orphans(refs, records)).collect()
    assert sum(r.refs for r in report) == sum(brute().values())


def test_tiny_filter_gives_the_same(spark):
    """With a filter too small to prove much, the exact check still finds all."""
    refs, records = frames(spark, REFS, RECORDS)
    got = R.orphans(refs, records, max_bits=64).collect()
    assert {(r.ext_id, r.t, r.why): r.n for r in got} == brute()


def test_hot_id_and_a_filter_that_is_left_out(spark):
    """One id has half of all references, most of them within an hour; a filter without room is not built."""
    rnd = random.Random(6)
    begin, end = at(40, 3) + dt.timedelta(minutes=20), at(40, 3) + dt.timedelta(minutes=40)
    records = [("hot", begin, end), ("hot", at(41), at(42))] + [(f"r{i}", at(i % 50), None) for i in range(300)]
    refs = [("hot", at(40, 3) + dt.timedelta(seconds=rnd.randint(0, 3599))) for _ in range(2000)]
    refs += [("hot", at(rnd.randint(38, 43), rnd.randint(0, 23))) for _ in range(200)]
    refs += [(f"r{rnd.randint(0, 500)}", at(rnd.randint(0, 60))) for _ in range(2200)]
    since = {}
    for e, a, _ in records:
        since[e] = min(a, since.get(e, a))
    want = {}
    for e, t in refs:
        if not any(e == r and a <= t and (z is None or z > t) for r, a, z in records):
            key = (e, t, "missing" if e not in since else "deleted" if since[e] <= t else "late")
            want[key] = want.get(key, 0) + 1
    for bits in (None, 4):
        assert BloomFilter(spark.createDataFrame(records, "k string, a timestamp, z timestamp"), "k", bits).useful is (bits is None)
        q, r = frames(spark, refs, records)
        got = {(x.ext_id, x.t, x.why): x.n for x in R.orphans(q, r, max_bits=bits).collect()}
        assert got == want


@pytest.mark.parametrize(("refs", "records"), [([], []), (REFS, []), ([], RECORDS)])
def test_empty(spark, refs, records):
    got = R.orphans(*frames(spark, refs, records)).collect()
    assert {r.why for r in got} == ({"missing"} if refs else set())


def test_bloom(spark):
    keys = spark.range(0, 3000).select(F.col("id").cast("string").alias("k"))
    seen = BloomFilter(keys, "k").may_contain(F.col("k"))
    assert keys.where(~seen).count() == 0
    others = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("k"))
    assert others.where(seen).count() < 500
    nothing = spark.createDataFrame([(None,)], "k string")
    assert nothing.where(seen).count() == 0


def test_lookup_join_beyond_broadcast(spark):
    facts = spark.range(5000).select((F.col("id") % 50).alias("k"), "id").unionByName(spark.range(9000, 14000).select(F.lit(7).cast("long").alias("k"), "id"))
    lookup = facts.groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_join(facts, lookup, ["k"], "n", lookup_rows=10**6, bound=3)
    assert got.count() == 10_000 and got.select("id").distinct().count() == 10_000


def test_lookup_join_measures_bytes(spark, monkeypatch):
    """Few rows may be large: beyond the bytes allowed only popular keys are broadcast, and the rows are the same."""
    monkeypatch.setattr(hotkeys, "BROADCAST_BYTES", 5000)
    facts = spark.range(2000).select((F.col("id") % 20).alias("k"), "id").unionByName(spark.range(9000, 12000).select(F.lit(7).cast("long").alias("k"), "id"))
    lookup = facts.groupBy("k").agg(F.count("*").alias("n")).withColumn("wide", F.expr("transform(sequence(1, 100), x -> named_struct('a', x, 'b', repeat('y', 5)))"))
    bytes_ = lookup.select(hotkeys.row_bytes(lookup).alias("b")).first().b
    assert 2000 < bytes_ < 8000
    got = lookup_join(facts, lookup, ["k"], "n", lookup_rows=20)
    assert got.count() == 5000 and got.select("id").distinct().count() == 5000 and got.where("size(wide) <> 100").count() == 0
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
