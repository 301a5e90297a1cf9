import datetime as dt
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlight.llm import terms

SCHEMA = "doc_id long, field string, indexed_at timestamp, stems array<string>, stems_freq array<int>"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"stem": F.lit("clash"), "tf": F.lit(1), "pages": F.lit(2), "bucket": F.lit(0)})


ROWS = [
    (1, "body", day(1), [None, "cat", " Cat", "old"], [0, 2, 1, 5]),
    (1, " BODY", day(9), [None, "cat", "CAT ", "new"], [0, 2, 1, 5]),
    (1, "body", day(9), [None, "cat", "CAT ", "new"], [0, 2, 1, 5]),
    (2, "body", day(2), [None, "cat"], [0, 4]),
    (3, "body", day(3), [], []),
    (4, "body", None, [None, "cat", "", " "], [0, 1, 3, 3]),
    (5, "title", day(1), [None, "cat"], [0, 9]),
    (None, "body", day(1), ["cat"], [9]),
    (6, "body", day(8), None, None),
    (7, "body", day(20), ["dog", "cat"], [1, None]),
    (8, None, day(1), ["cat"], [1]),
]


def brute(rows):
    """(counts by stem, pages) over the newest body vector of every page."""
    newest = {}
    for d, f, t, s, n in rows:
        if d is None or f is None or f.strip().lower() != "body":
            continue
        if d not in newest or (t or dt.datetime.min) > (newest[d][0] or dt.datetime.min):
            newest[d] = (t, s, n)
    occ, pages = Counter(), Counter()
    for _, s, n in newest.values():
        own = Counter()
        for w, k in zip(s or [], n or []):
            if w and w.strip() and k:
                own[w.strip().lower()] += k
        occ.update(own)
        pages.update(own.keys())
    return {w: (occ[w], pages[w]) for w in occ}, len(newest)


def test_counts_of_cases(spark):
    got = terms.incremental_counts(vectors(spark, ROWS), "body", 0.5)
    want, pages = brute(ROWS)
    assert {r.stem: (r.occurrences, r.pages) for r in got.counts.collect()} == want
    assert got.pages == pages == 6


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9, 1.0])
def test_any_cut_gives_the_full_count(spark, share):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        stems = rnd.sample([f"w{i}" for i in range(30)], rnd.randint(0, 8))
        rows.append((rnd.randint(1, 90), "body", day(rnd.randint(0, 4000)), stems, [rnd.randint(1, 4) for _ in stems]))
    seen, unique = set(), []
    for r in rows:  # one state per page and time, as the order of equal times isn't defined by time
        if (r[0], r[2]) not in seen:
            seen.add((r[0], r[2]))
            unique.append(r)
    got = terms.incremental_counts(vectors(spark, unique), "body", share)
    want, pages = brute(unique)
    assert {r.stem: (r.occurrences, r.pages) for r in got.counts.collect()} == want
    assert got.pages == pages


def test_deletions(spark):
    states = terms.newest(terms.vectors(vectors(spark, ROWS), "body"))
    store = terms.TermCounts.load(states)
    gone = states.where("doc_id = 2")
    after = store.merge(gone, gone.limit(0))
    want, pages = brute([r for r in ROWS if r[0] != 2])
    assert {r.stem: (r.occurrences, r.pages) for r in after.counts.collect()} == want
    assert after.pages == pages
    assert store.merge(gone.limit(0), gone.limit(0)).counts.count() == store.counts.count()


def test_marks(spark):
    rows = [(i, "body", day(1), ["all", f"own{i}", "some"] if i < 3 else ["all"], [2, 1, 3] if i < 3 else [2]) for i in range(20)]
    got = {r.stem: r.mark for r in terms.incremental_counts(vectors(spark, rows), "body").marked().collect()}
    assert got["all"] == "common" and got["some"] == "common" and got["own1"] == "rare"


def test_empty(spark):
    none = vectors(spark, [])
    counts = terms.incremental_counts(none, "body")
    assert counts.pages == 0 and counts.marked().count() == 0
    scores = terms.parsimonious(terms.newest(terms.vectors(none, "body")))
    assert scores.count() == 0 and terms.most_distinctive(scores).count() == 0


def em(page, own):
    p = {w: tf / sum(t for t, _ in page.values()) for w, (tf, _) in page.items()}
    for _ in range(terms.MAX_STEPS):
        e = {w: tf * own * p[w] / (own * p[w] + (1 - own) * b) for w, (tf, b) in page.items()}
        total = sum(e.values())
        new = {w: x / total for w, x in e.items()}
        change = max(abs(new[w] - p[w]) for w in p)
        p = new
        if change < terms.TOLERANCE:
            break
    return p


def test_scores_against_plain_loop(spark):
    rnd = random.Random(2)
    pages = {d: Counter({f"w{min(int(rnd.expovariate(0.15)), 40)}": rnd.randint(1, 5) for _ in range(12)}) for d in range(60)}
    rows = [(d, "body", day(1), list(c), list(c.values())) for d, c in pages.items()]
    states = terms.newest(terms.vectors(vectors(spark, rows), "body"))
    got = {(r.doc_id, r.stem): r.score for r in terms.parsimonious(states, own=0.2).collect()}
    df = Counter(w for c in pages.values() for w in c)
    pairs = sum(df.values())
    for d, c in pages.items():
        want = em({w: (n, df[w] / pairs) for w, n in c.items()}, 0.2)
        for w, x in want.items():
            assert got[d, w] == pytest.approx(x, abs=1e-9)
        assert math.isclose(sum(got[d, w] for w in c), 1)


def test_asked_pages_are_scored_against_all(spark):
    rows = [(d, "body", day(1), ["the", f"shared{d // 2}", f"own{d}"], [9, 6, 8]) for d in range(40)]
    states = terms.newest(terms.vectors(vectors(spark, rows), "body"))
    asked = spark.createDataFrame([(3,), (3,), (None,), (99,)], "doc_id long")
    got = terms.most_distinctive(terms.parsimonious(states, asked)).collect()
    assert [tuple(r) for r in got] == [(3, "shared1")]


def test_runs_until_nothing_moves(spark):
    """Two stems nearly as widespread: the state after 60 steps still moves."""
    rows = [(d, "body", day(1), ["near", "close"] if d < 10 else ["close", "far"] if d < 11 else [f"own{d}", "far"], [3, 3]) for d in range(40)]
    states = terms.newest(terms.vectors(vectors(spark, rows), "body"))
    scores = {r.stem: r.score for r in terms.parsimonious(states).where("doc_id = 0").collect()}
    expected = {w: 0.005 * scores[w] / (0.005 * scores[w] + 0.995 * n / 80) for w, n in {"near": 10, "close": 11}.items()}
    assert max(abs(e / sum(expected.values()) - scores[w]) for w, e in expected.items()) < terms.TOLERANCE


def test_no_silent_end(spark):
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "stem": w, "tf": t, "background": b, "pages": 2} for w, t, b in (("a", 9, 0.5), ("b", 1, 0.01))])
    with pytest.raises(ArithmeticError):
        list(terms._solve(0.005, 2, 1e-6)([batch]))


def test_pages_that_span_batches(spark, monkeypatch):
    """Portions end between pages, wherever the batches end."""
    rnd = random.Random(3)
    rows = [(d, "body", day(1), [f"w{i}" for i in range(rnd.randint(0, 60))], [rnd.randint(1, 5)] * 60) for d in range(40)]
    states = terms.newest(terms.vectors(vectors(spark, [(d, f, t, s, n[: len(s)]) for d, f, t, s, n in rows]), "body"))
    whole = {(r.doc_id, r.stem): r.score for r in terms.parsimonious(states, own=0.2).collect()}
    flat = sorted((d, w, n[0], 0.001 * (1 + len(w))) for d, _, _, s, n in rows for w in s)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((*r, 1) for r in flat[i : i + 7]))], names=["doc_id", "stem", "tf", "background", "pages"])
        for i in range(0, len(flat), 7)
    ]
    solve = terms._solve(0.2, 10_000, 1e-6)
    once = [r for b in solve(iter(batches)) for r in b.to_pylist()]
    monkeypatch.setattr(terms, "PORTION", 20)
    again = [r for b in solve(iter(batches)) for r in b.to_pylist()]
    assert once == again and len(once) == len(flat) == len(whole)


def test_store_in_a_later_session(spark, tmp_path):
    """A store is opened by its path; additions, changes and deletions go to the touched buckets only."""
    path = f"file://{tmp_path}/store"
    rows = [r for r in ROWS if r[0] in (1, 2, 3)] + [(100 + i, "body", day(1), [f"w{i}", "cat"], [2, 1]) for i in range(60)]
    states = terms.newest(terms.vectors(vectors(spark, rows), "body"))
    with pytest.raises(FileNotFoundError):
        terms.TermCounts.open(spark, path)
    terms.TermCounts.load(states, path)
    other = spark.newSession()
    store = terms.TermCounts.open(other, path)
    assert store.version == 1 and store.pages == brute(rows)[1]

    changed = [(2, "body", day(30), ["dog"], [7]), (500, "body", day(30), ["cat", "fish"], [1, 1])]
    gone = states.where("doc_id in (2, 105)")
    new = terms.newest(terms.vectors(vectors(spark, changed), "body"))
    after = store.merge(gone, new)
    kept = [r for r in rows if r[0] not in (2, 105)] + changed
    want, pages = brute(kept)
    for got in (after, terms.TermCounts.open(other, path)):
        assert {r.stem: (r.occurrences, r.pages) for r in got.counts.collect()} == want
        assert got.pages == pages and got.version == 2
    assert {v for v in after.held.values()} == {1, 2}  # some buckets are those of the first load
    assert {r.stem for r in store.counts.collect()} == set(brute(rows)[0])  # who has the old version open still reads it
    with pytest.raises(FileExistsError):  # a second writer from the old version
        store.merge(gone, new)
    after.clean()
    assert len(list((tmp_path / "store" / "manifest").glob("*.json"))) == 1
    files = [p for p in (tmp_path / "store" / "data").glob("v*/bucket=*") if p.is_dir()]
    assert len(files) == len(after.held)
    assert {r.stem: (r.occurrences, r.pages) for r in terms.TermCounts.open(other, path).counts.collect()} == want
    # a writer that broke off before its manifest leaves the version as it was
    (tmp_path / "store" / "data" / "v3" / "bucket=0").mkdir(parents=True)
    assert terms.TermCounts.open(other, path).version == 2
    assert terms.TermCounts.open(other, path).merge(gone.limit(0), new.limit(0)).counts.count() == len(want)


def test_equal_stems_of_a_row(spark):
    rows = [
        (1, "body", day(1), ["b", "A ", " a", "c", "B", "a", None, "", "d"], [1, 2, 4, 8, 16, 32, 64, 128, 0]),
        (2, "body", day(1), ["x", "y"], [1, 2]), (3, "body", day(1), [], []), (4, "body", day(1), None, None),
        (5, "body", day(1), ["x", "y", "z"], [1]),
    ]
    got = {r.doc_id: sorted((t.stem, t.tf) for t in r.terms) for r in terms.flat_terms(vectors(spark, rows)).collect()}
    assert got == {1: [("a", 38), ("b", 17), ("c", 8)], 2: [("x", 1), ("y", 2)], 3: [], 4: [], 5: [("x", 1)]}
