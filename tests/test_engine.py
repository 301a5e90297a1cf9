"""Trees on a small collection, against an evaluator that goes operator by operator in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftlight.functions.analysis import Analyzer
from siftlight.operators import feedback, ranking
from siftlight.plans import batch, rules
from siftlight.plans import compile as C
from siftlight.plans import models as M
from siftlight.plans import tree as T
from siftlight.plans.parser import parse
from siftlight.scratch import new_path
from siftlight.sources import index as I
from siftlight.sources.index import build, scan

from tests.test_positional import near, window

WORDS = "cat dog fish bird cow".split()
STOP = {"the", "of"}


def _docs():
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        text = " ".join(rnd.choice([*WORDS, "the", "of", "x1"]) for _ in range(rnd.randint(1, 25)))
        rows.append((i, f"d{i}", None if i == 7 else "" if i == 8 else text, "cat of dog" if i % 3 else None))
    return rows


DOCS = _docs()


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, ext_id string, body string, title string")
    return build(df.withColumn("extra", F.lit(1)), new_path(spark, "test-index"), ("body", "title"))


class Plain:
    """Complete result lists, one operator after the other."""

    def __init__(self, model):
        self.model = model
        self.text = {f: {d[0]: [(p, w) for p, w in enumerate((d[k] or "").split()) if w not in STOP] for d in DOCS} for f, k in (("body", 2), ("title", 3))}

    def len(self, f, d):
        return len(self.text[f][d])

    def positions(self, n):
        if isinstance(n, T.Term):
            got = {d: [p for p, w in t if w == n.term] for d, t in self.text[n.field].items()}
            return {d: p for d, p in got.items() if p}
        args = [self.positions(a) for a in n.args]
        if isinstance(n, T.Syn):
            return {d: sorted(p for a in args for p in a.get(d, [])) for d in set().union(*args)}
        out = {}
        for d in set(args[0]).intersection(*args[1:]):
            ps = [a[d] for a in args]
            if isinstance(n, T.Near):
                r = ps[0]
                for nxt in ps[1:]:
                    r = near(r, nxt, n.n)
            else:
                r = window(ps, n.n)
            if r:
                out[d] = r
        return out

    def run(self, n):
        """(scores of the documents found, default score by document)."""
        m = self.model
        if isinstance(n, T.Score):
            p, f = self.positions(n.list), n.list.field
            df, ctf = len(p), sum(map(len, p.values()))
            total = sum(map(len, self.text[f].values()))
            have = sum(1 for t in self.text[f].values() if t)
            if isinstance(m, M.Indri):
                q = ctf / total

                def score(tf, d):
                    return m.lam * (tf + m.mu * q) / (self.len(f, d) + m.mu) + (1 - m.lam) * q

                return {d: score(len(x), d) for d, x in p.items()}, lambda d: score(0, d)
            if isinstance(m, M.BM25):
                avg = total / have
                s = {d: math.log((len(DOCS) - df + 0.5) / (df + 0.5)) * len(x) / (len(x) + m.k1 * (1 - m.b + m.b * self.len(f, d) / avg)) for d, x in p.items()}
                return s, lambda d: 0.0
            return {d: float(len(x)) if isinstance(m, M.RankedBoolean) else 1.0 for d, x in p.items()}, lambda d: 0.0
        parts = [self.run(a) for a in n.args]
        docs = set().union(*(s for s, _ in parts))
        if isinstance(m, M.Indri):
            w = n.weights if isinstance(n, T.Weighted) else [1 / len(parts)] * len(parts)

            def join(values):
                if isinstance(n, T.WSum):
                    return sum(v * x for v, x in zip(values, w))
                return math.prod(v**x for v, x in zip(values, w))

            default = lambda d: join([z(d) for _, z in parts])
            return {d: join([s.get(d, z(d)) for s, z in parts]) for d in docs}, default
        if isinstance(n, T.And):
            docs = set(parts[0][0]).intersection(*(s for s, _ in parts[1:]))
            return {d: min(s[d] for s, _ in parts) for d in docs}, lambda d: 0.0
        how = sum if isinstance(n, T.Sum) else max
        return {d: how([s[d] for s, _ in parts if d in s]) for d in docs}, lambda d: 0.0


def _list_text(rnd, depth):
    if depth == 0 or rnd.random() < 0.5:
        return rnd.choice(WORDS)
    args = " ".join(_list_text(rnd, depth - 1) for _ in range(rnd.randint(1, 3)))
    return f"#{rnd.choice(['SYN', 'NEAR/2', 'NEAR/4', 'WINDOW/3', 'WINDOW/6'])}({args})"


def _text(rnd, model, depth):
    if depth == 0 or rnd.random() < 0.4:
        return _list_text(rnd, 2) if rnd.random() < 0.7 else rnd.choice(["cat.title", "dog.title"])
    op = rnd.choice(model.operators)
    args = [_text(rnd, model, depth - 1) for _ in range(rnd.randint(1, 3))]
    if issubclass(op, T.Weighted):
        args = [f"{rnd.randint(1, 9)} {a}" for a in args]
    return f"#{op.__name__.upper()}({' '.join(args)})"


MODELS = [M.UnrankedBoolean(), M.RankedBoolean(), M.BM25(), M.Indri(mu=10.0)]


def _texts(model, n, seed):
    rnd = random.Random(seed)
    return [_text(rnd, model, 3) for _ in range(n)]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
def test_random_trees(spark, index, model):
    for text in _texts(model, 4, 11):
        tree = parse(text, model)
        got = {r.doc_id: r.score for r in C.evaluate(index, tree, model).collect()}
        root = rules.analyze(tree, model)
        want = Plain(model).run(root if isinstance(root, T.Scored) else rules.analyze(model.default((tree,)), model))[0]
        assert got == pytest.approx(want), text


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
def test_batch_equals_single(spark, index, model):
    texts = [*_texts(model, 25, 5), "zzz", "", None, "#AND(cat", "the"]
    queries = spark.createDataFrame(list(enumerate(texts)), "qid int, query string")
    scores = batch.evaluate_all(index, queries, model).scores.collect()
    got = {}
    for r in scores:
        got.setdefault(r.qid, {})[r.doc_id] = r.score
    for i, text in enumerate(texts[:25]):
        tree = parse(text, model)
        root = rules.analyze(tree, model)
        want = Plain(model).run(root if isinstance(root, T.Scored) else rules.analyze(model.default((tree,)), model))[0]
        assert got.get(i, {}) == pytest.approx(want), text
    run = batch.run(index, queries, model).collect()
    assert {r.qid for r in run} == set(range(len(texts)))
    assert all(r.ext_id == "dummy" and r.rank == 1 and r.score == 0 for r in run if r.qid >= 25)


def test_scan_equals_index(spark, index):
    texts = spark.createDataFrame([d[:4] for d in DOCS], "doc_id long, ext_id string, body string, title string")
    for model in (M.BM25(), M.Indri()):
        tree = parse("#SUM(#NEAR/3(cat dog) fish cat.title)" if isinstance(model, M.BM25) else "#AND(#NEAR/3(cat dog) fish cat.title)", model)
        found = scan(texts, rules.terms(list(tree.args)))
        assert (found.stats("body"), found.stats("title"), found.n_docs) == (index.stats("body"), index.stats("title"), 40)
        a = {r.doc_id: r.score for r in C.evaluate(index, tree, model).collect()}
        b = {r.doc_id: r.score for r in C.evaluate(found, tree, model).collect()}
        assert a == pytest.approx(b) and a


def test_the_layout_grows_with_the_tokens(spark, index, monkeypatch):
    """Small tasks make many buckets and slices, frequent terms lie in many files, and nothing else changes."""
    monkeypatch.setattr(I, "MOST_BUCKETS", 8)
    df = spark.createDataFrame(DOCS, "doc_id long, ext_id string, body string, title string")
    fine = build(df, new_path(spark, "test-index"), ("body", "title"), task_tokens=20)
    columns = ["field", "term", "doc_id", "tf", "positions"]
    rows = [sorted(map(tuple, x.postings.select(*columns).collect())) for x in (index, fine)]
    assert rows[0] == rows[1]
    files = {r.term: r.n for r in fine.postings.where("field = 'body'").select("term", F.input_file_name().alias("f")).distinct().groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert max(files.values()) > 1
    assert fine.lists([T.Term("cat")]).count() == index.lists([T.Term("cat")]).count() > 0
    for buckets, tokens in ((8, 2_000_000), (32, 5)):
        monkeypatch.setattr(I, "MOST_BUCKETS", 32)
        assert build(df, new_path(spark, "test-index"), ("body", "title"), task_tokens=tokens).buckets == buckets


def test_pieces_are_placed_like_one_text(spark):
    """An address with very many links: every link's words stand where they would in the joined text."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice([*WORDS, "the"]) for _ in range(rnd.randint(0, 4))) for _ in range(5000)]
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, ext_id string")
    rows = [(1, "inlink", i // 7, i, t) for i, t in enumerate(texts)] + [(2, "inlink", 0, 0, "cat the dog"), (2, "inlink", 3, 9, None)]
    pieces = spark.createDataFrame(rows, "doc_id long, field string, part long, place long, text string")
    got = build(docs, new_path(spark, "test-index"), (), pieces.repartition(5))
    joined = " ".join(texts).split()
    want = {w: [p for p, x in enumerate(joined) if x == w] for w in set(joined) - STOP}
    assert {r.term: r.positions for r in got.postings.where("doc_id = 1").collect()} == want
    assert {r.term: r.positions for r in got.postings.where("doc_id = 2").collect()} == {"cat": [0], "dog": [2]}
    assert got.docs.where("doc_id = 1").first().lens == {"inlink": sum(map(len, want.values()))}


def test_counts_inside_a_row(spark):
    rows = [(1, ["b", "a", "b", "c", "b", "a"]), (2, []), (3, ["x"]), (4, None), (5, ["y"] * 3000)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = {r.id: None if r.c is None else {x.term: x.tf for x in r.c} for r in df.select("id", I._counts(F.col("t")).alias("c")).collect()}
    assert got == {1: {"a": 2, "b": 3, "c": 1}, 2: None, 3: {"x": 1}, 4: None, 5: {"y": 3000}}
    rows += [(6, [None, "b", None, "a", "b", None]), (7, [None, None])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = {r.id: None if r.c is None else {x.term: x.positions for x in r.c} for r in df.select("id", I._lists(F.col("t")).alias("c")).collect()}
    assert got[1] == {"a": [1, 5], "b": [0, 2, 4], "c": [3]} and got[6] == {"b": [1, 4], "a": [3]} and got[5] == {"y": list(range(3000))}
    assert got[2] is got[4] is got[7] is None


def test_forward_index_alone(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, ext_id string, body string, title string")
    path = new_path(spark, "test-index")
    first = I.build_forward(docs, path, ("body", "title"))
    assert first.postings is None
    both = I.invert(first, path)
    want = {(r.doc_id, r.field, r.term): r.tf for r in both.postings.collect()}
    assert {(r.doc_id, r.field, r.term): r.tf for r in first.vectors().collect()} == want


def test_lookups_start_no_job(spark, index):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "")
    plan = index.lists([T.Term("cat"), T.Term("dog", "title")])
    assert not tracker.getJobIdsForGroup("lookup")
    assert "PartitionFilters" in plan._jdf.queryExecution().toString() and "xxhash64" not in plan._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stemmed_index(spark):
    """Index and queries share the analyzer, also after opening."""
    docs = spark.createDataFrame([(1, "a", "the hopping cats"), (2, "b", "a cat hops"), (3, "c", "hope")], "doc_id long, ext_id string, body string")
    path = new_path(spark, "test-index")
    build(docs, path, ("body",), analyzer=Analyzer(stemmer="porter"))
    got = I.Index.open(spark, path)
    node = parse("#AND(hopped cats)", M.RankedBoolean(), got.analyzer)
    assert {r.doc_id for r in C.evaluate(got, node, M.RankedBoolean()).collect()} == {1, 2}
    queries = spark.createDataFrame([(1, "hopped cats")], "qid int, query string")
    assert {r.doc_id for r in batch.evaluate_all(got, queries, M.RankedBoolean()).scores.collect()} == {1, 2}


def test_empty_collection(spark):
    docs = spark.createDataFrame([], "doc_id long, ext_id string, body string")
    got = build(docs, new_path(spark, "test-index"), ("body",))
    assert got.n_docs == 0 and C.evaluate(got, parse("cat", M.BM25()), M.BM25()).count() == 0


def test_counts_keep_empty_documents(index):
    assert index.n_docs == 40
    assert index.stats("body").doc_count < 40


def test_metamorphic(spark, index):
    ranked = M.RankedBoolean()

    def run(text, model=ranked):
        return {r.doc_id: r.score for r in C.evaluate(index, parse(text, model), model).collect()}

    one, two = run("cat"), run("#OR(#SYN(cat cat))")
    assert {d: 2 * s for d, s in one.items()} == two
    assert set(run("#OR(#NEAR/2(cat dog))")) <= set(run("#AND(cat dog)"))
    assert set(run("#OR(#WINDOW/3(cat dog))")) <= set(run("#OR(#WINDOW/6(cat dog))"))
    assert run("#WAND(1 cat 1 dog)", M.Indri()) == pytest.approx(run("#AND(cat dog)", M.Indri()))


def test_top_ties_and_none(spark, index):
    model = M.UnrankedBoolean()
    top = ranking.top(C.evaluate(index, parse("cat", model), model), model, 5).orderBy("rank").collect()
    ids = sorted(r.ext_id for r in C.evaluate(index, parse("cat", model), model).collect())
    assert [r.ext_id for r in top] == ids[:5] and [r.rank for r in top] == [1, 2, 3, 4, 5]
    assert C.evaluate(index, parse("the", model), model).count() == 0


def test_feedback_only_language_model(index):
    node = parse("cat", M.Indri())
    with pytest.raises(M.UnsupportedOperator):
        feedback.expanded(node, [("dog", 1.0)], 0.5, M.BM25())
    assert feedback.expanded(node, [], 0.5, M.Indri()) == node


def test_vectors_of_all_and_of_asked_documents(spark, index):
    def count(words):
        return {w: words.count(w) for w in words if w not in STOP}

    want = {(d[0], f, w): n for d in DOCS for f, k in (("body", 2), ("title", 3)) for w, n in count((d[k] or "").split()).items()}
    assert {(r.doc_id, r.field, r.term): r.tf for r in index.vectors().collect()} == want
    asked = spark.createDataFrame([(3,), (3,), (99,)], "doc_id long")
    got = {(r.doc_id, r.field, r.term): r.tf for r in index.vectors(asked).collect()}
    assert got == {k: n for k, n in want.items() if k[0] == 3}
