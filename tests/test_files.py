import pytest
from pyspark.sql import functions as F

from siftlight.operators import letor
from siftlight.sources import files


def test_parameters():
    got = files.parameters(["BM25:k_1=1.2\r\n", " b = x ", "no", "a=b=c", "#k=1", "=2"])
    assert got == {"BM25:k_1": "1.2", "b": "x", "#k": "1"}


def test_readers(spark, tmp_path):
    (tmp_path / "q").write_text("10:#AND(cheap internet)\r\n2: french: lick\nbroken\n")
    assert [(r.qid, r.query) for r in files.read_queries(spark, str(tmp_path / "q")).orderBy("ord").collect()] == [(10, "#AND(cheap internet)"), (2, "french: lick")]
    (tmp_path / "r").write_text("2 0 doc-1 1\n2  0\tdoc-2 x\nshort line\n")
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path / "r")).collect()] == [(2, "0", "doc-1", 1), (2, "0", "doc-2", None)]
    (tmp_path / "p").write_text("d1 -3.5\nd2\n")
    assert [tuple(r) for r in files.read_pagerank(spark, str(tmp_path / "p")).collect()] == [("d1", -3.5)]
    (tmp_path / "run").write_text("7\tQ0\tD1\t1\t0.5\trun\n7 Q0 d2 2 0.9 run\n")
    got = files.read_run(spark, str(tmp_path / "run")).orderBy("line").collect()
    assert [(r.qid, r.ext_id, r.score) for r in got] == [(7, "d1", 0.5), (7, "d2", 0.9)]


def test_lines_keep_the_order_of_files(spark, tmp_path):
    """A short file before a long one, and a file of many parts."""
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "part-0").write_text("1 Q0 first 1 0.5 x\n")
    (tmp_path / "r" / "part-1").write_text("".join(f"1 Q0 d{i:05} 1 0.5 x\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = [r.ext_id for r in files.read_run(spark, str(tmp_path / "r")).orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == ["first", *(f"d{i:05}" for i in range(5000))]


def test_writers_overwrite(spark, tmp_path):
    run = spark.createDataFrame([(1, "Q0", "a", 2, 0.5, "r"), (1, "Q0", "b", 1, 0.7, "r")], "qid int, q0 string, ext_id string, rank int, score double, run_id string")
    for _ in range(2):
        files.write_run(run, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1\tQ0\tb\t1\t0.7\tr", "1\tQ0\ta\t2\t0.5\tr"]
    files.write_expansions(spark.createDataFrame([(3, "#WAND( 1 x )")], "qid int, learned string"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first().value == "3: #WAND( 1 x )"


def test_svm_model(spark, tmp_path):
    path = tmp_path / "model"
    path.write_text("\n".join(["SVM", "0 # kernel type", "3 # kernel parameter -d", *["h"] * 8, "0.5 qid:1 1:2 3:4 #", "-1 1:1 #", "2e-1 2:-1.5 # x"]))
    got = {r.feature: r.weight for r in letor.svm_weights(files.read_svm_model(spark, str(path))).collect()}
    assert got == {1: 0.0, 3: 2.0, 2: pytest.approx(-0.3)}
    path.write_text("SVM\n1 # kernel type\n1 1:1 #")
    with pytest.raises(ValueError, match="linear"):
        files.read_svm_model(spark, str(path))
    rows = spark.createDataFrame([(0.5, {1: 2.0, 12: -1e-9}), (-2.0, {})], "alpha double, values map<int, double>")
    files.write_svm_model(rows, str(tmp_path / "written"))
    assert [(r.alpha, r["values"]) for r in files.read_svm_model(spark, str(tmp_path / "written")).collect()] == [(0.5, {1: 2.0, 12: -1e-9})]


def test_normalized_and_lines(spark):
    cols = ", ".join(f"{c} double" for c in letor.FEATURES)
    rest = (0.0,) * 16
    rows = spark.createDataFrame([(1, "a", 1, 1.0, 5.0, *rest), (1, "b", 0, 3.0, None, *rest), (1, "c", 2, 2.0, float("nan"), *rest)], f"qid int, ext_id string, rel int, {cols}")
    got = {r.ext_id: (r.f1, r.f2) for r in letor.normalized(rows.withColumn("size", F.lit(1))).collect()}
    assert got == {"a": (0.0, 0.0), "b": (1.0, 0.0), "c": (0.5, 0.0)}
    line = letor.svmlight(letor.normalized(rows), disabled=tuple(range(3, 19))).collect()
    assert "0 qid:1 1:1.000000 2:0.000000 # b" in {r.line for r in line}


def test_ranking_model_learns(spark):
    """Held-out pairs are ordered right when grades follow two features."""
    cols = ", ".join(f"{c} double" for c in letor.FEATURES)
    rows = []
    for q in range(12):
        for d in range(20):
            x, y = (d * 7 % 20) / 20, (d * 3 % 20) / 20
            rows.append((q, f"d{d}", int((x + 2 * y) > 1.4) + int((x + 2 * y) > 2.2), x, y, *(0.0,) * 16))
    df = spark.createDataFrame(rows, f"qid int, ext_id string, rel int, {cols}")
    weights = letor.train(df.where("qid < 8"))
    assert weights[1] > weights[0] > 0
    ranked = letor.reranked(df.where("qid = 9"), weights).join(df.where("qid = 9").select("ext_id", "rel"), "ext_id").orderBy("rank").collect()
    best = [r.rel for r in ranked]
    right = sum(a > b for i, a in enumerate(best) for b in best[i + 1 :])
    wrong = sum(a < b for i, a in enumerate(best) for b in best[i + 1 :])
    assert right > 20 * wrong
