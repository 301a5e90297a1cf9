"""Analyzer options and stems."""

import pytest
from pyspark.sql import functions as F

from siftlight.functions import analysis
from siftlight.functions.analysis import Analyzer
from siftlight.functions.porter import stem

# Examples of the paper, step by step.
STEMS = (
    "caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, "
    "motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall, "
    "hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, "
    "rational ration, valenci valenc, digitizer digit, radicalli radic, vietnamization vietnam, predication predic, "
    "operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, "
    "sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electrical electr, "
    "hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, adjustable adjust, "
    "defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, "
    "communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, "
    "probate probat, rate rate, cease ceas, controll control, roll roll, by by, is is, 3d 3d, книги книги, naïve naïve"
)


@pytest.mark.parametrize("pair", STEMS.split(", "))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


CASES = [(1, "The Cats' hopping isn't John's 汉字 rates, RATES"), (2, None), (3, ""), (4, "the of"), (5, "x " * 3000)]


@pytest.mark.parametrize("analyzer", [Analyzer(), Analyzer(lowercase=False), Analyzer(stop=False), Analyzer(stemmer="porter"), Analyzer(stemmer="porter", unstemmed=("rates", "hopping"))])
def test_columns_and_strings_agree(spark, analyzer):
    df = spark.createDataFrame(CASES, "id int, text string")
    got = {r.id: list(r.t) for r in df.select("id", analyzer.kept(F.col("text")).alias("t")).collect()}
    for i, text in CASES:
        assert got[i] == [analyzer.query_term(w) for w in analyzer.tokenize(text or "")]
    assert Analyzer.of(analyzer.describe()) == analyzer


def test_options():
    assert [Analyzer(stemmer="porter").query_term(w) for w in ("Hopping", "the", "cats")] == ["hop", None, "cat"]
    assert Analyzer(stemmer="porter", unstemmed=("cats",)).query_term("cats") == "cats"
    assert Analyzer(stop=False).query_term("the") == "the" and Analyzer(lowercase=False).query_term("Cats") == "Cats"
    assert analysis.query_term("Cats") == "cats"
    with pytest.raises(ValueError, match="stemmer"):
        Analyzer(stemmer="other")
