import pytest

from siftlight.functions.analysis import query_term, tokenize
from siftlight.plans import models as M
from siftlight.plans import tree as T
from siftlight.plans.models import UnsupportedOperator
from siftlight.plans.parser import ParseError, parse
from siftlight.plans.rules import AnalysisError, analyze, leaves

RANKED, BM25, INDRI = M.RankedBoolean(), M.BM25(), M.Indri()


@pytest.mark.parametrize(
    ("text", "model", "want"),
    [
        ("cat dog", RANKED, "#OR( cat.body dog.body )"),
        ("cat dog", BM25, "#SUM( cat.body dog.body )"),
        ("cat dog", INDRI, "#AND( cat.body dog.body )"),
        ("#and(cat, dog)", RANKED, "#AND( cat.body dog.body )"),
        ("#AND(cat dog) fish", RANKED, "#OR( #AND( cat.body dog.body ) fish.body )"),
        ("#near/2(cat dog)", BM25, "#SUM( #NEAR/2( cat.body dog.body ) )"),
        ("#SYN(cat cat)", BM25, "#SUM( #SYN( cat.body cat.body ) )"),
        ("#WINDOW/8( cat #NEAR/1(dog fish) )", RANKED, "#OR( #WINDOW/8( cat.body #NEAR/1( dog.body fish.body ) ) )"),
        ("#WAND(0.5 the 0.5 cat)", INDRI, "#WAND( 0.5 cat.body )"),
        ("#WAND(0.2 #AND(the) 0.8 cat)", INDRI, "#WAND( 0.8 cat.body )"),
        ("cat.title x.b.URL", RANKED, "#OR( cat.title x.url )"),
        ("Wi-Fi dog's", RANKED, "#OR( wi.body dog.body )"),
    ],
)
def test_trees(text, model, want):
    assert str(parse(text, model)) == want


@pytest.mark.parametrize("text", ["#And(fickle, #near(creek farm))", "#AND(cat dog", "cat)", "#foo(cat)", "#near/0(a b)", "#WAND(cat 1)", "#WAND(1)", "#syn", "#near/2(cat #AND(dog fish))"])
def test_malformed(text):
    with pytest.raises(ParseError):
        parse(text, RANKED)


@pytest.mark.parametrize("text", ["", None, "the of", "#AND(the)", "!!"])
def test_nothing_left(text):
    assert parse(text, RANKED) is None


def test_support_and_fields():
    with pytest.raises(UnsupportedOperator):
        analyze(parse("#AND(cat dog)", BM25), BM25)
    with pytest.raises(UnsupportedOperator):
        analyze(parse("#OR(cat dog)", INDRI), INDRI)
    with pytest.raises(AnalysisError):
        analyze(parse("#OR(#NEAR/1(cat.title dog))", RANKED), RANKED)


def test_rewrites():
    flat = analyze(parse("#OR(a1 #OR(b1 #AND(c1 #AND(d1 e1))))", RANKED), RANKED)
    assert len(flat.args) == 3 and len(flat.args[2].args) == 3
    nested = analyze(parse("#AND(a1 #AND(b1 c1))", INDRI), INDRI)
    assert len(nested.args) == 2
    weighted = analyze(parse("#WSUM(2 a1 6 b1)", INDRI), INDRI)
    assert weighted.weights == (0.25, 0.75)
    single = analyze(parse("#OR(#WINDOW/3(cat))", RANKED), RANKED)
    assert leaves(single) == [T.Term("cat")]


def test_models():
    with pytest.raises(ValueError, match="b must lie"):
        M.BM25(b=2)
    with pytest.raises(ValueError, match="lambda"):
        M.Indri(lam=-1)
    assert M.model_of({"retrievalAlgorithm": "bm25", "BM25:k_1": "2"}) == M.BM25(k1=2.0)
    assert isinstance(M.model_of({"retrievalAlgorithm": "LETOR"}), M.LearnToRank)
    with pytest.raises(ValueError, match="unknown"):
        M.model_of({"retrievalAlgorithm": "x"})


def test_tokens():
    assert tokenize("The dog's WI-FI 漢字かな") == ["the", "dog", "wi", "fi", "漢", "字", "か", "な"]
    assert query_term("the") is None and query_term("Dogs,cats") == "dogs"
