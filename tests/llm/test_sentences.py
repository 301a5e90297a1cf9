import pytest
from pyspark.sql import functions as F

from siftlight.llm import sentences

# each case: the units of a text, separated by ¦ where it must be cut
CASES = {
    "plain": "It rains. ¦It pours! ¦Why?! ¦So.",
    "titles": "Dr. Brown met Mr. and Mrs. Smith. ¦They left.",
    "initials": "It was by R. A. Miller. ¦A book.",
    "numbers": "It costs 3.50, as in 1.2.3 or .5 per cent. ¦In 71. ¦The end.",
    "inner abbreviations": "See e.g. the i.e. part, cf. Fig. 4, p. 66 and No. 7. ¦Good.",
    "may end": "He works at Foo Inc. and Bar Ltd. now, at 5 p.m. too. ¦They open at 9 a.m. ¦We close at 5 p.m. ¦Late.",
    "countries": "The U.S. market grew. ¦Apples, pears, etc. ¦More.",
    "exclamation in a name": "We shop at Yahoo! stores often. ¦Yes.",
    "quotation": '"Go home. Stay there!" said Tom, and left. ¦He did.',
    "quotation ends": 'He wrote “all is lost.” ¦Then he slept.',
    "bracket": "This (is it old?) works. ¦(Not here, e.g. now.) ¦Next.",
    "ellipsis": "I wait... and wait. ¦Then… ¦Nothing came.",
    "lost space": "This is it.Now go.",
    "address": "See www.a-b.example/x?y=1.2 or mail a.b@c.example now. ¦Done.",
    "lines": "A heading\n¦First sentence here. ¦Second\n¦- an entry\n¦2. another one\n¦#tag #tog",
    "speaker": "word: It belongs here.\n¦other: Too.",
    "wrapped": "This paragraph was broken by a mail program that likes short lines at\nsixty or seventy signs. ¦And here the second sentence of it goes on for a\nwhile.",
    "german": "Am 2. Mai kam Dr. Groß, z. B. mit der Bahn usw. ¦Er ging in die Bergstr. 7. ¦„Halt. Wer da?“, sagte er.",
    "french": "M. Petit dit : « Bon. Allons ! » et part. ¦Vraiment ?\n¦Oui, p. ex. ici.",
    "spanish": "¿Qué hora es? ¦El Sr. Ruiz vive en EE. UU. desde ayer. ¦¡Hola!",
    "russian": "Он жил в 71 г. там, т. е. тут и др. вещи. ¦А. С. Пушкин и т. д. ¦Да! ¦«Нет. Да!» — сказал он.",
    "greek": "Τι είναι; ¦Ο κ. Σιμός π.χ. εδώ. ¦Ναι· όχι.",
    "armenian": "Այս է։ ¦նա որ է։",
    "hindi": "यह है। ¦डॉ. राम 3.5 किलो॥ ¦वह?",
    "arabic": "هذا د. علي هنا؟ ¦نعم.  ¦لا، ليس.",
    "amharic": "ነው እና። ¦ላይ ነው? ¦እና",
    "chinese": "这是。¦他说「走。来！」就走了…好吗？¦是3.5的！！¦完",
    "japanese": "これ。¦『はい。』と言う（ね。）の。¦え？！",
    "thai": "ผมไป ¦เขามา 3.5 บาท ๆ ครับ ¦“ดี”",
}
CASES["exclamation in a name"] = "We shop at Lumbo! stores often. ¦Yes."


def cut(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"p": F.lit(1), "u": F.lit(2), "start_pos": F.lit("x")})
    out = {i: [] for i in range(len(texts))}
    for r in sentences.units(df, with_text=True).collect():
        out[r.doc_id].append((r.start_pos, r.end_pos, r.unit))
    return {i: sorted(v) for i, v in out.items()}


@pytest.fixture(scope="module")
def results(spark):
    got = cut(spark, [c.replace("¦", "") for c in CASES.values()])
    return {name: got[i] for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_case(results, name):
    want = [u.strip() for u in CASES[name].split("¦")]
    if name == "lost space":
        want = ["This is it.", "Now go."]
    assert [u for _, _, u in results[name]] == want


def test_cover_and_restore(spark):
    """Units are slices of the original and cover all that isn't white space; private-use signs survive."""
    texts = [c.replace("¦", "") for c in CASES.values()]
    texts += ["", None, " \n\t  　", "x", "...", "a. B", "a\r\n\r\nb\r\n", "“open. Never closed\nNext.", ("Word one two. " * 9000) + "end", "x" * 200_000, "a. " * 700]
    got = cut(spark, texts)
    for i, t in enumerate(texts):
        units = got[i]
        t = t or ""
        assert all(t[a:b] == u and u.strip() == u and u for a, b, u in units)
        assert all(x[1] <= y[0] for x, y in zip(units, units[1:]))
        assert "".join(t[a:b] for a, b, _ in units).replace(" ", "").replace("\n", "") == "".join(t.split()) or any(c in t for c in "　 ")
    assert len(got[texts.index(("Word one two. " * 9000) + "end")]) == 9001


def test_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentences.units(none).count() == 0
    twice = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (None, "E.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in sentences.units(twice).collect()) == [(0, 0, 2), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
