import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlight.llm import stuffing

FUNCTION = "the of and to in is that it for was on with as".split()


def prose(rnd, words=150):
    out = []
    while len(out) < words:
        n = rnd.randint(6, 16)
        s = [rnd.choice(FUNCTION) if rnd.random() < 0.45 else "w" + "".join(rnd.choice("aeioubdgklmnprst") for _ in range(rnd.randint(4, 9))) for _ in range(n)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + rnd.choice("....?!")]
    return " ".join(out)


def keywords(rnd):
    mod = ["best", "cheap", "buy", "online", "deals"]
    return ", ".join(f"{rnd.choice(mod)} golden widget" if rnd.random() < 0.6 else f"golden widget {rnd.choice(mod)}" for _ in range(50))


def threaded(rnd):
    return " ".join(f"{rnd.choice(FUNCTION)} golden widget set {rnd.choice(FUNCTION)} cheap golden widget set." for _ in range(25)).capitalize()


def links(rnd):
    return "\n".join(f"* {prose(rnd, 3)[:12]} - http://www.site{rnd.randint(1, 99)}.example/p/{i}" for i in range(40))


def tags(rnd):
    return " ".join("#" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60))


def goods(rnd):
    return "\n".join(f"AB-{rnd.randint(100, 999)} widget{i}, thing{i} x{i} [blue{i}] {i}.99" for i in range(40))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    rows, cases = [], set()
    for i in range(400):
        steps = "\n".join(f"{n}. {prose(rnd, 12)}" for n in range(1, 6))  # prose pages have lists too
        rows.append((i, "en", prose(rnd) if i % 4 else f"{prose(rnd, 80)}\n\n{steps}\n{prose(rnd, 60)}", rnd.choice([80, 90, None, 10])))
    for k, make in enumerate((keywords, threaded, links, tags, goods)):
        for j in range(6):
            i = 1000 + 10 * k + j
            cases.add(i)
            rows.append((i, "en", make(rnd), rnd.choice([5, 20, None, 85])))
    rows.append((2000, "en", "Home | News | About\n\n" + prose(rnd, 120), 10))  # a navigation line
    rows.append((2001, "en", prose(rnd, 150) + "\n" + "\n".join(links(rnd).split("\n")[:4]), 10))  # a short link list
    rows.append((2002, "en", "\n".join(f"{n}. {prose(rnd, 12)}" for n in range(1, 12)), 10))  # numbered steps
    rows += [(2003, None, None, 5), (2004, "en", "", 5), (2005, None, "  ", 5), (2006, "en", "word", 5)]
    return rows, cases


def frames(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string").withColumns({"seq": F.lit(1), "good": F.lit("x"), "words": F.lit(1)})
    scores = spark.createDataFrame([(r[0], r[3]) for r in rows] * 2 + [(None, 1)], "doc_id long, spam_score int").withColumn("score", F.lit("x"))
    return docs, scores


def test_kinds_are_found(spark, corpus):
    rows, cases = corpus
    got = {r.doc_id for r in stuffing.stuffed_pages(*frames(spark, rows)).collect()}
    assert len(got & cases) >= 29
    assert not got & {2000, 2001, 2002, 2003, 2004, 2005, 2006}
    assert len(got - cases) <= 2


def test_more_than_half_decides(spark, corpus):
    rnd = random.Random(9)
    rows, _ = corpus
    mixed = [(3000, "en", prose(rnd, 300) + "\n\n" + keywords(rnd), 50), (3001, "en", prose(rnd, 40) + "\n\n" + keywords(rnd), 50)]
    got = {r.doc_id for r in stuffing.stuffed_pages(*frames(spark, rows + mixed)).collect()}
    assert 3001 in got and 3000 not in got


@pytest.mark.parametrize("n", [0, 1])
def test_almost_nothing(spark, n):
    rows = [(1, "en", "Only one page with a few words in it. It says nothing.", None)][:n]
    assert stuffing.stuffed_pages(*frames(spark, rows)).count() == 0


def test_blocks():
    rnd = random.Random(1)
    functions = frozenset(FUNCTION)
    texts = [prose(rnd, 500), keywords(rnd), "word", "word. " * 30, "w " * 1000, ""]
    for text, (seq, scripts) in zip(texts, stuffing.encoded(texts, stuffing._Vocabulary(functions))):
        seq = np.frombuffer(seq, np.uint8)
        first = np.flatnonzero(seq & stuffing.FIRST)
        assert len(scripts) == len(first)
        if not text:
            assert not len(seq)
            continue
        assert first[0] == 0
        words = np.add.reduceat(stuffing._IS_WORD[seq & stuffing._CLASS].astype(int), first)
        assert words.sum() == len(text.replace(",", " ").split())
        assert (words <= 3 * stuffing.BLOCK).all()


def test_portions_change_nothing(monkeypatch):
    rnd = random.Random(2)
    texts = [prose(rnd, 200) + "\n" + keywords(rnd) for _ in range(20)]
    functions = frozenset(FUNCTION)
    whole = stuffing.encoded(texts, stuffing._Vocabulary(functions))
    monkeypatch.setattr(stuffing, "PART", max(map(len, texts)))
    monkeypatch.setattr(stuffing, "_REMEMBERED", 50)
    assert stuffing.encoded(texts, stuffing._Vocabulary(functions)) == whole
    monkeypatch.setattr(stuffing, "PART", 300)  # now texts are cut, but nothing is lost
    for (seq, _), (cut, _) in zip(whole, stuffing.encoded(texts, stuffing._Vocabulary(functions))):
        assert len(seq) == len(cut)


#: Signs of invented words, function words, what stands between words, the end of a sentence, and a pause.
WORLDS = {
    "zh": ([chr(0x5000 + 7 * i) for i in range(900)], "的 是 在 了 和 有 不 这".split(), "", "。", "，"),
    "ja": ([chr(0x6000 + 11 * i) for i in range(300)] + [chr(i) for i in range(0x30A2, 0x30ED)], "の は が を に で と も".split(), "", "。", "、"),
    "th": ([c + v + z for c in "กขคดตนบปพมยรลวสห" for v in "าิีุู" for z in ("", "น", "ง", "ก")], "ที่ และ ใน มี เป็น ได้ จะ".split(), "", " ", " "),
    "el": ("αβγδεζηθικλμνξοπρστυφχψω", "και το του να η που της με".split(), " ", ".", ","),
    "ru": ("абвгдежзиклмнопрстуфхцчш", "и в на не что он с как".split(), " ", ".", ","),
    "ar": ("ابتثجحخدذرزسشصضطظعغفقكلم", "في من على إلى أن هذا التي مع".split(), " ", ".", "،"),
    "hi": ("कखगघचछजझटठडढतथदधनपफबभमय", "के है में की और को का से".split(), " ", "।", ","),
}


def world(lang, seed):
    """Texts of a language: prose, and the kinds of stuffing and of harmless lists."""
    rnd = random.Random(seed)
    signs, function, gap, end, pause = WORLDS[lang]
    spaced = gap == " "
    vocabulary = ["".join(rnd.choice(signs) for _ in range(rnd.randint(4, 8) if spaced else rnd.randint(1, 3))) for _ in range(2500)]
    often = 0.4  # how often a function word comes, from page to page

    def word():
        return rnd.choice(vocabulary)

    def sentence():
        out = []
        for _ in range(rnd.randint(4, 18)):
            out.append(rnd.choice(function) if rnd.random() < often else word())
            if rnd.random() < 0.1:
                out[-1] += pause
        return gap.join(out) + end

    def running(n):
        nonlocal often
        often = rnd.uniform(0.25, 0.55)
        return (" " if spaced else "").join(sentence() for _ in range(n))

    def theme():
        return "".join(rnd.choice(signs) for _ in range(6 if spaced else 4))

    def bare():
        key, beside = theme(), [word() for _ in range(6)]
        return (" " if spaced else "").join((gap or "").join(rnd.choice([[key, b], [b, key], [b, c, key]])) + end for b, c in (rnd.sample(beside, 2) for _ in range(60)))

    def listed(mark):
        return "\n".join(mark.join(word() for _ in range(12)) for _ in range(8))

    def commas():
        key = theme()
        return ", ".join(f"{key} {word()}{word()}" for _ in range(60))

    def threaded():
        key, beside = theme(), [word() for _ in range(5)]
        return (" " if spaced else "").join(gap.join([rnd.choice(function), key, rnd.choice(function), rnd.choice(beside), key]) + end for _ in range(50))

    def links():
        return "\n".join(rnd.choice([f"* {word()} - http://www.place{i}.example/p/{i}", f"[{word()}](blog.place{i}.test/q)", f"- {word()}"]) for i in range(40))

    stuffed = {"bare": bare, "dots": lambda: listed(" · "), "bars": lambda: listed(" | "), "tabs": lambda: listed("\t"), "commas": commas, "threaded": threaded, "links": links}
    harmless = {
        "prose": lambda: running(16),
        "navigation": lambda: " > ".join(word() for _ in range(6)) + "\n\n" + running(12),
        "steps": lambda: "\n".join(f"{i}. {sentence()}" for i in range(1, 13)),
        "glossary": lambda: "\n".join(f"{word()}: {sentence()}" for _ in range(12)),
        "links under a text": lambda: running(16) + "\n" + "\n".join(f"- [{word()}](www.place{i}.test)" for i in range(4)),
    }
    return stuffed, harmless


def test_every_script(spark):
    """Planted pages of seven scripts: at least nine tenths of the cases of each are found, and hardly a harmless page."""
    rows, cases, plain = [], {}, {}
    for k, lang in enumerate(WORLDS):
        stuffed, harmless = world(lang, k)
        for i in range(150):
            rows.append((100_000 * k + i, lang, harmless[list(harmless)[i % 5] if i % 3 == 0 else "prose"](), 80))
        for kind in (stuffed, harmless):
            for j, (name, make) in enumerate(kind.items()):
                for i in range(6):
                    doc = 100_000 * k + (10_000 if kind is stuffed else 20_000) + 100 * j + i
                    rows.append((doc, lang, make(), 10))
                    (cases if kind is stuffed else plain).setdefault(lang, {})[doc] = name
    got = {r.doc_id for r in stuffing.stuffed_pages(*frames(spark, rows)).collect()}
    for lang in WORLDS:
        missed = [name for doc, name in cases[lang].items() if doc not in got]
        wrong = [name for doc, name in plain[lang].items() if doc in got]
        assert len(missed) <= 0.1 * len(cases[lang]), (lang, missed)
        assert len(wrong) <= 1, (lang, wrong)


def test_a_rare_language_is_measured_like_others(spark, corpus):
    """A language with a few pages has neither function words nor a model; links of it are found all the same."""
    stuffed, _ = world("hi", 4)
    rows = [(7000 + i, "hi", stuffed["links"](), None) for i in range(2)]
    got = {r.doc_id for r in stuffing.stuffed_pages(*frames(spark, corpus[0] + rows)).collect()}
    assert {7000, 7001} <= got
