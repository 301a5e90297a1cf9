"""Sentence units of texts in any script, as SQL expressions.

Marks that end nothing are masked: every end mark inside an address, a number, an abbreviation, an
initial, a quotation or a bracket is exchanged for a private-use sign, and so is a line break inside a
running sentence. The masked text has the length of the original. Ends of sentences are then found with one
terminator pattern per kind of script, and the units are cut out of the original text, which restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use signs. Those that a text holds itself are exchanged for another one before.
_OWN = "[\ue000-\ue0ff]"
_OTHER = "\uf8ff"
_END, _OPEN, _CLOSE = "\ue010", "\ue020", "\ue021"
_MARKS = ".!?;…。！？।॥։።؟۔｡"
_MASKS = "".join(chr(0xE030 + i) for i in range(len(_MARKS)))
_DOT = _MASKS[0]
_GREEK_QUESTION = "\ue040"
_LF, _CR = "\ue00a", "\ue00d"

_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" + _LF + _CR
#: White space, including masked line breaks.
_W = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + _LF + _CR + "]"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_NO_WORD = r"(?<![\p{L}\p{M}\p{N}." + _DOT + "])"
_D = f"[.{_DOT}]"

# Abbreviations after which a sentence goes on; a blank stands for any white space.
_GOES_ON = (
    "Dr Mr Mrs Ms Prof St Rev Gen Sen Gov Capt Lt Col Hon Fig Figs vs ca cf approx resp e.g i.e "
    "Nr Hr bzw evtl ggf inkl vgl Abb Bd Kap Sr Sra Srta Dra Avda pág núm MM Mme Mlle av boul "
    "ул просп проф акад см рис стр κ κα δηλ σελ αρ π.χ λ.χ د أ डॉ श्री प्रो"
).split() + ["z. B", "d. h", "p. ej", "p. ex", "т. е"]
# Abbreviations that go on unless a new sentence visibly starts.
_MAY_END = "Co Inc Ltd Corp LLC Jr etc usw lb lbs oz ft др г гг руб тыс млн млрд κτλ κ.λπ κ.ά a.m p.m U.S U.K U.S.A".split() + ["т. д", "т. п", "EE. UU", "u. a"]


def _any_of(words: list[str]) -> str:
    return "|".join(w.replace(".", _D).replace(" ", _W + "?") for w in words)


#: A new sentence: an upper-case letter, a digit, or a sign that opens something, after white space.
_STARTS = r"\p{Lu}\p{Lt}\p{Nd}\"“„«‘(\[¿¡#"
_VISIBLE = rf"{_W}+[{_STARTS}]|[  ]*(?:\r?\n|$)"

# Every pattern starts with the dot itself, which is quick to look for; what it belongs to is looked at back.
#: Inside numbers, addresses and abbreviations of several parts: no white space follows.
_INNER_DOTS = r"\.(?=[\p{Nd}\p{Ll}])"
_OTHER_DOTS = "".join(
    (
        r"\.(?:",
        rf"(?<={_NO_WORD}(?:{_any_of(_GOES_ON)})\.)",
        # the first parts of those of several parts
        rf"|(?<={_NO_WORD}[zdpuтE]E?\.)(?={_W}(?:[BhадепR]|ej|ex|UU)\.)",
        rf"|(?<={_NO_WORD}(?:{_any_of(_MAY_END)})\.)(?!{_VISIBLE})",
        # initials
        rf"|(?<={_NO_WORD}\p{{Lu}}\.)(?={_W}?\p{{Lu}})",
        # before numbers: No. 5, p. 5, streets
        rf"|(?<=(?:{_NO_WORD}(?:Nos?|pp?)|\p{{L}}str)\.)(?={_W}*\p{{Nd}})",
        # ordinals and numbers of list entries
        rf"|(?<=\b(?i:im|am|vom|zum|ab|bis|seit){_W}\p{{Nd}}{{1,2}}\.)(?={_W}\p{{Lu}})",
        r"|(?<=(?:\n|^)[ \t]{0,8}\p{Nd}{1,3}\.)(?=[ \t])",
        ")",
    )
)

_Q = "[" + _MARKS + "]*"
_PAIRS = (
    ("\"", r"\"", r"[^\"\n]", r"\""),
    ("“", "“", "[^“”\n]", "”"),
    ("„", "„", "[^„“”\n]", "[“”]"),
    ("«", "«", "[^«»\n]", f"{_W}?»"),
    ("「", "「", "[^「」\n]", "」"),
    ("『", "『", "[^『』\n]", "』"),
    ("（", "（", "[^（）\n]", "）"),
    ("(", r"\(", r"[^()\n]", r"\)"),
)

#: Closing signs that belong to the mark before them.
_CLOSERS = r"(?:[ \u00a0\u202f]?»|[\"”“’')\]])+"
_THAI = "ก-ฺเ-ๅ็-๎"
_SURE = "؟۔।॥։።" + _GREEK_QUESTION

#: One pattern for scripts with white space between sentences, tried only where a mark stands.
_SPACED = (
    rf"([.!?…{_SURE}]+)(?:"
    # white space, then what may start a sentence in scripts with or without case
    rf"(?={_W}+[{_STARTS}\p{{Lo}}])"
    # after a closing sign only what certainly starts one
    rf"|({_CLOSERS})(?={_W}+[{_STARTS}])"
    # a single full stop that nothing has masked, or an unmistakable mark, ends before a small letter too
    rf"|(?<=[^.\s]\.|[{_SURE}])(?={_W}+\p{{Ll}})"
    # lost space
    r"|(?<=[\p{Ll}\p{M}][.!?]{1,3})(?=\p{Lu}\p{Ll})"
    rf"|(?<=[{_SURE}])(?=\p{{L}})"
    r"|(?<=[\p{Lo}\p{M}][.!?]{1,3})(?=[\p{Lo}&&[^" + _CJK + r"]])"
    r")"
)
#: Chinese and Japanese: at once, but not before a closing sign, which leads back into the sentence.
_IDEOGRAPHIC = "([。！？｡]+)(?![」』”’）)\\]】。！？｡])"
#: Thai: a space between letters.
_THAI_SPACE = rf"(?<=[{_THAI}])([ \u00a0\t\u3000]+)(?=[{_THAI}]|[\"“«‘「]\S)"

#: A line this long, with the word that follows, was broken to fit a width.
_WORD_LETTER = rf"[\p{{L}}\p{{M}}&&[^\p{{IsThai}}{_CJK}]]"
_LAST = rf"[\p{{L}}\p{{M}}\p{{N}},;\-\"”“»)%{_MASKS}]"
_LINE = "|".join(rf"[^\n]{{{a},{b}}}(?={_LAST}\r?\n\S{{{w}}})" for a, b, w in ((57, 110, 1), (53, 56, 5), (49, 52, 9), (43, 48, 13)))
_NO_START = r"(?![-*•#>\[|]|\p{Nd}{1,3}[.)" + _DOT + r"]|\S{1,40}[ \u00a0]?[:：]|https?:|www[.]|\S+[." + _DOT + r"][a-z]{2,}(?:/|\s|$))"
_LISTED = r"(?![ \t]*(?:[-*•#\[]|https?:|www\.))"
_WRAP = (
    # the line is long enough, and no longer than that
    rf"(?m)^(?=[^\n]{{43,111}}+\n){_LISTED}(?:"
    # before a small letter
    rf"((?:{_LINE}){_LAST})(?=\r?\n{_NO_START}\p{{Ll}})"
    # before another letter, digit or opening sign, if the line ends inside a sentence
    rf"|([^\n]{{55,78}}(?:[\p{{Ll}},]|[{_MASKS}]|{_WORD_LETTER}))(?=\r?\n{_NO_START}[\"“„«(]?(?:[\p{{Lu}}\p{{Nd}}]|{_WORD_LETTER}))"
    r")(\r?\n)"
)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; a plain expression would repeat it wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _where(text: Column, needs: str, change) -> Column:
    """``change(text)`` for texts that hold the string ``needs``, others as they are."""
    return _bound(text, lambda t: F.when(F.contains(t, F.lit(needs)), change(t)).otherwise(t))


def _exchanged(text: Column, pattern: str, shown: str, signs: str, others: str) -> Column:
    """``text`` with ``signs`` exchanged inside what ``shown`` puts between the two brackets.

    Bracketing and splitting gives parts that are outside and inside by turns.
    """
    parts = F.split(F.regexp_replace(text, pattern, shown), f"[{_OPEN}{_CLOSE}]", -1)
    inside = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, signs, others)).otherwise(p))
    return F.array_join(inside, "")


def _pair_masker(pattern: str):
    return lambda t: _exchanged(t, pattern, f"{_OPEN}$1{_CLOSE}$2", _MARKS, _MASKS)


def masked(text: Column) -> Column:
    """The text with marks and line breaks that end nothing exchanged, sign for sign."""
    t = F.regexp_replace(text, _OWN, _OTHER)
    t = F.regexp_replace(F.regexp_replace(t, _INNER_DOTS, _DOT), _OTHER_DOTS, _DOT)
    t = _where(t, ";", lambda x: F.regexp_replace(x, r";(?<=\p{IsGreek};)", _GREEK_QUESTION))
    t = _where(t, "\n", lambda x: _exchanged(x, _WRAP, f"$1$2{_OPEN}$3{_CLOSE}", "\r\n", _CR + _LF))
    for sign, opening, inside, closing in _PAIRS:
        t = _where(t, sign, _pair_masker(f"({opening}{inside}*?)({_Q}{closing})"))
    # in Chinese and Japanese an ellipsis ends nothing
    return _where(t, "…", lambda x: F.regexp_replace(x, rf"…(?:(?<=[{_CJK}…]{{1,3}}…)(?=[{_CJK}…]))", _MASKS[_MARKS.index("…")]))


def pieces(text: Column) -> Column:
    """Array of the parts between ends, white space included; their lengths add up to the text's."""
    t = F.regexp_replace(masked(text), _SPACED, f"$1$2{_END}")

    def ideographic(x: Column) -> Column:
        held = F.contains(x, F.lit("。")) | F.contains(x, F.lit("！")) | F.contains(x, F.lit("？")) | F.contains(x, F.lit("｡"))
        return F.when(held, F.regexp_replace(x, _IDEOGRAPHIC, f"$1{_END}")).otherwise(x)

    def thai(x: Column) -> Column:
        return F.when(F.regexp_like(x, F.lit("[ก-ฮ]")), F.regexp_replace(x, _THAI_SPACE, f"{_END}$1")).otherwise(x)

    t = _bound(_bound(t, ideographic), thai)
    return F.split(F.replace(t, F.lit("\n"), F.lit("\n" + _END)), _END, -1)


_BLOCK = 256


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in blocks, so that long texts don't take quadratic time."""

    def running(first: Column, xs: Column) -> Column:
        start = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, start, step, lambda s: s["out"])

    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, running(zero, sums), lambda b, first: running(first, b)))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, start_pos, end_pos[, unit]): the sentence units of every text.

    Offsets count code points from 0, the end exclusive; no unit starts or ends with white space, and all that isn't white space lies in a unit. A null, empty or blank text has none. Every row is
    worked on by itself: nothing is shuffled, and repeated rows give repeated units.
    """
    kept = [F.col(text).alias("text")] if with_text else []
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), *kept, pieces(F.col(text)).alias("p"))
    own = [c for c in rows.columns if c != "p"]
    lengths = rows.select(*own, "p", F.transform("p", lambda x: F.length(x).cast("long")).alias("n"))
    placed = lengths.select(*own, F.explode(F.arrays_zip(F.col("p"), _starts(F.col("n")).alias("at"))).alias("u"))
    part = F.col("u.p")
    bare = F.ltrim(part, F.lit(_SPACES))
    left = F.length(part) - F.length(bare)
    size = F.length(F.rtrim(bare, F.lit(_SPACES)))
    out = placed.select(*own, (F.col("u.at") + left).alias("start_pos"), (F.col("u.at") + left + size).alias("end_pos"))
    out = out.where("end_pos > start_pos")
    if with_text:
        return out.select("doc_id", "start_pos", "end_pos", F.substring("text", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int")).alias("unit"))
    return out.select("doc_id", "start_pos", "end_pos")
