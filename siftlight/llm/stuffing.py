"""Pages made of stuffed keywords, link lists or tags, found by the perplexity of their word classes.

A page becomes a sequence of classes: function words, other words (new, or seen again a little later),
numbers, addresses, tags, codes, end marks, separators, brackets, line ends, bullets. A trigram model of
these classes is trained for every script on the running prose of well-scored pages. Text that is not made
of sentences has an unusually high perplexity under its script's model, or an unusually low one; a page is
a case if more than half of its words stand in such blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlight.scratch import materialize

CLASSES = "function new again number address tag code end comma separator bracket line bullet space".split()
(FUNCTION, NEW, AGAIN, NUMBER, ADDRESS, TAG, CODE, END, COMMA, SEPARATOR, BRACKET, LINE, BULLET, SPACE) = range(14)
V = len(CLASSES)
_IS_WORD = np.isin(np.arange(V), (FUNCTION, NEW, AGAIN, NUMBER, ADDRESS, TAG, CODE))

#: Scripts with the first and last sign of their Unicode range.
SCRIPTS = {
    "latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "armenian": (0x530, 0x58F),
    "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F),
    "hangul": (0xAC00, 0xD7AF), "ethiopic": (0x1200, 0x139F), "kana": (0x3040, 0x30FF), "han": (0x3400, 0x9FFF),
}
_NAMES = [*SCRIPTS, "other"]
S = len(_NAMES)
_THAI, _KANA, _HAN = (_NAMES.index(x) for x in ("thai", "kana", "han"))
_NO_SCRIPT = 255

#: A byte of a sequence: the class, and marks for a unit that counts half a word (a sign or syllable of a
#: script without word spaces), for text that may train the model, and for the start of a block.
_CLASS, HALF, PLAIN, FIRST = 0x0F, 0x10, 0x40, 0x80

#: Words of a block at least; it ends with the line or sentence, a long one after twice as many.
BLOCK = 24
#: A function word makes up this share of its language's words, and stands in this share of its pages and
#: MORE_PAGES more, so that a few pages of a language don't make all their words function words.
SHARE_OF_WORDS, SHARE_OF_PAGES, MORE_PAGES = 0.004, 0.1, 3
#: Stored score from which a page's prose trains the model.
GOOD_SCORE = 50
#: Robust deviations from the prose's median at which perplexity is abnormal.
DEVIATIONS = 4.0
#: Bits a class that a deviation is at least, for prose of one even style.
LEAST_DEVIATION = 0.1
#: Pages with fewer words than this say too little.
LEAST_WORDS = 8
#: Words, or signs of scripts without word spaces, within which a word counts as seen again, and a run of
#: two words (three kana).
NEAR, NEAR_SIGNS, RUN, RUN_SIGNS = 10, 16, 24, 48
#: Blocks of prose whose weight a script's own limits have against those of all scripts; trigrams and pairs
#: likewise.
_OWN_BLOCKS, _SMOOTH, _OWN_PAIRS = 20, 5.0, 200.0
#: Bits are counted in steps of this size for the medians.
_STEP = 1 / 256
#: Characters that are worked on at once; a longer text is cut at a line or a blank.
PART = 1_000_000
#: Words that a task remembers.
_REMEMBERED = 300_000

_CJK = "぀-ヿ㐀-鿿"
_TH = "฀-๿"
_ADDRESS = r"https?://\S+|www\.\S+|[A-Za-z0-9_-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|edu|gov|info|test|example)\b\S*"
#: A Thai syllable: a vowel written first, a consonant with its signs, and a consonant that ends it.
_SYLLABLE = "[เแโใไ]?[ก-ฮ][ะ-ฺ็-๎]*(?:[ก-ฮ](?![ะ-ฺ็-๎]))?"
_LETTERS = rf"[^\W\d_{_TH}{_CJK}](?:[^\W_{_TH}{_CJK}]|['’̀-ͯऀ-ॣ०-ॿ])*"
_ENDS, _COMMAS, _MARKS, _BRACKETS = ".!?。！？।॥։።؟…", ",;:،؛、，；：", "|·>\t=*•–—+/～-", "()[]（）「」『』“”\"«»"
_TOKEN = re.compile(
    rf"{_ADDRESS}|#[^\s#]+|[{_CJK}]|{_SYLLABLE}|\d[\d.,:/-]*|{_LETTERS}|\n\s*(?:[-*•] )?"
    rf"|(?<=[{_TH}{_CJK}]) +(?=[{_TH}{_CJK}])|[{re.escape(_ENDS)}]+|[{re.escape(_COMMAS + _MARKS + _BRACKETS)}]"
)
_WORDS = re.compile(rf"[{_CJK}]|{_SYLLABLE}|{_LETTERS}")
_ONE_ADDRESS = re.compile(_ADDRESS)


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text: Han and kana signs and Thai syllables one by one, addresses left out."""
    return _WORDS.findall(_ONE_ADDRESS.sub(" ", text).lower())


def _script(sign: str) -> int:
    at = ord(sign)
    return next((i for i, (a, z) in enumerate(SCRIPTS.values()) if a <= at <= z), S - 1)


class _Vocabulary(dict):
    """Numbers of tokens, with the class and script of each; words in any case have one number."""

    def __init__(self, functions: frozenset[str]):
        self.functions = functions
        self.kinds: list[int] = []
        self.scripts: list[int] = []

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if low != token:
            number = self[low]
        else:
            number = len(self.kinds)
            kind, script = self._kind(token)
            self.kinds.append(kind)
            self.scripts.append(script)
        self[token] = number
        return number

    def _kind(self, token: str) -> tuple[int, int]:
        c = token[0]
        if c == "\n":
            return (BULLET if token.rstrip(" ")[-1] in "-*•" else LINE), _NO_SCRIPT
        if c == " ":
            return SPACE, _NO_SCRIPT
        if len(token) > 2 and _ONE_ADDRESS.match(token):
            return ADDRESS, _NO_SCRIPT
        if c == "#":
            return TAG, _NO_SCRIPT
        if c.isdigit():
            return NUMBER, _NO_SCRIPT
        for marks, kind in ((_ENDS, END), (_COMMAS, COMMA), (_MARKS, SEPARATOR), (_BRACKETS, BRACKET)):
            if c in marks:
                return kind, _NO_SCRIPT
        if token in self.functions:
            return FUNCTION, _script(c)
        return (CODE if any(x.isdigit() for x in token) else NEW), _script(c)


def _distance(key: np.ndarray) -> np.ndarray:
    """How many places back the same key stood before; a large number where it didn't."""
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    far = np.full(len(key), 1 << 30)
    far[order[same + 1]] = order[same + 1] - order[same]
    return far


def _seen_again(page: np.ndarray, word: np.ndarray, script: np.ndarray, function: np.ndarray) -> np.ndarray:
    """Which words of all pages came a little before: by themselves, or as the end of a run of words."""
    signs = (script == _KANA) | (script == _HAN) | (script == _THAI)
    size = np.int64(word.max(initial=0) + 2)
    own = page * size + word
    again = ~function & (_distance(own) <= np.where(signs, NEAR_SIGNS, NEAR))
    begins = np.append(True, page[1:] != page[:-1])[: len(page)]
    one = np.where(begins, -1, np.roll(word, 1))
    two = np.where(begins, -1, np.roll(one, 1))
    run = own * np.int64(1_000_003) + one
    run = np.where(script == _KANA, run * np.int64(1_000_033) + two, run)
    # two function words in a row say nothing
    counts = (one >= 0) & (signs | ~(function & np.roll(function, 1)))
    return again | (counts & (_distance(run) <= np.where(signs, RUN_SIGNS, RUN)))


def _encode(texts: Sequence[str], vocabulary: _Vocabulary) -> list[tuple[bytes, bytes]]:
    """(sequence, script of each block) of every text; see ``sequences``."""
    tokens = [_TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    total = int(sizes.sum())
    if not total:
        return [(b"", b"")] * len(texts)
    ids = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(tokens)), np.int64, total)
    classes = np.array(vocabulary.kinds, np.uint8)[ids]
    scripts = np.array(vocabulary.scripts, np.uint8)[ids]
    page = np.repeat(np.arange(len(texts)), sizes)
    opens = np.append(True, page[1:] != page[:-1])

    at = np.flatnonzero(scripts != _NO_SCRIPT)
    script = scripts[at].astype(np.int64)
    again = _seen_again(page[at], ids[at], script, classes[at] == FUNCTION)
    classes[at[again]] = AGAIN
    half = np.zeros(total, bool)
    half[at] = (script == _KANA) | (script == _HAN) | (script == _THAI)
    weight = np.where(_IS_WORD[classes], np.where(half, 1, 2), 0)

    # lines of separated words, links or bullets are blocks of their own
    line = np.cumsum(opens | (classes == LINE) | (classes == BULLET)) - 1
    strong = np.bincount(line, np.isin(classes, (ADDRESS, TAG, BULLET)))
    marks = np.bincount(line, classes == SEPARATOR) + strong
    listed = ((6 * marks >= np.bincount(line, weight)) & ((marks >= 2) | (strong > 0)))[line]
    ends = (classes == LINE) | (classes == END) | (classes == BULLET)
    sentence_opens = opens | np.append(False, ends[:-1])
    sentence = np.cumsum(sentence_opens) - 1
    plain = ~listed & (np.bincount(sentence, classes == SEPARATOR) < 2)[sentence]

    # a block holds the sentences that begin within so many words of the page
    so_far = np.cumsum(weight) - weight
    before = so_far - so_far[opens][np.cumsum(opens) - 1]
    begin = before[sentence_opens][sentence]
    flip = np.append(False, listed[1:] != listed[:-1])
    first = opens | flip
    for part in (begin // (2 * BLOCK), (before - begin) // (4 * BLOCK)):
        first |= np.append(False, part[1:] != part[:-1])
    starts = np.flatnonzero(first)
    short = np.add.reduceat(weight, starts) < BLOCK
    first[starts[short & ~opens[starts] & ~flip[starts]]] = False
    starts = np.flatnonzero(first)

    block = np.cumsum(first) - 1
    held = np.bincount(block[at] * S + script, minlength=len(starts) * S).reshape(-1, S)
    most = held.argmax(1)
    signs = held[:, _KANA] + held[:, _HAN]
    most = np.where((most == _KANA) | (most == _HAN), np.where(5 * held[:, _KANA] > signs, _KANA, _HAN), most)

    out = (classes | half * np.uint8(HALF) | plain * np.uint8(PLAIN) | first * np.uint8(FIRST)).astype(np.uint8).tobytes()
    of_block = most.astype(np.uint8).tobytes()
    edges = np.append(0, np.cumsum(sizes))
    blocks = np.searchsorted(starts, edges)
    return [(out[edges[i] : edges[i + 1]], of_block[blocks[i] : blocks[i + 1]]) for i in range(len(texts))]


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART:
        # at a line, else at a blank, else anywhere
        cuts = (text.rfind(c, start + 1, start + PART) for c in "\n ")
        cut = next((c for c in cuts if c > start), start + PART)
        yield text[start:cut]
        start = cut
    yield text[start:]


def encoded(texts: Sequence[str], vocabulary: _Vocabulary) -> list[tuple[bytes, bytes]]:
    """``_encode`` in portions of about PART characters, so that memory doesn't grow with the texts."""
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in texts]
    portion: list[tuple[int, str]] = []

    def flush() -> None:
        for (i, _), got in zip(portion, _encode([p for _, p in portion], vocabulary)):
            out[i].append(got)
        portion.clear()
        if len(vocabulary) > _REMEMBERED:
            vocabulary.clear()
            vocabulary.kinds.clear()
            vocabulary.scripts.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in _parts(text):
            portion.append((i, part))
            size += len(part)
            if size >= PART:
                flush()
                size = 0
    flush()
    return [(b"".join(s for s, _ in x), b"".join(b for _, b in x)) for x in out]


#: What is counted in a block: a column of each class.
_COUNTED = np.zeros((V, 6), np.int64)
_COUNTED[_IS_WORD, 0] = 1
_COUNTED[END, 1] = 1
_COUNTED[AGAIN, 2] = 1
_COUNTED[FUNCTION, 3] = 1
_COUNTED[[ADDRESS, TAG], 4] = (1, 2)
_COUNTED[SEPARATOR, 5] = 1


@dataclass(frozen=True)
class _Blocks:
    """All blocks of the pages of a batch; ``page`` is the number of a block's page, ``words`` are half words."""

    page: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    trigrams: np.ndarray
    trains: np.ndarray
    script: np.ndarray
    words: np.ndarray
    prose: np.ndarray


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(seqs: pa.BinaryArray, scripts: pa.BinaryArray) -> _Blocks | None:
    """The blocks of a column of sequences, worked out for all pages at once; None without any token.

    ``trigrams`` are numbered with the script first. Prose has function words, ends of sentences (Thai has
    none), few words seen again and few separators.
    """
    raw, offsets = _bytes(seqs)
    if not len(raw):
        return None
    begins = offsets[:-1][np.diff(offsets) > 0]
    seq = (raw & _CLASS).astype(np.int64)
    opens = np.zeros(len(seq), bool)
    opens[begins] = True
    one = np.where(opens, LINE, np.roll(seq, 1))
    two = np.where(opens, LINE, np.roll(one, 1))
    starts = np.flatnonzero(raw & FIRST)
    script = _bytes(scripts)[0].astype(np.int64)
    tokens = np.diff(np.append(starts, len(seq)))
    words, ends, again, functions, listed, marks = np.add.reduceat(_COUNTED[seq], starts, axis=0).T
    halves = np.add.reduceat(_IS_WORD[seq] * np.where(raw & HALF, 1, 2), starts)
    running = (listed <= 1) & (12 * marks <= words) & (5 * again <= words)
    sentences = (functions >= 0.15 * words) & ((script == _THAI) | (ends >= 1))
    prose = (halves >= BLOCK) & running & sentences
    page = np.searchsorted(offsets, starts, side="right") - 1
    trigrams = ((np.repeat(script, tokens) * V + two) * V + one) * V + seq
    return _Blocks(page, starts, tokens, trigrams, (raw & PLAIN) > 0, script, halves, prose)


def _language() -> Column:
    """The first two letters of the label, empty where it doesn't begin with two."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^[a-z]{2}", 0)


def function_words(docs: DataFrame) -> frozenset[str]:
    """The function words of all languages of (lang, text), counted over all pages.

    The result is bounded: a language has at most 1 / SHARE_OF_WORDS of them, and there are at most 26 ** 2
    labels of two letters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n, pages[w]) for lang, (occ, pages) in held.items() for w, n in occ.items()]
            held.clear()
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["lang", "word", "n", "pages"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                occ, pages = held.setdefault(lang, (Counter(), Counter()))
                words = words_of(text)
                occ.update(words)
                pages.update(set(words))
                occ[""] += len(words)
                pages[""] += 1
            if sum(len(o) for o, _ in held.values()) > _REMEMBERED:
                yield flush()
        yield flush()

    plain = docs.where(F.col("text").isNotNull()).select(_language().alias("lang"), "text")
    counts = plain.mapInArrow(count, "lang string, word string, n long, pages long")
    counts = materialize(counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")), "words")
    totals = counts.where("word = ''").select("lang", F.col("n").alias("all"), F.col("pages").alias("of"))
    rows = counts.where("word <> ''").join(F.broadcast(totals), "lang")  # a row per label of two letters
    often = F.col("n") >= SHARE_OF_WORDS * F.col("all")
    widely = F.col("pages") >= SHARE_OF_PAGES * F.col("of") + MORE_PAGES
    return frozenset(r["word"] for r in rows.where(often & widely).select("word").distinct().collect())


def sequences(docs: DataFrame, functions: frozenset[str]) -> DataFrame:
    """(doc_id, seq, scripts): of every page with a text its classes, a byte each, and the script of each block.

    A block has the sentences and lines that begin within BLOCK words; a sentence longer than two blocks is
    divided, a rest of less than half a block belongs to the block before. Lines that are divided by
    separators, or that are links or bullets of a few words, are blocks apart from the text around them.
    Signs of scripts without word spaces count as half words.
    """

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(functions)
        for batch in batches:
            got = encoded(batch.column("text").to_pylist(), vocabulary)
            columns = [pa.array([x[k] for x in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "seq", "scripts"])

    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(classify, "doc_id long, seq binary, scripts binary")


def train(seqs: DataFrame) -> np.ndarray:
    """-log2 P(class | two classes before) of each script, from the running text in prose blocks of (seq, scripts).

    A script's trigrams back off to its pairs and to the trigrams of all scripts, so that a script with
    little prose has nearly the model of all.
    """
    size = S * V**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            b = _blocks(batch.column("seq"), batch.column("scripts"))
            if b is not None:
                total += np.bincount(b.trigrams[np.repeat(b.prose, b.tokens) & b.trains], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = seqs.select("seq", "scripts").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(size)
    for r in rows.collect():  # S * V ** 3 rows at most
        counts[r["at"]] = r["n"]
    counts = counts.reshape(S, V, V, V)
    whole = counts.sum(0)
    ones = (whole.sum((0, 1)) + 1) / (whole.sum() + V)
    pairs = (whole.sum(0) + _SMOOTH * ones) / (whole.sum((0, 2))[:, None] + _SMOOTH)
    triples = (whole + _SMOOTH * pairs) / (whole.sum(2, keepdims=True) + _SMOOTH)
    own_pairs = (counts.sum(1) + _OWN_PAIRS * pairs) / (counts.sum((1, 3))[..., None] + _OWN_PAIRS)
    own = (counts + _SMOOTH * (own_pairs[:, None] + triples)) / (counts.sum(3, keepdims=True) + 2 * _SMOOTH)
    return -np.log2(own).ravel()


_STRUCT = "struct<bits: double, words: long, script: int, prose: boolean>"


def scored(seqs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, good, blocks) of (doc_id, good, seq, scripts): mean bits, half words, script and kind of every block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _blocks(batch.column("seq"), batch.column("scripts"))
            n = len(batch)
            if b is None:
                ends, cols = np.zeros(n + 1, np.int32), [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)]
            else:
                ends = np.append(0, np.cumsum(np.bincount(b.page, minlength=n))).astype(np.int32)
                cols = [np.add.reduceat(bits[b.trigrams], b.starts) / b.tokens, b.words, b.script.astype(np.int32), b.prose]
            each = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=["bits", "words", "script", "prose"])
            lists = pa.ListArray.from_arrays(pa.array(ends), each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), lists], names=["doc_id", "good", "blocks"])

    return seqs.select("doc_id", "good", "seq", "scripts").mapInArrow(score, f"doc_id long, good boolean, blocks array<{_STRUCT}>")


def _edges(counts: np.ndarray) -> tuple[float, float]:
    """Lowest and highest usual bits, from counts of bits in steps: the median, and the medians on either side of it."""

    def middle(c: np.ndarray) -> int:
        return int(np.searchsorted(np.cumsum(c), c.sum() / 2)) if c.sum() else 0

    m = middle(counts)
    below, above = (max(1.4826 * (middle(c) + 1) * _STEP, LEAST_DEVIATION) for c in (counts[:m][::-1], counts[m + 1 :]))
    return m * _STEP - DEVIATIONS * below, (m + 1) * _STEP + DEVIATIONS * above


def limits(pages: DataFrame) -> list[tuple[float, float]]:
    """Lowest and highest usual bits of a block of each script, from the prose of good pages.

    The deviations below and above the median are measured apart, so that both limits can be passed. The
    limits of a script with few blocks are drawn to those of all scripts.
    """
    each = pages.where("good").select(F.explode("blocks").alias("b")).select("b.*").where("prose")
    steps = each.groupBy("script", F.floor(F.col("bits") / _STEP).cast("int").alias("at")).agg(F.count("*").alias("n"))
    rows = steps.collect()  # the steps of each script
    if not rows:
        return [(-np.inf, np.inf)] * S
    counts = np.zeros((S, max(r["at"] for r in rows) + 1))
    for r in rows:
        counts[r["script"], r["at"]] = r["n"]
    low, high = _edges(counts.sum(0))
    out = []
    for own in counts:
        share = own.sum() / (own.sum() + _OWN_BLOCKS)
        a, z = _edges(own)
        out.append((share * a + (1 - share) * low, share * z + (1 - share) * high))
    return out


def stuffed_pages(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, words, abnormal): pages of which more than half of the words stand in abnormal blocks.

    ``docs`` is (doc_id, lang, text) with one row per page, ``scores`` (doc_id, spam_score), repeats and
    nulls allowed; a page's best score counts. Stored scores only choose the pages that train the model;
    where none reaches GOOD_SCORE all pages do. Null, empty and very short texts are no case; a sign of a
    script without word spaces counts as half a word. A language of which only MORE_PAGES pages or fewer
    are there has no function words of its own, and its script's prose, where there is no other, is
    measured with what all scripts have in common.

    The texts are read twice, for the function words and for the classes; what goes on is one byte a
    word. Counts are combined map-side, and what the driver gets is bounded: function words, S * V ** 3
    trigram counts, and the counts of bits in steps.
    """
    functions = function_words(docs)
    best = scores.where("doc_id is not null").groupBy("doc_id").agg(F.max("spam_score").alias("score"))
    seqs = sequences(docs, functions).join(best, "doc_id", "left")
    good = F.coalesce(F.col("score") >= GOOD_SCORE, F.lit(False))
    seqs = materialize(seqs.select("doc_id", good.alias("good"), "seq", "scripts"), "classes")
    if not seqs.where("good").limit(1).count():
        seqs = seqs.withColumn("good", F.lit(True))
    pages = materialize(scored(seqs, train(seqs.where("good"))), "blocks")
    usual = limits(pages)
    low, high = (F.array(*(F.lit(float(x[k])) for x in usual)) for k in (0, 1))

    def abnormal(b: Column) -> Column:
        return (b["bits"] < F.get(low, b["script"])) | (b["bits"] > F.get(high, b["script"]))

    zero = F.lit(0).cast("long")
    words = F.aggregate("blocks", zero, lambda n, b: n + b["words"])
    odd = F.aggregate(F.filter("blocks", abnormal), zero, lambda n, b: n + b["words"])
    rows = pages.select("doc_id", (words / 2).alias("words"), (odd / 2).alias("abnormal"))
    return rows.where((F.col("words") >= LEAST_WORDS) & (2 * F.col("abnormal") > F.col("words")))
