"""Feedback over a table of rankings straight from the texts, without an index and without a shuffle of terms.

    counted    part, doc_id, len, ids, tfs    a row per page: its body's terms by their numbers in the part, with occurrences
               part, local, term, ctf         a row per term of a part
    terms      at, term, ctf                  all terms, sorted; ``at`` grows with the term
    numbers    part, nums, task               for each term of a part its number among all terms

Every text is read and analysed once. Terms are shuffled once per part of some thousand pages, not once per page, and
no page's terms are sent to a ranking: each task takes some rankings and reads one file of pages after the other from the
shared folder, so what is kept on disk doesn't grow with the number of rankings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions.analysis import DEFAULT, STOPWORDS
from siftlight.scratch import new_path, qualified
from siftlight.sources.asked import BATCH, binary, files, ints, sent, spans, within

#: Terms of a part, as many as two bytes can number; more occurrences in a page than ``MOST_TF`` are several entries.
PART_TERMS, MOST_TF = 1 << 16, 255
#: Parts of a task are numbered from its number times this.
TASK_PARTS = 1 << 20
#: Entries of a page's terms that a task holds on average, and entries of rankings that are summed up at once.
TASK_ENTRIES, CHUNK = 12_000_000, 500_000
#: Rankings that are sent back at once.
SENT = 2_000
_COUNTED = "part long, doc_id long, len int, ids binary, tfs binary, local int, term string, ctf long"
_SCHEMA = pa.schema(
    [("part", pa.int64()), ("doc_id", pa.int64()), ("len", pa.int32()), ("ids", pa.binary()), ("tfs", pa.binary()), ("local", pa.int32()), ("term", pa.string()), ("ctf", pa.int64())]
)


class _Part:
    """Pages that share numbers of terms."""

    def __init__(self, number: int):
        self.number, self.known, self.ctf = number, {}, np.zeros(PART_TERMS, np.int64)
        self.clear()

    def clear(self) -> None:
        self.docs, self.lens, self.sizes, self.ids, self.tfs = [], [], [], [], []

    def add(self, doc: int, counts: dict[str, int]) -> None:
        known = self.known
        self.docs.append(doc)
        self.lens.append(sum(counts.values()))
        self.sizes.append(len(counts))
        self.ids.extend([known.setdefault(w, len(known)) for w in counts])
        self.tfs.extend(counts.values())

    def pages(self) -> pa.RecordBatch:
        """The pages since the last call."""
        ids, tfs, n = np.array(self.ids, np.int64), np.array(self.tfs, np.int64), len(self.docs)
        self.ctf += np.bincount(ids, tfs, PART_TERMS).astype(np.int64)
        times = -(-tfs // MOST_TF)
        row = np.repeat(np.arange(n), self.sizes)
        at = spans(np.bincount(row, times, n).astype(np.int64))
        split = np.minimum(np.repeat(tfs, times) - MOST_TF * within(times), MOST_TF)
        own = [pa.array(np.full(n, self.number)), pa.array(self.docs, pa.int64()), pa.array(self.lens, pa.int32()), binary(np.repeat(ids, times), at, np.uint16), binary(split, at, np.uint8)]
        self.clear()
        return pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, f.type) for f in list(_SCHEMA)[5:])], schema=_SCHEMA)

    def terms(self) -> Iterator[pa.RecordBatch]:
        words = list(self.known)
        for a in range(0, len(words), 10_000):
            some = words[a : a + 10_000]
            n = len(some)
            own = [pa.array(np.arange(a, a + n), pa.int32()), pa.array(some, pa.string()), pa.array(self.ctf[a : a + n])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), *(pa.nulls(n, f.type) for f in list(_SCHEMA)[1:5]), *own], schema=_SCHEMA)


def _counter(most: int) -> Callable:
    """Rows of (doc_id, text) to rows of ``_COUNTED``; a part has ``most`` terms at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = ("", *STOPWORDS)
        part = _Part(TaskContext.get().partitionId() * TASK_PARTS)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                counts = Counter(DEFAULT.tokenize(text)) if text else {}
                for w in drop:
                    counts.pop(w, None)
                pairs = list(counts.items()) if len(counts) > most else ()
                # a page of more terms than a part can have is several rows, each with its share of the length
                for piece in [dict(pairs[a : a + most]) for a in range(0, len(pairs), most)] or [counts]:
                    if len(part.known) + len(piece) > most:
                        yield part.pages()
                        yield from part.terms()
                        part = _Part(part.number + 1)
                    part.add(doc, piece)
            yield part.pages()
        yield from part.terms()

    return run


@dataclass(frozen=True)
class Counted:
    """Pages with their terms; paths are of the shared folder. ``begin`` is ``starts`` of the terms."""

    pages: str
    terms: str
    numbers: str
    begin: list[int]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(doc_id, len, size) of the pages; ``size`` is the number of entries. A page may be several rows."""
        rows = spark.read.schema(_COUNTED).parquet(self.pages).where("term is null")
        return rows.select("doc_id", "len", F.octet_length("tfs").alias("size"))


def starts(terms: DataFrame) -> list[int]:
    """The number of the first term of each of the partitions that ``at`` tells of, and of all terms."""
    found = {r["p"]: r["count"] for r in terms.groupBy(F.shiftright("at", 33).alias("p")).count().collect()}
    return [int(x) for x in spans(np.array([found.get(i, 0) for i in range(max(found, default=-1) + 1)], np.int64))]


def build(docs: DataFrame, most: int = PART_TERMS) -> Counted:
    """The counted pages of (doc_id, text); doc_id must be unique."""
    spark = docs.sparkSession
    paths = [new_path(spark, f"feedback-{n}") for n in ("pages", "terms", "numbers")]
    with sent(spark, BATCH):
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(most), _COUNTED)
        rows.write.option("compression", "zstd").parquet(paths[0])
    held = spark.read.schema(_COUNTED).parquet(paths[0]).where("term is not null").select("part", "local", "term", "ctf")
    summed = held.groupBy("term").agg(F.sum("ctf").alias("ctf"))
    # terms that make no expansion keep their number, with no occurrence
    kept = F.when(F.col("term").rlike("^.+[.,]"), 0).otherwise(F.col("ctf")).alias("ctf")
    summed.orderBy("term").select(F.monotonically_increasing_id().alias("at"), "term", kept).write.option("compression", "zstd").parquet(paths[1])
    terms = spark.read.schema("at long, term string, ctf long").parquet(paths[1])
    begin = starts(terms)
    first = F.element_at(F.array(*map(F.lit, begin)), (F.shiftright("at", 33) + 1).cast("int"))
    number = (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
    each = held.join(terms.select("term", number.alias("num")), "term").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("local", "num"))).alias("x"))
    each = each.select("part", F.transform("x", lambda e: e["num"]).alias("nums"), F.floor(F.col("part") / TASK_PARTS).alias("task"))
    each.repartition("task").sortWithinPartitions("task", "part").write.option("compression", "zstd").partitionBy("task").parquet(paths[2])
    return Counted(*(qualified(spark, p) for p in paths), begin)


def _groups(path: str, columns: Sequence[str]) -> Iterator[pa.Table]:
    """The row groups of all files in a folder."""
    for fs, p in files(path):
        with fs.open_input_file(p) as source:
            f = pq.ParquetFile(source)
            for g in range(f.num_row_groups):
                yield f.read_row_group(g, columns)


@dataclass
class _Held:
    """Entries (nums, tfs) of some documents: pieces ``order[first[j] : first[j + 1]]`` are those of document j."""

    nums: np.ndarray
    tfs: np.ndarray
    at: np.ndarray
    order: np.ndarray
    first: np.ndarray
    lens: np.ndarray


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts, which are given up one by one, as one array."""
    out = np.empty(sum(map(len, parts)), parts[0].dtype)
    at = len(out)
    while parts:
        last = parts.pop()
        out[at - len(last) : at] = last
        at -= len(last)
    return out


def _held(index: Counted, wanted: np.ndarray) -> _Held:
    """The entries of the documents in ``wanted`` (sorted), read file after file."""
    docs, lens, sizes, nums, tfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
    task, numbers = -1, {}
    for rows in _groups(index.pages, ["part", "doc_id", "len", "ids", "tfs"]):
        rows = rows.filter(rows["doc_id"].is_valid())
        d = rows["doc_id"].to_numpy()
        j = np.minimum(np.searchsorted(wanted, d), len(wanted) - 1)
        hit = wanted[j] == d
        if not hit.any():
            continue
        rows, j = rows.filter(pa.array(hit)), j[hit]
        part = rows["part"].to_numpy()
        local, at = ints(rows["ids"], np.uint16)
        got = np.zeros(len(local), np.int32)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if at[b] == at[a]:
                continue
            if part[a] // TASK_PARTS != task:
                task = int(part[a] // TASK_PARTS)
                numbers = {p: x for t in _groups(f"{index.numbers}/task={task}", ["part", "nums"]) for p, x in zip(t["part"].to_pylist(), t["nums"])}
            own = numbers[int(part[a])].values.to_numpy()
            got[at[a] : at[b]] = own[local[at[a] : at[b]]]
        docs.append(j)
        lens.append(rows["len"].to_numpy().astype(np.int64))
        sizes.append(np.diff(at))
        nums.append(got)
        tfs.append(ints(rows["tfs"], np.uint8)[0].copy())
    of = np.concatenate(docs)
    return _Held(
        _joined(nums), _joined(tfs), spans(np.concatenate(sizes)), np.argsort(of, kind="stable"), spans(np.bincount(of, minlength=len(wanted))),
        np.bincount(of, np.concatenate(lens), len(wanted)),
    )


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the scores that can be among the ``k`` best once they are rounded to 9 digits or more."""
    if len(s) <= k:
        return np.arange(len(s))
    last = np.partition(s, len(s) - k)[len(s) - k]  # NaN is the largest, as in Spark
    with np.errstate(invalid="ignore"):
        return np.flatnonzero(~(s < last - abs(last) * 2e-8))


def _scorer(index: Counted, total: int, mu: float, k: int, by: Sequence[str], form: str, chunk: int) -> Callable:
    """Rows of (by, doc_id, score), sorted by ranking, to (by, top, learned)."""

    def place(at: np.ndarray) -> np.ndarray:
        return np.array(index.begin, np.int64)[at >> 33] + (at & ((1 << 33) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in by:
            code = rows[c].combine_chunks().dictionary_encode()
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        ranking = np.cumsum(new) - 1
        keys = rows.select(list(by)).take(pa.array(np.flatnonzero(new)))
        n = keys.num_rows
        wanted, doc = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
        score = rows["score"].to_numpy()
        del rows, got
        held = _held(index, wanted)
        ctf = np.zeros(index.begin[-1], np.int64)
        for t in _groups(index.terms, ["at", "ctf"]):
            ctf[place(t["at"].to_numpy())] = t["ctf"].to_numpy()

        share = score / (held.lens[doc] + mu)
        base = np.bincount(ranking, share, n)
        # (line, piece) of all lines of the rankings
        pieces = np.diff(held.first)[doc]
        line = np.repeat(np.arange(len(doc)), pieces)
        piece = held.order[np.repeat(held.first[doc], pieces) + within(pieces)]
        size = np.diff(held.at)[piece]
        before = spans(np.bincount(ranking[line], size, n).astype(np.int64))
        lines = np.searchsorted(ranking[line], np.arange(n + 1))
        chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(before, before[a] + chunk, "right")) - 1)
            own = slice(lines[a], lines[b])
            entry = np.repeat(held.at[piece[own]], size[own]) + within(size[own])
            key = np.repeat(ranking[line[own]] - a, size[own]) * len(ctf) + held.nums[entry]
            weight = held.tfs[entry] * np.repeat(share[line[own]], size[own])
            order = np.argsort(key, kind="stable")
            key, weight = key[order], weight[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            of, num = np.divmod(key[first], max(len(ctf), 1))
            sums = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
            live = ctf[num] > 0
            of, num, sums = of[live], num[live], sums[live]
            p = ctf[num] / float(total or 1)
            s = np.log(1 / p) * (sums + mu * p * base[a + of])
            cuts = np.searchsorted(of, np.arange(b - a + 1))
            take = [x + _best(s[x:y], k) for x, y in zip(cuts[:-1], cuts[1:]) if y > x]
            some = np.concatenate(take) if take else np.zeros(0, np.int64)
            values, which = np.unique(s[some], return_inverse=True)
            rounded = np.array([form % v for v in values.tolist()], np.float64)[which]
            nan = np.isnan(rounded)
            order = np.lexsort((num[some], np.where(nan, 0, -rounded), ~nan, of[some]))
            o = of[some][order]
            order = order[within(np.bincount(o, minlength=b - a)) < k]
            chosen.append((a + of[some][order], num[some][order], rounded[order]))
            a = b
        del held, line, piece, size, entry, key, weight
        pa.default_memory_pool().release_unused()
        of, num, rounded = (np.concatenate(x) for x in zip(*chosen))
        asked, which = np.unique(num, return_inverse=True)
        words = [""] * len(asked)
        for t in _groups(index.terms, ["at", "term"]):
            at = place(t["at"].to_numpy())
            hit = np.isin(at, asked, assume_unique=True)
            for i, w in zip(np.searchsorted(asked, at[hit]).tolist(), t["term"].filter(pa.array(hit)).to_pylist()):
                words[i] = w
        term = pa.array(words, pa.string()).take(pa.array(which))
        begins = np.searchsorted(of, np.arange(n + 1))
        for a in range(0, n, SENT):
            b = min(a + SENT, n)
            lo, hi = begins[a], begins[b]
            top = pa.StructArray.from_arrays([term[lo:hi], pa.array(rounded[lo:hi])], ["term", "score"])
            parts = [f"{form % x} {w}" for x, w in zip(rounded[lo:hi].tolist(), term[lo:hi].to_pylist())]
            learned = [f"#WAND( {' '.join(parts[x:y])} )" for x, y in zip(begins[a:b] - lo, begins[a + 1 : b + 1] - lo)]
            lists = pa.ListArray.from_arrays(pa.array(begins[a : b + 1] - lo, pa.int32()), top)
            own = [c.combine_chunks() for c in keys.slice(a, b - a).columns]
            yield pa.RecordBatch.from_arrays([*own, lists, pa.array(learned, pa.string())], [*by, "top", "learned"])

    return run


def term_scores(docs: DataFrame, feedback: DataFrame, mu: float, k: int, by: Sequence[str] = ("qid",), significant: int = 9, most: int = PART_TERMS, chunk: int = CHUNK) -> DataFrame:
    """(by, term, rank, score, learned): what ``feedback.term_scores`` and ``feedback.learned_text`` give, from (doc_id, text) of all documents.

    ``feedback`` is (by, doc_id, score), written; scores are rounded to ``significant`` digits, at most 9, before they are ranked.
    """
    if not 1 <= significant <= 9:
        raise ValueError("1 to 9 significant digits")
    spark = docs.sparkSession
    index = build(docs, most)
    pages = index.rows(spark)
    total = pages.agg(F.sum("len")).first()[0] or 0
    lines = feedback.dropna(subset=list(by)).select(*by, "doc_id", F.col("score").cast("double").alias("score"))
    entries = lines.select("doc_id").join(pages, "doc_id").agg(F.sum("size")).first()[0] or 0
    groups = max(-(-entries // TASK_ENTRIES), spark.sparkContext.defaultParallelism)
    spread = lines.repartition(groups, *by).sortWithinPartitions(*by)
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in lines.select(*by).schema)
    made = _scorer(index, total, mu, k, by, f"%.{significant - 1}e", chunk)
    got = spread.mapInArrow(made, f"{keys}top array<struct<term: string, score: double>>, learned string")
    each = got.select(*by, F.posexplode("top").alias("rank", "x"), "learned")
    return each.select(*by, "x.term", (F.col("rank") + 1).alias("rank"), "x.score", "learned")
