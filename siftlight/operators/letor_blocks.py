"""Learning to rank over the blocks of ``sources.asked``: features of many pairs of query and document without joins of postings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions import urls
from siftlight.functions.ids import norm_id
from siftlight.operators.letor import TEXT_FIELDS, bags, latest_pagerank
from siftlight.operators.ranking import DEPTH
from siftlight.plans import blocks as B
from siftlight.plans.models import BM25, LearnToRank
from siftlight.scratch import materialize, new_path, qualified
from siftlight.sources import asked
from siftlight.sources.asked import DOC_IDS, Asked, Block, about_block, ids_of, load_block, within
from siftlight.sources.index import records
from siftlight.sources.tables import table

#: Queries of a task, and queries whose features are worked out at once.
TASK_QUERIES, CHUNK = 6_000, 500
NAMES = tuple(f"{n}_{f}" for f in TEXT_FIELDS for n in ("bm25", "indri", "overlap", "any"))


def asked_terms(words: DataFrame) -> DataFrame:
    """(field, term) of (term) in all fields that features look at."""
    return words.select("term").distinct().select(F.explode(F.array(*map(F.lit, TEXT_FIELDS))).alias("field"), "term")


def bagged(words: DataFrame) -> DataFrame:
    """(qid, bag) of ``letor.bags``: a query's terms with their counts, as JSON."""
    return words.groupBy("qid").agg(F.to_json(F.sort_array(F.collect_list(F.struct("term", "qtf")))).alias("bag"))


@dataclass
class _About:
    """What a task knows of the collection."""

    index_terms: dict[str, dict[str, int]]
    numbers: dict[str, int]
    stats: B.Stats
    sizes: dict[int, tuple[float, float]]
    n_docs: int
    model: LearnToRank

    def entries(self, bag: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids per field (-1 where the collection's field lacks the term) and counts of a bag's terms."""
        words = json.loads(bag) if bag else []
        ids = np.array([[self.index_terms.get(f, {}).get(w["term"], -1) for w in words] for f in TEXT_FIELDS], np.int64).reshape(len(TEXT_FIELDS), len(words))
        ids[(ids >= 0) & (self.stats.df[ids] == 0)] = -1
        return ids, np.array([w["qtf"] for w in words], np.float64)

    def text(self, block: Block, keys: np.ndarray, lens: dict[int, np.ndarray], docs: np.ndarray, pair: np.ndarray, ids: np.ndarray, qtf: np.ndarray) -> np.ndarray:
        """NAMES of pairs whose documents stand at ``docs``; ``pair``, ``ids`` and ``qtf`` are of the pairs' terms. Null is NaN."""
        n, indri = len(docs), self.model.indri
        out = np.zeros((n, len(NAMES)))
        qlen = np.bincount(pair, qtf, n)
        for j, f in enumerate(TEXT_FIELDS):
            number = self.numbers.get(f, -1)
            length = lens[number][docs].astype(np.float64) if number in lens else np.zeros(n)
            total, average = self.sizes.get(number, (1.0, 1.0))
            own = np.maximum(ids[j], 0)
            known = ids[j] >= 0
            df, p = self.stats.df[own], np.where(known, self.stats.ctf[own], 1.0) / (total or 1.0)
            want = (own << 32) | docs[pair]
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = known & (keys[at] == want) if len(keys) else np.zeros(len(want), bool)
            log_p = np.where(known, np.log(p), 0.0)
            all_log, of_field = np.bincount(pair, qtf * log_p, n), np.bincount(pair, qtf * known, n)
            pair_h, qtf_h, p_h, df_h = pair[hit], qtf[hit], p[hit], df[hit]
            tf, size = block.tfs[at[hit]].astype(np.float64), length[pair[hit]]
            rsj = np.log((self.n_docs - df_h + 0.5) / (df_h + 0.5))
            weight = tf / (tf + self.model.k1 * (1 - self.model.b + self.model.b * size / (average or 1.0)))
            times = (self.model.k3 + 1) * qtf_h / (self.model.k3 + qtf_h)
            seen = np.log(indri.lam * (tf + indri.mu * p_h) / (size + indri.mu) + (1 - indri.lam) * p_h)
            found = np.bincount(pair_h, qtf_h, n)
            some = found > 0
            lacking = np.log(indri.lam * indri.mu / (length + indri.mu) + (1 - indri.lam))
            whole = np.bincount(pair_h, qtf_h * (seen - log_p[hit]), n) + all_log + (qlen - found) * lacking
            have = length > 0
            none = np.where(have, 0.0, np.nan)
            out[:, 4 * j] = np.where(have, np.bincount(pair_h, rsj * weight * times, n), np.nan)
            out[:, 4 * j + 1] = np.where(have & some & (of_field >= qlen), np.exp(whole / np.maximum(qlen, 1)), none)
            out[:, 4 * j + 2] = np.where(have, found / np.maximum(qlen, 1), np.nan)
            out[:, 4 * j + 3] = some
        return out


def _about(index: Asked, stats: str, model: LearnToRank):
    terms, names, n_docs = index.terms, index.names, index.n_docs
    sizes = {names.index(f): (float(s.sum_ttf), s.average) for f, s in index.fields.items()}

    def make(rows: int = 0) -> _About:
        ids = ids_of(terms)
        return _About(ids, {f: i for i, f in enumerate(names)}, B.Stats.of(stats, max(rows, sum(map(len, ids.values())))), sizes, n_docs, model)

    return make


def _keys(block: Block) -> np.ndarray:
    return (np.repeat(block.ids.astype(np.int64), np.diff(block.at)) << 32) | block.docs


def text_features(index: Asked, pairs: DataFrame, words: DataFrame, model: LearnToRank) -> DataFrame:
    """``letor.text_features`` over blocks."""
    make, lists, blocks = _about(index, B.statistics(index), model), index.path, index.blocks
    rows = pairs.select("qid", "doc_id").distinct().join(bagged(words), "qid", "left")
    kinds = ", ".join(f"{n} {'int' if n.startswith('any') else 'double'}" for n in NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = make()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        qid, doc = rows["qid"].to_numpy(), rows["doc_id"].to_numpy()
        bags_, which = np.unique(np.array(rows["bag"].fill_null("").to_pylist(), object), return_inverse=True)
        each = [about.entries(b) for b in bags_]
        wanted = np.unique(np.concatenate([ids.ravel() for ids, _ in each]))
        for at in blocks:
            ids, _, lens = about_block(lists, at)
            order = np.argsort(ids)
            place = np.minimum(np.searchsorted(ids, doc, sorter=order), len(ids) - 1)
            of = np.flatnonzero(ids[order[place]] == doc)
            if not len(of):
                continue
            block = load_block([lists], at, wanted[wanted >= 0])
            keys = _keys(block)
            for lo in range(0, len(of), 50_000):
                some = of[lo : lo + 50_000]
                counts = np.array([len(each[i][1]) for i in which[some]])
                values = about.text(
                    block, keys, lens, order[place[some]], np.repeat(np.arange(len(some)), counts),
                    np.concatenate([each[i][0] for i in which[some]], 1), np.concatenate([each[i][1] for i in which[some]]),
                )
                cols = [pa.array(values[:, i].astype(np.int32)) if n.startswith("any") else pa.array(values[:, i], from_pandas=True) for i, n in enumerate(NAMES)]
                yield pa.RecordBatch.from_arrays([pa.array(qid[some]), pa.array(doc[some]), *cols], ["qid", "doc_id", *NAMES])

    return materialize(B.tasks(rows, 500_000).mapInArrow(run, f"qid int, doc_id long, {kinds}"), "letor-text")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ext_id, spam_score, raw_url) of all pages."""
    docs = table(spark, folder, "documents").where("doc_id is not null").select("doc_id", norm_id("ext_id").alias("ext_id"))
    return docs.join(records(spark, folder).select("doc_id", "spam_score", "raw_url"), "doc_id", "left")


def _of_pages(spark: SparkSession, folder: str, index: Asked) -> str:
    """Folder, by block, of (doc_id, f1, f2, f3, f4, f17): the features that don't depend on the query."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["docs"].to_pylist()):
                ids = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), block), pa.int32())], ["doc_id", "block"])

    where = index.rows.where(F.col("id") == DOC_IDS).select("block", "docs").mapInArrow(numbers, "doc_id long, block int")
    pages = stored(spark, folder).join(latest_pagerank(table(spark, folder, "pagerank")), "ext_id", "left")
    url = F.col("raw_url")
    values = pages.select("doc_id", F.col("spam_score").cast("double").alias("f1"), urls.depth(url).alias("f2"), urls.from_wikipedia(url).alias("f3"), F.col("pagerank").alias("f4"), urls.domain_score(url).alias("f17"))
    path = new_path(spark, "letor-pages")
    values.join(where, "doc_id").repartition(max(1, len(index.blocks)), "block").write.partitionBy("block").parquet(path)
    return qualified(spark, path)


def ranked_by_model(spark: SparkSession, folder: str, queries: DataFrame, weights: list[float], model: LearnToRank, k: int = DEPTH) -> DataFrame:
    """``letor.ranked_by_model`` over blocks: candidates, their features and the new order are made in one task per some queries."""
    first = BM25(model.k1, model.b, model.k3)
    plans = B.plans(queries, first)
    words = materialize(bags(queries), "letor-bags")
    index = asked.build(spark, folder, B.terms_of(plans).unionByName(asked_terms(words)), B.terms_of(plans, "places"), TEXT_FIELDS)
    made, keys = B.made_of(index, plans)
    stats = B.statistics(index, made)
    make, pages = _about(index, stats, model), _of_pages(spark, folder, index)
    lists, blocks, names = index.path, index.blocks, index.names
    rows = plans.select("qid", "plan").where("plan is not null").join(bagged(words), "qid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(q, p, b) for x in batches for q, p, b in zip(x["qid"].to_pylist(), x["plan"].to_pylist(), x["bag"].to_pylist())]
        if not got:
            return
        plan, fields = B.resolved([p for _, p, _ in got], ids_of(index_terms), keys, names)
        about = make(len(fields))
        top = B.tops(plan, fields, about.stats, lists, made, blocks, about.sizes, about.n_docs, first, k)
        have = [(q, x[0], about.entries(b)) for (q, _, b), x in zip(got, top) if x is not None]
        if not have:
            return
        sizes = np.array([len(x) for _, x, _ in have])
        docs = np.concatenate([x for _, x, _ in have])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        values = np.full((len(docs), 18), np.nan)
        wanted = np.unique(np.concatenate([e[0].ravel() for _, _, e in have]))
        ext = np.empty(len(docs), object)
        for at in blocks:
            inside = docs >> 32 == at
            if not inside.any():
                continue
            ids, ext_ids, lens = about_block(lists, at)
            side = asked.read(f"{pages}/block={at}")
            order = np.argsort(side["doc_id"].to_numpy())
            assert len(order) == len(ids)
            back = np.empty(len(ids), np.int64)
            back[np.argsort(ids)] = order  # the row of each of the block's documents
            fixed = np.column_stack([side[c].to_pandas().to_numpy(np.float64)[back] for c in ("f1", "f2", "f3", "f4", "f17")])
            block = load_block([lists], at, wanted[wanted >= 0])
            postings = _keys(block)
            for a in range(0, len(have), CHUNK):
                b = min(a + CHUNK, len(have))
                own = np.flatnonzero(inside[begins[a] : begins[b]]) + begins[a]
                if not len(own):
                    continue
                place = docs[own] & 0xFFFFFFFF
                which = np.searchsorted(begins, own, "right") - 1
                counts = np.array([len(have[q][2][1]) for q in range(a, b)])
                starts = np.concatenate([[0], np.cumsum(counts)])
                terms, times = np.concatenate([have[q][2][0] for q in range(a, b)], 1), np.concatenate([have[q][2][1] for q in range(a, b)])
                n = counts[which - a]
                entry = np.repeat(starts[which - a], n) + within(n)
                text = about.text(block, postings, lens, place, np.repeat(np.arange(len(own)), n), terms[:, entry], times[entry])
                values[own, 0:4], values[own, 16] = fixed[place, 0:4], fixed[place, 4]
                for j in range(len(TEXT_FIELDS)):
                    values[own, 4 + 3 * j : 7 + 3 * j] = text[:, 4 * j : 4 * j + 3]
                values[own, 17] = np.where(np.isnan(text[:, 0]), np.nan, text[:, 3::4].sum(1))
                ext[own] = ext_ids.take(pa.array(place)).to_numpy(zero_copy_only=False)
        for a in range(0, len(have), CHUNK):
            b = min(a + CHUNK, len(have))
            at = begins[a : b + 1] - begins[a]
            x, size = values[begins[a] : begins[b]], sizes[a:b]
            low, high = np.fmin.reduceat(x, at[:-1]), np.fmax.reduceat(x, at[:-1])
            with np.errstate(all="ignore"):
                scaled = (x - np.repeat(low, size, 0)) / np.repeat(high - low, size, 0)
            scaled = np.where(np.repeat(high > low, size, 0) & ~np.isnan(x), scaled, 0.0)
            r = B.rounded(sum((scaled[:, i] * w for i, w in enumerate(weights)), np.zeros(len(x))), 9)
            query = np.repeat(np.arange(b - a), size)
            order = np.lexsort((docs[begins[a] : begins[b]], -r, query))
            qid = np.repeat(np.array([q for q, _, _ in have[a:b]], np.int32), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid), pa.array(ext[begins[a] : begins[b]][order], pa.string()), pa.array(r[order] / 1e9 + 0.0), pa.array((within(size) + 1).astype(np.int32))],
                ["qid", "ext_id", "score", "rank"],
            )

    index_terms = index.terms
    return materialize(B.tasks(rows, TASK_QUERIES).mapInArrow(run, "qid int, ext_id string, score double, rank int"), "letor-ranked")
