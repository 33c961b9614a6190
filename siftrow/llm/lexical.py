"""Ranked lexical search by norm buckets (LEMP): the highest inner products of items with all documents.

A document is its impact vector: for each term of the items that it holds, the term's weight times the integer impact of
its frequency. An item is the 0/1 vector of its terms, so a score is an inner product. Texts are read once: tasks count the
terms and write, per document, its length and its hits on the items' vocabulary. From these come the statistics of the
corpus and the vectors, which are sorted by length (Euclidean norm), from long to short, over all tasks.

The longest vectors are searched first; the 50th best score there is a threshold for each item. Only vectors that could
still reach it by Cauchy-Schwarz are read again (score <= norm of item * norm of vector, a filter on the sorted table).
Tasks take them in buckets of similar norm. A bucket whose longest vector cannot reach an item's threshold is passed over.
Inside, the item's heaviest terms are the focus coordinates: their part of the score is exact, the rest is bounded by the
smaller of the rest's norms and the bucket's largest coordinates. Vectors whose bound reaches the threshold are scored
exactly, in 64-bit integers, and raise the task's threshold. Bounds are in doubles and widened by more than their error.

Items come in blocks whose vocabulary has a bounded number of terms, and each block is sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrow.llm.bytes import LOWER, slices, word_spans
from siftrow.llm.common import stored, work_folder

BEST = 50
#: Terms of a block of items, repeats in different items counted, about.
BLOCK_TERMS = 1 << 20
#: Share of the longest vectors that give the first thresholds.
FIRST = 0.02
#: Documents, and hits, of a bucket.
BUCKET, BUCKET_HITS = 4096, 1 << 20
#: Coordinates of an item whose part of the score is exact in the bound.
FOCUS = 8
#: More than the relative error of a bound in doubles.
WIDER = 1 + 1e-9

#: Bytes of terms: ASCII letters and digits and all of U+0080 and up.
_TERM = np.ones(256, bool)
_TERM[:0x30] = _TERM[0x3A:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False


def terms_of(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Slices of a column of texts: number of the first text, all terms (A-Z lower-cased), number of terms before each text."""
    for data, offsets, first in slices(column, limit):
        starts, ends, before = word_spans(data, offsets, _TERM[data])
        size = ends - starts
        edges = np.concatenate([[0], np.cumsum(size)])
        flat = LOWER[data[_TERM[data]]]
        yield first, pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)]), before


def item_terms(items: DataFrame) -> DataFrame:
    """uid, item_id, terms (distinct, null text: none). uid (partition and row) holds once the result is written."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, terms, before in terms_of(batch.column("text")):
                n = len(before) - 1
                lists = [pc.unique(terms.slice(a, b - a)).to_pylist() for a, b in zip(before[:-1], before[1:], strict=True)]
                columns = [pa.array(uid + np.arange(n)), batch.column("item_id").slice(first, n), pa.array(lists, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "item_id", "terms"])
                uid += n

    id_type = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(split, f"uid long, item_id {id_type}, terms array<binary>")


def term_hits(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """uid, doc_id, n, hits of every document with a term. n counts its terms; hits holds pairs of 32-bit numbers, a term of
    the vocabulary (sorted) and how often it occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        known = pa.array(shared.value, pa.large_binary())
        size = max(1, len(known))
        for batch in batches:
            for first, terms, before in terms_of(batch.column("text")):
                found = pc.index_in(terms, value_set=known)
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                doc = np.searchsorted(before, at, "right") - 1
                pairs, tf = np.unique(doc * size + found.drop_null().to_numpy(), return_counts=True)
                flat = np.stack([pairs % size, tf], 1).astype("<u4")
                rows = np.flatnonzero(np.diff(before))
                edges = (np.searchsorted(pairs, np.append(rows, len(before)) * size) * 8).astype(np.int64)
                held = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).cast(pa.binary())
                columns = [pa.array(uid + np.arange(len(rows))), batch.column("doc_id").take(pa.array(first + rows)), pa.array(np.diff(before)[rows]), held]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n", "hits"])
                uid += len(rows)

    return docs.select("doc_id", "text").mapInArrow(count, "uid long, doc_id long, n long, hits binary")


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and frequencies of all hits, and where each row's begin (one number more than rows)."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return flat[:, 0], flat[:, 1], np.concatenate([[0], np.cumsum(sizes)])


def document_frequencies(hits: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary: one row per task and term, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(unpack(batch.column("hits"))[0], minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    found = hits.select("hits").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def vectors(hits: DataFrame, weights: np.ndarray, n: int, terms: int) -> DataFrame:
    """uid, doc_id, m, norm, hits of the documents with a vector, by norm from long to short over all partitions."""
    shared = hits.sparkSession.sparkContext.broadcast(weights)
    m = F.expr(f"50L + (50L * n * {n}L) div {max(1, terms)}L")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            term, tf, edges = unpack(batch.column("hits"))
            each = np.repeat(batch.column("m").to_numpy(), np.diff(edges))
            squares = (w[term] * impacts(tf, each)).astype(float) ** 2
            held = np.flatnonzero(np.diff(edges))
            norm = np.zeros(batch.num_rows)
            if len(held):
                norm[held] = np.sqrt(np.add.reduceat(squares, edges[held]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "m", "hits")), pa.array(norm)], names=["uid", "doc_id", "m", "hits", "norm"])

    measured = hits.select("uid", "doc_id", m.alias("m"), "hits").mapInArrow(measure, "uid long, doc_id long, m long, hits binary, norm double")
    # The row number keeps copies, whose norms are equal, from meeting in one range.
    order = (F.desc("norm"), F.col("uid"))
    return measured.where("norm > 0").repartitionByRange(*order).sortWithinPartitions(*order)


class Items:
    """A block of items: their terms as numbers in the vocabulary, heaviest first, with thresholds and the best so far."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray, best: int):
        self.terms = [t[np.argsort(-weights[t], kind="stable")] for t in terms]
        self.weights, self.thresholds, self.best = weights, thresholds.copy(), best
        self.found: list[np.ndarray] = [np.zeros((4, 0), np.int64) for _ in terms]

    def add(self, item: int, score: np.ndarray, names: np.ndarray) -> None:
        """Keep the best; the last of them, once there are enough, is the threshold."""
        both = np.concatenate([self.found[item], np.concatenate([score[None], names])], 1)
        score, known, doc, uid = both
        order = np.lexsort((uid, doc, known, -score))[: self.best]
        self.found[item] = both[:, order]
        if len(order) == self.best:
            self.thresholds[item] = max(self.thresholds[item], score[order[-1]])

    def search(self, names: np.ndarray, m: np.ndarray, norm: np.ndarray, term: np.ndarray, tf: np.ndarray, edges: np.ndarray) -> None:
        """One bucket. names: whether the doc_id is known, doc_id and uid of each vector."""
        row = np.repeat(np.arange(len(m)), np.diff(edges))
        p = self.weights[term] * impacts(tf, m[row])
        by_term = np.argsort(term, kind="stable")
        row, p, term = row[by_term], p[by_term], term[by_term]
        held, first = np.unique(term, return_index=True)
        last = np.append(first[1:], len(term))
        largest = np.maximum.reduceat(p, first).astype(float) if len(term) else np.zeros(0)
        squares = norm**2
        for item, terms in enumerate(self.terms):
            least = max(self.thresholds[item], 1)
            if norm.max() * math.sqrt(len(terms)) * WIDER < least:
                continue
            at = np.searchsorted(held, terms)
            at = at[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == terms)]
            focus, rest = at[:FOCUS], at[FOCUS:]
            score, used = np.zeros(len(m), np.int64), np.zeros(len(m))
            for k in focus:
                docs, part = row[first[k] : last[k]], p[first[k] : last[k]]
                score[docs] += part
                used[docs] += part.astype(float) ** 2
            left = np.sqrt(np.maximum(squares * WIDER - used, 0) * len(rest)) * WIDER
            bound = (score + np.minimum(left, largest[rest].sum())) * WIDER
            near = bound >= least
            if not near.any():
                continue
            for k in rest:
                docs = row[first[k] : last[k]]
                chosen = near[docs]
                score[docs[chosen]] += p[first[k] : last[k]][chosen]
            good = np.flatnonzero(near & (score >= least))
            if len(good):
                self.add(item, score[good], names[:, good])


def search(table: DataFrame, terms: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray, best: int) -> DataFrame:
    """item, score, doc_id, uid: at most `best` rows of each task and item."""
    shared = table.sparkSession.sparkContext.broadcast((terms, weights, thresholds))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, best)
        for batch in batches:
            term, tf, edges = unpack(batch.column("hits"))
            m, norm, uid = (batch.column(c).to_numpy() for c in ("m", "norm", "uid"))
            doc = batch.column("doc_id")
            names = np.stack([doc.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy(), uid])
            lo = 0
            while lo < len(m):
                hi = min(lo + BUCKET, max(lo + 1, int(np.searchsorted(edges, edges[lo] + BUCKET_HITS, "right")) - 1), len(m))
                part = slice(edges[lo], edges[hi])
                items.search(names[:, lo:hi], m[lo:hi], norm[lo:hi], term[part], tf[part], edges[lo : hi + 1] - edges[lo])
                lo = hi
        item = np.repeat(np.arange(len(items.found)), [x.shape[1] for x in items.found])
        score, known, doc, uid = np.concatenate([np.zeros((4, 0), np.int64), *items.found], 1)
        columns = [pa.array(item), pa.array(score), pa.array(doc, mask=known == 0), pa.array(uid)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id", "uid"])

    return table.mapInArrow(scan, "item long, score long, doc_id long, uid long")


def best_of(found: DataFrame, best: int, spread: int = 64) -> DataFrame:
    """The best rows of each item, with rank; first among those of some tasks, then of all."""
    order = (F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("uid"))
    some = found.withColumn("_some", F.pmod(F.xxhash64("uid"), F.lit(spread)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_some").orderBy(*order))).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best).drop("_some")


def search_block(docs: DataFrame, block: list, id_type: str, folder: str, best: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items (item_id, terms) of one block."""
    asked = [[bytes(t) for t in row["terms"]] for row in block]
    vocabulary = sorted(set().union(*asked))
    number = {t: i for i, t in enumerate(vocabulary)}
    terms = [np.array(sorted(number[t] for t in held), np.int64) for held in asked]
    hits = stored(term_hits(docs, vocabulary), f"{folder}/hits")
    n, length = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(hits, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    table = stored(vectors(hits, weights, n, length), f"{folder}/vectors")
    # First the longest vectors, for a threshold of each item.
    edge = table.agg(F.percentile_approx("norm", 1 - FIRST, 1000)).first()[0]
    none = np.zeros(len(terms), np.int64)
    first = stored(best_of(search(table.where(F.col("norm") >= F.lit(edge)), terms, weights, none, best), best), f"{folder}/first")
    thresholds = none.copy()
    for row in first.where(F.col("rank") == best).select("item", "score").collect():  # at most one row per item
        thresholds[row["item"]] = row["score"]
    # Below this norm no item's threshold can be reached.
    least = min((max(t, 1) / math.sqrt(len(x)) for t, x in zip(thresholds.tolist(), terms, strict=True) if len(x)), default=math.inf) / WIDER
    others = table.where((F.col("norm") < F.lit(edge)) & (F.col("norm") >= F.lit(least)))
    found = search(others, terms, weights, thresholds, best).unionByName(first.drop("rank"))
    names = docs.sparkSession.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], f"item long, item_id {id_type}")
    ranked = best_of(found, best)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the highest-scoring documents of each item, at most `best`, score above 0.

    docs: doc_id, text; items: item_id, text. Equal scores go by ascending doc_id, null first, then
    by place in the table. A null or empty text has no terms: such a document is not counted, such an item has no rows. Each
    row of items is an item of its own, repeated rows too, and each row of docs a document. No documents or items: no rows.
    Other columns are not read.
    """
    folder = work_folder(docs.sparkSession, "search")
    asked = stored(item_terms(items), f"{folder}/items").where(F.size("terms") > 0)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    out = None
    for i in range(blocks):
        # A block has a bounded number of terms, whatever the number of items.
        block = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == i).select("item_id", "terms").collect()
        if block:
            part = search_block(docs, block, items.schema["item_id"].dataType.simpleString(), f"{folder}/block-{i}", best)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out
