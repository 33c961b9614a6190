"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its tokens (words, runs of punctuation, A-Z lower-cased) and its pairs of neighbouring tokens,
hashed to 2^18 places. A token equal to the one before it counts as one fixed token, so that endless repetition is a
feature. Values are square roots of counts, scaled to length one. Training goes through the labelled texts one by one
(FTRL-Proximal: a rate per place, first-order penalty for sparse weights). Scoring is a sparse dot product with the
weights, 1 MB whatever the input.

Only the fit is on a bounded sample of labelled rows (`fit_rows`, those of the smallest doc_id digest); scoring covers
every whole text, in bounded slices, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.llm.bytes import LOWER, U, mix, prefix_hashes, slices, span_hashes

BITS = 18
FIT_ROWS = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.01, 0.0
PREDICT_FROM = 0.3
REPEAT = mix(np.array([0x5EED], U))[0]

# Kinds of bytes: 0 white space, 1 punctuation, 2 letters, digits and all wide characters.
KIND = np.full(256, 2, np.uint8)
KIND[:128] = [0 if chr(i).isspace() else 2 if chr(i).isalnum() or i == 95 else 1 for i in range(128)]


def held_out(doc_id: Column) -> Column:
    """Whether the row is never learned from: crc32 of the id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every token and every pair of neighbouring tokens."""
    kind = KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    text = np.searchsorted(offsets, starts, "right") - 1
    tokens = span_hashes(prefix_hashes(LOWER[data]), starts, ends)
    follows = text[1:] == text[:-1]
    repeats = np.flatnonzero(follows & (tokens[1:] == tokens[:-1])) + 1
    tokens[repeats] = REPEAT
    pairs = mix(tokens[:-1] * U(3) + tokens[1:])[follows]
    return np.concatenate([text, text[1:][follows]]), np.concatenate([tokens, pairs]) >> U(64 - bits)


def sparse_rows(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, places and values of the features, ordered by text and place; values of a text have length one."""
    text, place = hashed_ngrams(data, offsets, bits)
    keys, counts = np.unique((text.astype(U) << U(bits)) | place, return_counts=True)
    text, place = (keys >> U(bits)).astype(np.int64), (keys & U((1 << bits) - 1)).astype(np.int64)
    total = np.bincount(text, counts, minlength=len(offsets) - 1)
    return text, place, np.sqrt(counts / total[text])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept from (places, values, label) rows, taken in order, `epochs` times."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = [(np.append(places, size - 1), np.append(values, 1.0), label) for places, values, label in rows]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for places, values, label in rows:
            zp, np_ = z[places], n[places]
            w = weights(zp, np_)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            z[places] = zp + g - (np.sqrt(np_ + g * g) - np.sqrt(np_)) / ALPHA * w
            n[places] = np_ + g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept from the labelled rows that are not held out; at most fit_rows of them.

    labels: doc_id and quality. Rows whose id or label is null, and labels other than 0 and 1, teach nothing. The sample
    goes to one task, in the order of the digest; what comes back is the weights. Without rows, all weights are 0.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    digest = F.md5(F.col("doc_id").cast("string"))
    rows = usable.select("doc_id", F.col("quality").cast("int").alias("label"), digest.alias("digest"))
    # Digests are spread evenly: so many of them lie below this one, and a little more. Tasks send no others.
    share = min(1.0, (1.1 * fit_rows + 100) / max(1, rows.count()))
    low = rows.where(F.conv(F.substring("digest", 1, 13), 16, 10).cast("long") <= int(share * (1 << 52)))
    chosen = low.orderBy("digest", "doc_id").limit(fit_rows)
    # The sample is bounded by fit_rows, so it is sent to every task and only its texts move.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("digest", "doc_id", "label", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            label = batch.column("label").to_pylist()
            for data, offsets, first in slices(batch.column("text")):
                text, place, value = sparse_rows(data, offsets)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                rows += [(place[a:b], value[a:b], label[first + i]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        weights, bias = fit_ftrl(rows)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    found = texts.orderBy("digest", "doc_id", "text").coalesce(1).mapInArrow(train, "weights binary, bias double").collect()
    if not found:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"]


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs with score, the probability of label 1, from the text alone.

    A null or empty text has no features and takes the intercept's score. Repeated rows score alike. A column named score
    is replaced. No documents: no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((weights, bias))
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        w = w.astype(np.float64)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for data, offsets, first in slices(batch.column("text")):
                text, place, value = sparse_rows(data, offsets)
                out[first : first + len(offsets) - 1] = np.bincount(text, w[place] * value, minlength=len(offsets) - 1)
            probability = 1 / (1 + np.exp(-np.clip(out + b, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(probability)], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with held_out, score and predicted (1 from a score of 0.3), learned and scored in one go."""
    out = score_quality(docs, *fit_quality(docs, labels, fit_rows))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
