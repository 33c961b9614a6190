"""Document fingerprints from improbable features.

A text's windows of 24 bytes are ranked by the rarity of their entropy among all windows of the corpus. A window is a
feature if it is the rarest of enough runs of neighbouring windows (its popularity). Features go, in order, into a chain
of Bloom filters: five bits each, at most 128 features to a filter of 2,048 bits. Two fingerprints are compared filter by
filter: the bits in common, from what chance gives (0) to all that there could be (1). Each filter of the shorter chain
counts with its best partner.

Brief and uniform texts have few windows. They, and all texts up to somewhat above brief ones, also have a chain of all
their spans of six bytes, which decides where one of two texts is brief or uniform; so likeness does not end at a length.

The entropy of a window is that of order two, from its number of equal pairs of bytes: it can be summed along the text.
The rarity table has one count per possible number of pairs, whatever the input, over all windows of all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrow.llm.bytes import U, mix, prefix_hashes, slices, span_hashes

WINDOW = 24
PAIRS = WINDOW * (WINDOW - 1) // 2
#: Windows in a run, and in how many runs a feature must be the rarest.
RUN, POPULAR = 32, 8
BITS, PER_FILTER, HASHES = 2048, 128, 5
#: Bytes of the spans that decide for a text of fewer than BRIEF bytes.
SHORT, BRIEF = 6, 512
#: Texts of up to so many bytes have both kinds of filters. An edit of a brief text is no longer than this, and an edit of
#: a longer text is not brief, even if half of either's characters have four bytes.
BOTH = 5 * BRIEF
#: A text with less than one selected window in so many bytes is too uniform for windows to stand for it.
SPARSE = 128
#: Windows with more equal pairs than this are too uniform to tell texts apart.
DULL = PAIRS // 2
ROWS_PER_RANGE = 2048


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """Number of equal pairs of bytes in each window of data."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    # ahead[i]: bytes among the next WINDOW - 1 that equal byte i; behind[i]: among the last ones.
    ahead = np.zeros(len(data), np.uint8)
    behind = np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = data[lag:] == data[:-lag]
        ahead[:-lag] += same
        behind[lag:] += same
    first = sum(int((data[lag:WINDOW] == data[: WINDOW - lag]).sum()) for lag in range(1, WINDOW))
    steps = behind[WINDOW:].astype(np.int32) - ahead[: n - 1]
    return np.concatenate([[first], first + np.cumsum(steps)]).astype(np.int32)


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each number of equal pairs: the rarer among all windows of docs, the lower. PAIRS + 1 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS + 1, np.int64)
        for batch in batches:
            for data, offsets, _ in slices(batch.column("text")):
                pairs = equal_pairs(data)
                total += np.bincount(pairs[_inside(offsets, len(pairs))], minlength=PAIRS + 1)
        yield pa.RecordBatch.from_pydict({"level": pa.array(np.arange(PAIRS + 1)), "n": pa.array(total)})

    counts = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    n = np.zeros(PAIRS + 1, np.int64)
    for row in counts.collect():
        n[row["level"]] = row["n"]
    ranks = np.empty(PAIRS + 1, np.int32)
    ranks[np.lexsort((np.arange(PAIRS + 1), n))] = np.arange(PAIRS + 1)
    return ranks


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of n windows over joined texts lie within one text."""
    ok = np.ones(n, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - WINDOW + 1) : end] = False
    return ok


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows in order, and the number of them before each text."""
    pairs = equal_pairs(data)
    n = len(pairs)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    ok = _inside(offsets, n) & (pairs <= DULL)
    # The rank decides, then the place: the leftmost of the rarest windows of a run.
    key = np.where(ok, ranks[pairs].astype(np.int64), PAIRS + 1) << 32 | np.arange(n)
    least, width = key, 1
    while width < RUN:
        step = min(width, RUN - width)
        if len(least) <= step:
            break
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = least & 0xFFFFFFFF
    # A run counts for its window only if it lies in the window's text.
    start = np.arange(len(at))
    text = np.searchsorted(offsets, start, "right")
    fits = start + width + WINDOW - 1 <= offsets[np.minimum(text, len(offsets) - 1)]
    popular = np.bincount(at[fits & ok[at]], minlength=n) >= POPULAR
    chosen = np.flatnonzero(popular)
    return span_hashes(prefix_hashes(data), chosen, chosen + WINDOW), np.searchsorted(chosen, offsets)


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters (filters by bytes) of a text's features in order; equal features count once per filter."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), bool)
    where = np.arange(len(hashes)) // PER_FILTER
    for i in range(HASHES):
        bits[where, (mix(hashes + U(i)) & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def fingerprints(texts: pa.Array, ranks: np.ndarray) -> list[bytes]:
    """The chains of each text as bytes, nothing for an empty one: four bytes that say how many filters hold short spans
    and whether these decide, then those filters, then those of the windows."""
    out: list[bytes] = []
    for data, offsets, _ in slices(texts):
        hashes, bounds = features(data, offsets, ranks)
        for i in range(len(offsets) - 1):
            size, found = int(offsets[i + 1] - offsets[i]), hashes[bounds[i] : bounds[i + 1]]
            if not size:
                out.append(b"")
                continue
            thin = len(found) * SPARSE < size
            short = chain(_spans(data[offsets[i] : offsets[i + 1]])) if size <= BOTH or thin else np.zeros((0, BITS // 8), np.uint8)
            head = 2 * len(short) + (size < BRIEF or thin)
            out.append(head.to_bytes(4, "little") + short.tobytes() + chain(found).tobytes())
    return out


def _spans(own: np.ndarray) -> np.ndarray:
    """Hashes of a text's different short spans in order."""
    width = min(SHORT, len(own))
    starts = np.arange(len(own) - width + 1)
    spans = span_hashes(prefix_hashes(own), starts, starts + width)
    _, first = np.unique(spans, return_index=True)
    return spans[np.sort(first)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1. Equal fingerprints: 1. One without filters: 0 unless equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    heads = [int.from_bytes(s[:4], "little") for s in (a, b)]
    cuts = [4 + (h >> 1) * (BITS // 8) for h in heads]
    short = [s[4:cut] for s, cut in zip((a, b), cuts, strict=True)]
    windows = [s[cut:] for s, cut in zip((a, b), cuts, strict=True)]
    # The windows tell texts apart unless one of them is too short or too uniform to have enough.
    if all(short) and ((heads[0] | heads[1]) & 1 or not all(windows)):
        return _chains_alike(*short)
    return _chains_alike(*windows) if all(windows) else 0.0


def _chains_alike(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    width = BITS // 8
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8).reshape(-1, width), axis=1).astype(np.float32) for s in sorted((a, b), key=len))
    nx, ny = x.sum(1)[:, None], y.sum(1)[None]
    chance, most = nx * ny / BITS, np.minimum(nx, ny)
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0, 1)
    # A filter is like another only as far as their sizes are alike.
    return float((score * most / np.maximum(nx, ny)).max(1).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_range(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds shard: which of about equally many rows' ranges of doc_id a row lies in, in ascending order; 0 for a null id."""
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * ranges).alias("q")).first()["q"] if shares else None
    cuts = np.array(sorted(set(found or [])), np.int64)

    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        return pd.Series(np.where(known, np.searchsorted(cuts, ids.fillna(0).astype("int64"), "right"), 0))

    return docs.withColumn("shard", F.pandas_udf(place, "long")("doc_id"))


def compare_with_next(docs: DataFrame, ranks: np.ndarray, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    The next document is that of the next doc_id, the first after the last; rows of equal doc_id go by text, null ids come
    first. A null text is empty. A single document is its own next. No documents: no rows. Other columns are not read.

    The table is dealt once into ranges of doc_id. Each range also gets the first document of the next one, so that a
    task finds all it needs in order and holds one batch and one row at a time.
    """
    n = docs.count()
    ranges = max(1, -(-n // rows_per_range))
    cut = with_range(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), ranges)
    # The first id of every range that has rows: one number per range. In this order the ranges follow each other.
    heads = sorted(cut.groupBy("shard").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).collect())
    rows = cut.withColumn("guest", F.lit(False))
    if heads:
        turns = {b["shard"]: a["shard"] for a, b in zip(heads, [*heads[1:], heads[0]], strict=True)}
        ids = [h["id"] for h in heads if not h["none"]]
        first = F.col("doc_id").isin(ids) if ids else F.lit(False)
        if any(h["none"] for h in heads):
            first = first | F.col("doc_id").isNull()
        host = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in turns.items() for x in pair]), F.col("shard"))
        rows = rows.unionByName(cut.where(first).withColumn("shard", host).withColumn("guest", F.lit(True)))
    ordered = rows.repartitionByRange(ranges, "shard").sortWithinPartitions("shard", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # shard, doc_id, text, fingerprint of the row whose next one is still to come
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = batch.column("text").to_pylist()
                rows = list(zip(batch.column("shard").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), texts, fingerprints(batch.column("text"), ranks), strict=True))
                pairs = []
                for shard, guest, doc, text, print_ in rows:
                    if held is not None:
                        pairs.append((held, text, print_))
                    held = None if guest else [shard, doc, text, print_]
                if not pairs:
                    continue
                new = [edited(h[2], text) for h, text, _ in pairs]
                prints = fingerprints(pa.array(new, pa.large_string()), ranks)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([h[1] for h, _, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(h[2]) for h, _, _ in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in new],
                    "fingerprint": [h[3].hex() for h, _, _ in pairs],
                    "edited_fingerprint": [x.hex() for x in prints],
                    "near_edited": [likeness(h[3], x) for (h, _, _), x in zip(pairs, prints, strict=True)],
                    "near_next": [likeness(h[3], x) for h, _, x in pairs],
                })

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(walk, schema)


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """docs with fingerprint (hex) of each whole text, without a shuffle. A null text is empty and has an empty one."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    schema = docs.select(*kept).withColumn("fingerprint", F.lit("")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([x.hex() for x in fingerprints(batch.column("text"), ranks)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [prints], names=schema.names)

    return docs.select(*kept).mapInArrow(add, schema)
