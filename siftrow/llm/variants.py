"""Spelling variants: words of a corpus that differ by one letter, and the common form each rare one stands for.

Words are counted first: tasks hash and cut the runs of letters of whole texts and send each word once per slice with its
count. The vocabulary that remains is written with a 64-bit hash per word. Near words are then found by Bloom-guided
neighbourhoods. Blocked Bloom filters over the hashes, one per word length, go to all tasks; a task makes the hash of every
one-letter edit of its words (the hash is a sum over letters, so an edit changes one term or shifts the rest) and probes the
filter of the edit's length. Each pair is met once: a deletion from its longer word, a replacement from the word with the
smaller letter. Only positives are shuffled, as pairs of hashes, to an exact join with the vocabulary, and the two words
found there are compared letter by letter, which removes what filters or hashes confused.

The filters of one pass have at most `filter_bytes`, however many words there are: a vocabulary that needs more is taken in
slices by hash, a pass per slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrow.llm.bytes import LOWER, U, mix, slices, word_spans
from siftrow.llm.common import stored, work_folder

MIN_LENGTH, MIN_COUNT, DROP_EVERY, RATIO = 7, 2, 31, 10
#: Letters: A-Z, a-z and U+00C0 to U+00FF, so a letter is one byte in Latin-1; A-Z are lower-cased.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
#: Bytes of all Bloom filters of a pass, and filter bits per word.
FILTER_BYTES, BITS_PER_WORD = 32 << 20, 24
#: Words of this length or longer share the last filter.
LAST_SHARD = 64
#: 64-bit blocks of a filter that are built together.
SEGMENT = 1 << 13
#: Edits whose hashes are made together.
EDITS = 1 << 20
_SLICE = 8 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = U(pow(_BASE, -1, 1 << 64))
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span, going on from its seed (the crc32 of what stands before)."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state = ~seed[order].astype(np.uint32)
    at, longest = starts[order], size[order]
    # Byte by byte over all spans that are that long; a few very long ones are left to zlib.
    short = int(np.searchsorted(-longest, -128, "left"))
    for i in range(int(longest[short]) if short < len(order) else 0):
        n = int(np.searchsorted(-longest, -i, "left"))
        s = state[short:n]
        state[short:n] = _CRC[(s ^ data[at[short:n] + i]) & 0xFF] ^ (s >> 8)
    state = ~state
    for i in range(short):
        state[i] = zlib.crc32(data[at[i] : at[i] + longest[i]].tobytes(), int(seed[order[i]]))
    out = np.empty(len(order), np.uint32)
    out[order] = state
    return out


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, of at least min_length letters.

    drop_every spoils one run in so many, always the same ones: where it divides h, the unsigned crc32 of
    `<doc_id>:<lower-cased run>`, letter number h modulo length goes. None spoils none. A null text has no runs; a null
    doc_id stands as nothing before the colon; repeated rows count again. No documents: no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for data, offsets, first in slices(batch.column("text"), _SLICE):
                # In UTF-8 the byte C3 begins U+00C0 to U+00FF and nothing else.
                wide = data == 0xC3
                follows = np.zeros(len(data), bool)
                follows[1:] = wide[:-1]
                data = LOWER[data]
                starts, ends, before = word_spans(data, offsets, ((data >= 97) & (data <= 122)) | wide | follows)
                marks = np.concatenate([[0], np.cumsum(follows)])
                letters = ends - starts - (marks[ends] - marks[starts])
                keep = np.flatnonzero(letters >= min_length)
                starts, ends, letters = starts[keep], ends[keep], letters[keep]
                size = ends - starts
                edges = np.concatenate([[0], np.cumsum(size)])
                flat = data[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], size)]
                if drop_every:
                    doc = np.searchsorted(before, keep, "right") - 1
                    seeds = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in numbers[first : first + len(offsets) - 1]], np.uint32)
                    h = crc_of_spans(data, starts, ends, seeds[doc]).astype(np.int64)
                    hit = np.flatnonzero(h % drop_every == 0)
                    left = np.ones(len(flat), bool)
                    begins = np.flatnonzero(~follows[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], size)])
                    gone = begins[np.searchsorted(begins, edges[hit]) + h[hit] % letters[hit]]
                    left[gone] = False
                    left[gone[flat[gone] == 0xC3] + 1] = False
                    letters[hit] -= 1
                    flat, edges = flat[left], np.concatenate([[0], np.cumsum(left)])[edges]
                words = pa.Array.from_buffers(pa.large_string(), len(letters), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)])
                found = pc.value_counts(words.filter(pa.array(letters >= min_length))).flatten()
                yield pa.RecordBatch.from_arrays([found[0].cast(pa.string()), found[1]], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, a byte each, and where each word begins (one number more than words)."""
    words = words.cast(pa.large_string())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    wide = data == 0xC3
    follows = np.zeros(len(data), bool)
    follows[1:] = wide[:-1]
    return np.where(follows, data + 0x40, data)[~wide].astype(np.uint8), np.concatenate([[0], np.cumsum(~wide)])[edges - edges[0]]


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _finish(raw: np.ndarray, length: int) -> np.ndarray:
    return mix(raw ^ mix(np.array([length + 1], U)))


def by_length(letters: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of the words of that length, their letters as rows), in parts of bounded size."""
    size = np.diff(edges)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, EDITS // max(length, len(ALPHABET)))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield length, part, letters[edges[part][:, None] + np.arange(length)]


def hashes(letters: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; those of different words can be equal."""
    out = np.zeros(len(edges) - 1, U)
    for length, rows, w in by_length(letters, edges):
        out[rows] = _finish((_VALUE[w] * _powers(max(length, 1))[:length]).sum(1, dtype=U), length)
    return out


def edits(w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row, hash) of words (rows of equal length) with one letter deleted or replaced by a greater one."""
    length = w.shape[1]
    power = _powers(length)
    terms = _VALUE[w] * power
    sums = np.concatenate([np.zeros((len(w), 1), U), np.cumsum(terms, 1, dtype=U)], 1)
    whole = sums[:, -1]
    for i in range(length):
        base = whole - terms[:, i]
        row, letter = np.nonzero(ALPHABET[None, :] > w[:, i][:, None])
        yield length, row, _finish(base[row] + _VALUE[ALPHABET[letter]] * power[i], length)
        if length > 1:
            # Deleting either of two equal neighbours gives the same word.
            row = np.flatnonzero(w[:, i] != w[:, i - 1]) if i else np.arange(len(w))
            yield length - 1, row, _finish(sums[row, i] + (whole[row] - sums[row, i + 1]) * _BACK, length - 1)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> U(32)) * U(blocks) >> U(32)).astype(np.int64)


def mask_of(h: np.ndarray) -> np.ndarray:
    """Four bits of a 64-bit block."""
    one = U(1)
    return one << (h & U(63)) | one << (h >> U(6) & U(63)) | one << (h >> U(12) & U(63)) | one << (h >> U(18) & U(63))


def bloom_filters(vocabulary: DataFrame, slice_: int, of: int) -> dict[int, np.ndarray]:
    """Filter (64-bit blocks) by word length, over the words (hash, length) of one slice.

    The blocks are laid out by the words counted per length; tasks build segments of them. All that the driver gathers are
    the filters themselves, whose size the caller bounds by the number of slices.
    """
    shard = F.least("length", F.lit(LAST_SHARD)).alias("shard")
    words = vocabulary.where(F.pmod("hash", F.lit(of)) == slice_).select("hash", shard)
    counts = {r["shard"]: r["n"] for r in words.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most LAST_SHARD rows
    blocks = {k: max(1, n * BITS_PER_WORD // 64) for k, n in counts.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, shards = batch.column("hash").to_numpy().view(U), batch.column("shard").to_numpy()
            at = np.zeros(len(h), np.int64)
            for k in np.unique(shards).tolist():
                at[shards == k] = block_of(h[shards == k], blocks[k])
            columns = [batch.column("shard"), pa.array(at // SEGMENT), pa.array(at % SEGMENT), pa.array(mask_of(h).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "at", "mask"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, U)
        np.bitwise_or.at(bits, table.column("at").to_numpy(), table.column("mask").to_numpy().view(U))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "segment": [key[1].as_py()], "bits": [bits.tobytes()]})

    placed = words.mapInArrow(place, "shard int, segment long, at long, mask long")
    parts = placed.groupBy("shard", "segment").applyInArrow(build, "shard int, segment long, bits binary").collect()
    out = {k: np.zeros(-(-n // SEGMENT) * SEGMENT, U) for k, n in blocks.items()}
    for part in parts:
        out[part["shard"]][part["segment"] * SEGMENT : (part["segment"] + 1) * SEGMENT] = np.frombuffer(part["bits"], U)
    return {k: bits[: blocks[k]] for k, bits in out.items()}


def positives(vocabulary: DataFrame, filters: dict[int, np.ndarray], slice_: int, of: int) -> DataFrame:
    """hash_a, hash_b: a word of the vocabulary and an edit of it that the filters of the slice may hold."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            own = batch.column("hash").to_numpy().view(U)
            for _, rows, w in by_length(*latin(batch.column("word"))):
                a, b = [], []
                for length, row, h in edits(w):
                    bits = known.get(min(length, LAST_SHARD))
                    if bits is None:
                        continue
                    if of > 1:
                        # As pmod of the signed hash.
                        in_slice = np.flatnonzero(h.view(np.int64) % of == slice_)
                        row, h = row[in_slice], h[in_slice]
                    mask = mask_of(h)
                    hit = np.flatnonzero((bits[block_of(h, len(bits))] & mask) == mask)
                    a.append(own[rows[row[hit]]])
                    b.append(h[hit])
                if a:
                    columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays(columns, names=["hash_a", "hash_b"])

    return vocabulary.select("word", "hash").mapInArrow(probe, "hash_a long, hash_b long")


def near_pairs(vocabulary: DataFrame, folder: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """a, n_a, b, n_b: every two words of the vocabulary (word, n, hash, length) one letter apart, each pair once."""
    words = vocabulary.count()
    of = max(1, -(-words * BITS_PER_WORD // 8 // filter_bytes))
    found = None
    for slice_ in range(of):
        part = positives(vocabulary, bloom_filters(vocabulary, slice_, of), slice_, of)
        part = stored(part, f"{folder}/positives-{slice_}")
        found = part if found is None else found.unionByName(part)
    b = vocabulary.select(F.col("hash").alias("hash_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    a = vocabulary.select(F.col("hash").alias("hash_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    # Words of equal hash make a positive stand for several pairs, and two edits can give one word: pairs once each.
    pairs = found.join(b, "hash_b").join(a, "hash_a").where(F.levenshtein("a", "b", 1) == 1)
    ordered = pairs.select(
        F.least("a", "b").alias("a"),
        F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    )
    return ordered.distinct()


def follow(forms: DataFrame, folder: str) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Each step doubles the way; counts grow along it, so it ends."""
    at = forms.select("word", F.col("form").alias("root"))
    turn = 0
    while True:
        turn += 1
        on = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        step = at.join(on, F.col("root") == F.col("_from"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")
        )
        step = stored(step, f"{folder}/roots-{turn}")
        at = step.select("word", "root")
        if not step.where("moved").head(1):
            return at


def spelling_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    drop_every: int | None = DROP_EVERY,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least min_length letters and min_count occurrences.

    n_near counts the words one inserted, deleted or replaced letter away. form is the one of largest n (ties: the smallest
    in code-point order) if that n is at least ratio * n, else null; form_n its n. root is where forms lead, the word itself
    without one. docs: doc_id, text (see `word_counts` for nulls); other columns are not read. No words: no rows.
    """
    if min_length < 2 or ratio < 2:
        raise ValueError("min_length and ratio must be at least 2")
    folder = work_folder(docs.sparkSession, "variants")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, edges = latin(batch.column("word"))
            columns = [batch.column("word"), batch.column("n"), pa.array(hashes(letters, edges).view(np.int64)), pa.array(np.diff(edges), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "hash", "length"])

    counted = word_counts(docs, min_length, drop_every).where(F.col("n") >= min_count)
    vocabulary = stored(counted.mapInArrow(hashed, "word string, n long, hash long, length int"), f"{folder}/vocabulary")
    pairs = stored(near_pairs(vocabulary, folder, filter_bytes), f"{folder}/pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("near")).alias("best")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("minus"), F.col("a").alias("near")).alias("best"))
    )
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    judged = vocabulary.select("word", "n").join(near, "word", "left")
    common = -F.col("best.minus") >= ratio * F.col("n")
    words = stored(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.minus")).alias("form_n")
        ),
        f"{folder}/words",
    )
    roots = follow(words.where("form is not null").select("word", "form"), folder)
    return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
