"""Cost-balanced packing of documents into sequences for training with attention inside documents.

The cost of a piece of n tokens is n + n * n / `width`: a linear part for the layers and a quadratic one for attention,
which reaches the linear part at n = width. Pieces of the full length are sequences of their own. The others are dealt by
hash into shards of about `shard_tokens` tokens, a bounded number that does not grow with the input. A shard of T tokens
gets T div length sequences. Its pieces go, from long to short, each to the sequence of lowest cost that has room for it.
What fits nowhere whole is cut to fill the gaps, lowest cost first. So every such sequence is full; the T mod length tokens
left over fill sequences whose lengths are powers of two, which need no padding either.

Each text is encoded once. Its pieces are written with their ids, so a lost executor costs no second encoding of others'
texts, and they move once, to their shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrow.llm.common import stored, work_folder
from siftrow.llm.tokens import encoder

LENGTH = 2048
#: Tokens of a shard, about.
SHARD_TOKENS = 1 << 21
#: Piece length at which attention costs as much as all else.
WIDTH = 4096
PIECES = "uid long, doc_id long, doc_tokens long, start long, size long, ids binary"
PACKED = "doc_id long, doc_tokens long, start long, size long, ids binary, sequence_id long, offset long"


def piece_cost(n, width: int = WIDTH):
    """Estimated cost of a piece of n tokens, in tokens' worth of linear work."""
    return n + n * n / width


def encoded_pieces(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """A row per piece of at most `length` tokens: uid, doc_id, doc_tokens, start, size, ids (little-endian, 16 or 32 bits).

    A null text is empty and has its end_id alone. All pieces of a document but its last are full. uid (partition and row)
    tells apart repeated rows; it holds once the result is written.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        made = encoder(vocabulary)
        width = made.width(end_id)
        for batch in batches:
            numbers = batch.column("doc_id")
            for at, ids, bounds in made.encode(batch.column("text"), end_id):
                sizes = np.diff(bounds)
                pieces = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(sizes[doc] - start, length)
                # Pieces follow each other, so all ids are one buffer and only the edges differ.
                edges = np.append(bounds[doc] + start, len(ids)) * width
                data = pa.py_buffer(ids.astype(f"<u{width}"))
                held = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), data]).cast(pa.binary())
                columns = [pa.array(uid + np.arange(len(doc))), numbers.take(pa.array(at + doc)), *map(pa.array, (sizes[doc], start, size)), held]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "doc_tokens", "start", "size", "ids"])
                uid += len(doc)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class LowestCost:
    """Sequences by the room they have left; finds the one of lowest cost among those with enough room."""

    def __init__(self, count: int, length: int):
        self.top = 1 << length.bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {length: [(0.0, i) for i in range(count)]}
        # A tree over room 0 to length; each node names the cheapest sequence below it.
        self.tree: list[tuple[float, int, int] | None] = [None] * (2 * self.top)
        self._renew(length)

    def _renew(self, room: int) -> None:
        heap = self.heaps.get(room)
        at = self.top + room
        self.tree[at] = (*heap[0], room) if heap else None
        while at > 1:
            a, b = self.tree[at & ~1], self.tree[at | 1]
            at >>= 1
            self.tree[at] = b if a is None else a if b is None else min(a, b)

    def take(self, least_room: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with that much room, removed; None if there is none."""
        best, at = None, self.top + least_room
        candidates = [self.tree[at]]
        while at > 1:
            if not at & 1:
                candidates.append(self.tree[at | 1])
            at >>= 1
        best = min((c for c in candidates if c is not None), default=None)
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._renew(best[2])
        return best

    def put(self, cost: float, sequence: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps.setdefault(room, []), (cost, sequence))
            self._renew(room)


def balance(sizes: list[int], length: int = LENGTH, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, size, sequence, offset) of all parts of the pieces, each token in one part.

    Sequences 0 to sum div length - 1 are full; the rest, if any, fill powers of two, the largest first.
    """
    full, rest = divmod(sum(sizes), length)
    out, uncut = [], []
    open_ = LowestCost(full, length)
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[piece]
        if found := open_.take(n) if full else None:
            cost, sequence, room = found
            out.append((piece, 0, n, sequence, length - room))
            open_.put(cost + piece_cost(n, width), sequence, room - n)
        else:
            uncut.append(piece)
    powers = [(full + i, 1 << bit) for i, bit in enumerate(b for b in range(length.bit_length(), -1, -1) if rest >> b & 1)]
    last, used = 0, 0
    for piece in uncut:
        done = 0
        while done < sizes[piece]:
            if found := open_.take(1) if full else None:
                cost, sequence, room = found
                n = min(room, sizes[piece] - done)
                out.append((piece, done, n, sequence, length - room))
                open_.put(cost + piece_cost(n, width), sequence, room - n)
            else:
                sequence, size = powers[last]
                n = min(size - used, sizes[piece] - done)
                out.append((piece, done, n, sequence, used))
                used += n
                if used == size:
                    last, used = last + 1, 0
            done += n
    return out


def pack_balanced(
    docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, width: int = WIDTH, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """doc_id, doc_tokens, start, size, ids, sequence_id, offset: a row per part of every document.

    ids are little-endian unsigned 32-bit numbers. A sequence's parts are gapless from offset 0; it has `length` tokens, or
    a power of two. Null or empty text: end_id alone. Null doc_ids and repeated rows are documents of their own. No
    documents: no rows. Other columns are not read. A very long document is cut into full pieces and one shorter.
    """
    spark = docs.sparkSession
    pieces = stored(encoded_pieces(docs, vocabulary, end_id, length), f"{work_folder(spark, 'balanced')}/pieces")
    tokens = pieces.where(F.col("size") < length).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy()
        held = table.column("ids").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        data = b"".join(held.to_pylist())
        ids = np.frombuffer(data, f"<u{len(data) // int(sizes.sum())}").astype("<u4")
        before = np.cumsum(sizes) - sizes
        parts = np.array(balance(sizes.tolist(), length, width), np.int64).reshape(-1, 5)
        parts = parts[np.lexsort((parts[:, 4], parts[:, 3]))]
        piece, at, size, sequence, offset = parts.T
        low = before[piece] + at
        ends = np.cumsum(size)
        flat = ids[np.arange(ends[-1]) + np.repeat(low - (ends - size), size)]
        edges = (np.concatenate([[0], ends]) * 4).astype(np.int32)
        out = table.take(pa.array(piece))
        columns = [
            out.column("doc_id"),
            out.column("doc_tokens"),
            pa.array(out.column("start").to_numpy() + at),
            pa.array(size),
            pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(flat)]),
            pa.array((int(key[0].as_py()) << 24) + sequence),
            pa.array(offset),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "doc_tokens", "start", "size", "ids", "sequence_id", "offset"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, f"<u{len(x) // length}").astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            n = batch.num_rows
            columns = [
                *(batch.column(c) for c in ("doc_id", "doc_tokens", "start", "size")),
                pa.array(held, pa.binary()),
                pa.array(-1 - batch.column("uid").to_numpy()),
                pa.array(np.zeros(n, np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_tokens", "start", "size", "ids", "sequence_id", "offset"])

    short = pieces.where(F.col("size") < length).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    full = pieces.where(F.col("size") == length)
    return short.groupBy("shard").applyInArrow(fill, PACKED).unionByName(full.mapInArrow(whole, PACKED))
