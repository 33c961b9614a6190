"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces of the full length are sequences of their own. The rest is packed in rounds. A round sorts the unplaced pieces and
the gaps of all open sequences together, from large to small, and sweeps over them: each piece takes the smallest gap
still free that holds it, its successor. The sweep is distributed: counting +1 for a gap and -1 for a piece, a piece's gap
is the last one before it on the same level of the running sum, as brackets match. The running sum comes from the number
of rows of each (size, range) and ranks within it; pieces that compete for a gap are settled by that rank. Then the gaps
are updated, sequences are opened for the largest pieces by what the gaps cannot hold, and the next round begins. A gap
that can hold several of the largest piece left stands as several gaps in one round, so many small pieces take few rounds.

State is written to the shared folder after every round; tasks hold rows of one range or one level only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrow.llm.common import stored, work_folder
from siftrow.llm.tokens import encoder

LENGTH = 1024
#: Ranges that rows of one size are ranked in.
RANGES = 64


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """uid, doc_id, piece, start, size, ids_crc32 of every document's pieces: ids of the whole text, then end_id.

    A document of more than `length` ids is cut into pieces of `length`; the first takes the remainder, if any. A null text
    is empty. uid (partition and row) tells apart repeated rows; it holds once the result is written.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        made = encoder(vocabulary)
        for batch in batches:
            numbers = batch.column("doc_id")
            for at, ids, bounds in made.encode(batch.column("text"), end_id):
                lengths = np.diff(bounds)
                pieces = -(-lengths // length)
                doc = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                # The last piece ends with its document; counted from there all are full but the first.
                ends = lengths[doc] - (pieces[doc] - 1 - piece) * length
                starts = np.maximum(ends - length, 0)
                flat = ids.astype("<u4", copy=False)
                low, high = (bounds[doc] + starts).tolist(), (bounds[doc] + ends).tolist()
                sums = [zlib.crc32(flat[a:b]) for a, b in zip(low, high, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(len(doc))), numbers.take(pa.array(at + doc)), *map(pa.array, (piece, starts, ends - starts)), pa.array(sums, pa.int64())],
                    names=["uid", "doc_id", "piece", "start", "size", "ids_crc32"],
                )
                uid += len(doc)

    return docs.select("doc_id", "text").mapInArrow(cut, "uid long, doc_id long, piece long, start long, size long, ids_crc32 long")


def sweep(pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """uid, bin, part for each piece that found a gap. pieces: uid, size; gaps: bin, part, size.

    Equal sizes: the gap comes before the piece, and rows of one kind and size go by range and id.
    """
    rows = gaps.select("size", F.lit(1).alias("kind"), F.col("bin").alias("id"), "part").unionByName(
        pieces.select("size", F.lit(-1).alias("kind"), F.col("uid").alias("id"), F.lit(0).cast("long").alias("part"))
    )
    rows = rows.withColumn("range", F.pmod(F.xxhash64("id", "part"), F.lit(RANGES)))
    classes = rows.groupBy("size", "kind", "range").agg(F.count(F.lit(1)).alias("n"))
    # At most (length x 2 x RANGES) rows, whatever the input.
    order = Window.orderBy(F.desc("size"), F.desc("kind"), "range").rowsBetween(Window.unboundedPreceding, -1)
    bases = classes.select("size", "kind", "range", F.coalesce(F.sum(F.col("n") * F.col("kind")).over(order), F.lit(0)).alias("base"), F.row_number().over(Window.orderBy(F.desc("size"), F.desc("kind"), "range")).alias("seq"))
    rank = F.row_number().over(Window.partitionBy("size", "kind", "range").orderBy("id", "part"))
    ranked = rows.withColumn("rank", rank).join(bases, ["size", "kind", "range"])
    # A gap steps from level to level + 1, a piece back from level + 1 to level.
    level = F.when(F.col("kind") == 1, F.col("base") + F.col("rank") - 1).otherwise(F.col("base") - F.col("rank"))
    steps = ranked.withColumn("level", level)
    # Within one class every level is met once, so class order is order enough.
    by_level = Window.partitionBy("level").orderBy("seq")
    back = steps.select(
        "kind",
        F.col("id").alias("uid"),
        F.lag("kind").over(by_level).alias("before"),
        F.lag("id").over(by_level).alias("bin"),
        F.lag("part").over(by_level).alias("part"),
    )
    return back.where("kind = -1 and before = 1").select("uid", "bin", "part")


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds bin and offset to pieces (uid, size from 1 to length): gapless from 0 in each bin, at most `length` in sum.

    uids must differ. No pieces: no rows. A bin's number is the uid of the piece that opened it.
    """
    spark = pieces.sparkSession
    folder = work_folder(spark, "pack")
    left = stored(pieces.where(F.col("size") < length).select("uid", "size"), f"{folder}/left")
    placed = pieces.where(F.col("size") >= length).select("uid", "size", F.col("uid").alias("bin"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("part"))
    gaps = None
    done = [placed]
    turn = 0

    def state():
        row = left.agg(F.count(F.lit(1)), F.sum("size"), F.max("size"), F.min("size")).first()
        return row[0], row[1] or 0, row[2] or 0, row[3] or 0

    count, tokens, largest, smallest = state()
    room = 0
    while count:
        turn += 1
        # Pieces over half the length share no sequence; of the others, as many open one as the gaps lack room for.
        big = left.where(F.col("size") > length // 2) if turn == 1 else None
        if big is not None and not big.isEmpty():
            opened = big
        else:
            lacking = max(0, -(-(tokens - room) // length)) if gaps is not None else -(-tokens // length)
            opened = largest_pieces(left, lacking, folder, turn) if lacking else None
        if opened is not None:
            new = opened.select("uid", "size", F.col("uid").alias("bin"), F.lit(turn).alias("round"), F.lit(0).cast("long").alias("part"))
            new = stored(new, f"{folder}/opened-{turn}")
            done.append(new)
            fresh = new.select("bin", (length - F.col("size")).alias("gap"))
            gaps = fresh if gaps is None else gaps.unionByName(fresh)
            left = left.join(new.select("uid"), "uid", "left_anti")
        # Gaps below the smallest piece stay as they are and take no part.
        usable = gaps.where(F.col("gap") >= smallest)
        parts = F.greatest(F.floor(F.col("gap") / largest), F.lit(1).cast("long"))
        split = usable.withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        size = F.when(F.col("part") == 0, F.col("gap") - (F.col("_n") - 1) * largest).otherwise(F.lit(largest))
        found = sweep(left, split.select("bin", "part", size.alias("size")))
        match = stored(left.join(found, "uid").select("uid", "size", "bin", F.lit(turn).alias("round"), "part"), f"{folder}/match-{turn}")
        done.append(match)
        used = match.groupBy("bin").agg(F.sum("size").alias("used"))
        gaps = stored(usable.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), f"{folder}/gaps-{turn}")
        before = count
        left = stored(left.join(match.select("uid"), "uid", "left_anti"), f"{folder}/left-{turn}")
        count, tokens, largest, smallest = state()
        room = gaps.agg(F.sum("gap")).first()[0] or 0
        if count == before and opened is None:
            # Nothing fits although there is room in sum: open for what is left.
            room = 0
            gaps = gaps.where("false")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    inside = Window.partitionBy("bin").orderBy("round", "part", "uid")
    at = out.withColumn("offset", (F.sum("size").over(inside) - F.col("size")).cast("long")).select(F.col("uid").alias("_uid"), "bin", "offset")
    return pieces.join(at, F.col("uid") == F.col("_uid")).drop("_uid")


def largest_pieces(left: DataFrame, n: int, folder: str, turn: int) -> DataFrame:
    """n of the largest pieces. Whole sizes are taken first, the last size by rank."""
    by_size = left.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `length` rows
    need, above, edge = n, None, None
    for row in sorted(by_size, key=lambda r: -r["size"]):
        if row["n"] > need:
            edge = row["size"]
            break
        need, above = need - row["n"], row["size"]
    whole = left.where(F.col("size") >= above) if above is not None else left.where("false")
    if edge is None or not need:
        return whole
    return whole.unionByName(left.where(F.col("size") == edge).orderBy("uid").limit(need))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, size, ids_crc32, bin, offset: a row per piece of every document, packed.

    A null or empty text is one piece, end_id alone. Null doc_ids and repeated rows are documents of their own. No
    documents: no rows. Other columns are not read; pieces are written once, without the texts.
    """
    pieces = stored(token_pieces(docs, vocabulary, end_id, length), f"{work_folder(docs.sparkSession, 'pieces')}/pieces")
    return pack(pieces, length).drop("uid")
