"""Exact similarity join on word shingles by prefix filters under several global orders.

A document's set is that of its five-word shingles. Two sets of Jaccard similarity t or more must share one of their first
n - ceil(t n) + 1 tokens (n: the size of the set) under *any* order of all tokens. Candidates are pairs that share a prefix
token under a first order, and under two more; what is left after all three filters is compared in full.

- Documents with equal sets are one class; all later work is on classes.
- The first order puts tokens that are frequent within some task at the end, so passages that many documents share do not
  make candidates. Which tokens those are is found in the first pass; at most `FREQUENT` of them are kept, the most
  frequent, and they alone are sent to all tasks (2 MB). Any choice gives the same links.
- A token's place counts too: if it is the first that two sets share, they share no more than follows it in either. A pair
  is a candidate through a token only if that is enough.
- Within the classes that share a token, the one whose tokens are the most frequent on average, and of such the largest, is
  the pivot: in a crowd of near copies, the text they are copies of. Every class is compared with its pivots. A class that is
  then in another component than most of the group, and no other, is compared with the others. A crowd costs about as many
  comparisons as it has members.
- Tokens that the same classes hold, such as those of one passage, are met once. Two such classes are then compared only if
  their prefixes share as many tokens as two linked sets of their sizes must.
- A frequent token's classes are dealt over groups by hash, and its pivot is the best of the groups' ones, so no task holds
  a whole crowd.

Nothing is capped: every pair that could be linked is compared or already connected. The two further filters look at the
prefixes alone, before any set moves. Sets of candidate classes are built once and written; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrow.llm.bytes import LOWER, U, mix, prefix_hashes, slices, span_hashes, word_spans
from siftrow.llm.common import stored, work_folder
from siftrow.llm.components import connected_components

SIZE = 5
#: Least similarity in percent.
PERCENT = 75
#: Most tokens that the first order puts last, and how often a task must meet a token for that.
FREQUENT, OFTEN = 1 << 18, 3
#: Seeds of the orders that candidates must pass after the first.
MORE_ORDERS = (0x1B873593, 0xCC9E2D51)
#: Groups that the classes of a frequent token are dealt over.
GROUPS = 64
#: Partners of one class that one task compares, about.
PARTNERS = 256
#: Classes that a task remembers to have sent.
SENT = 1 << 17
#: Bits of a token that candidates are joined on; unequal tokens that agree in them only add candidates to compare.
KEY_BITS = 40
#: Bits of the map of documents whose sets are built. Where it fills up, more sets are built than needed, never fewer.
MAP_BITS = 1 << 26


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different tokens of every text, one text after another, and their bounds.

    A text of fewer words is one token; one without words has none.
    """
    starts, ends, bounds = word_spans(data, offsets)
    words = span_hashes(prefix_hashes(LOWER[data]), starts, ends)
    counts = np.diff(bounds)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), made)
    first = np.repeat(bounds[:-1], made) + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    token = np.zeros(len(text), U)
    length = np.minimum(counts, size)[text]
    for k in range(size):
        has = k < length
        part = words[np.minimum(first + k, max(len(words) - 1, 0))] if len(words) else token
        token = np.where(has, mix(token * U(0x100000001B3) + part), token)
    token = mix(token ^ length.astype(U))
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[new], text[new]
    return token, np.searchsorted(text, np.arange(len(counts) + 1))


def class_ids(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal ones. 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(token ^ U(0xA5A5A5A5)))])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    size = np.diff(bounds).astype(U)
    return np.where(size > 0, mix(total ^ mix(size)), U(0)).view(np.int64)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def ordered_prefixes(token: np.ndarray, bounds: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the prefixes by ascending rank, the text of each, and how many tokens of its set follow, itself included."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rank, text))
    place = np.arange(len(token)) - np.repeat(bounds[:-1], n)
    kept = place < prefix_length(n, percent)[text]
    return token[order][kept], text[kept], (n[text] - place)[kept]


def word_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """A row per whole text: doc_id, n (tokens in the set), cls (number of the set). Between them rows of token and often:
    tokens that some stretch of a task holds in many different sets, and how often."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        names = ["doc_id", "n", "cls", "token", "often"]

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(gathered), return_counts=True)
            kept = n >= OFTEN
            none = pa.nulls(int(kept.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(token[kept].view(np.int64)), pa.array(n[kept], pa.int64())], names=names)

        for batch in batches:
            ids = batch.column("doc_id")
            for data, offsets, at in slices(batch.column("text")):
                token, bounds = shingles(data, offsets, size)
                rows = len(offsets) - 1
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, rows), pa.array(np.diff(bounds), pa.int64()), pa.array(class_ids(token, bounds)), none, none], names=names
                )
                gathered.append(token)
                if sum(map(len, gathered)) > 1 << 22:
                    yield counted()
                    gathered = []
        if gathered:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, n long, cls long, token long, often long")


def frequent_tokens(found: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens of rows (token, often), and their frequencies in sixteenths of an octave; at most FREQUENT, the most
    frequent, but for such as are equally frequent."""
    counts = stored(found.groupBy("token").agg(F.sum("often").alias("n")), f"{folder}/frequent")
    # Frequencies on a scale of sixteenths of an octave: a bounded number of rows.
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    by_step = {r["step"]: r["tokens"] for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens")).collect()}
    least, room = None, FREQUENT
    for at in sorted(by_step, reverse=True):
        room -= by_step[at]
        if room < 0:
            break
        least = at
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    kept = counts.where(step >= least).select("token", step.alias("step")).toArrow()
    tokens = kept.column("token").to_numpy().view(U)
    order = np.argsort(tokens)
    return tokens[order], kept.column("step").to_numpy()[order].astype(np.int64)


def prefix_tokens(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """key, cls, n, left, rare: the prefix of every set under the first order (frequent tokens last, then by number).

    key: KEY_BITS of the token, and for a frequent one the group of the class beyond them. left: tokens of the set from this
    one on. rare: less the mean frequency of the set's tokens (in 256ths of an octave, 0 for those not in frequent), so the
    text that many others are copies of has the least. A class is sent once by a task.
    """
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(1, np.int64)
        for batch in batches:
            for data, offsets, _ in slices(batch.column("text")):
                token, bounds = shingles(data, offsets, size)
                cls, n = class_ids(token, bounds), np.diff(bounds)
                own, first = np.unique(cls, return_index=True)
                new = ~np.isin(own, sent, assume_unique=True)
                # What a task remembers is bounded; a class that is sent again changes nothing.
                sent, first = own if len(sent) > SENT else np.union1d(sent, own), np.sort(first[new])
                pick = np.zeros(len(n), bool)
                pick[first] = True
                token, n, cls = token[np.repeat(pick, n)], n[pick], cls[pick]
                bounds = np.concatenate([[0], np.cumsum(n)])
                often, steps = last.value
                at = np.minimum(np.searchsorted(often, token), max(len(often) - 1, 0))
                is_often = often[at] == token if len(often) else np.zeros(len(token), bool)
                usual = np.concatenate([[0], np.cumsum(np.where(is_often, steps[at], 0) if len(often) else is_often)])
                rare = -(16 * (usual[bounds[1:]] - usual[bounds[:-1]]) // np.maximum(n, 1))
                rank = (token >> U(1)) | (is_often.astype(U) << U(63))
                kept, text, left = ordered_prefixes(token, bounds, rank, percent)
                key = (kept >> U(64 - KEY_BITS)).view(np.int64)
                at = np.minimum(np.searchsorted(often, kept), max(len(often) - 1, 0))
                grouped = often[at] == kept if len(often) else np.zeros(len(kept), bool)
                key[grouped] |= (1 + (cls[text[grouped]] & (GROUPS - 1))) << KEY_BITS
                columns = [pa.array(key), pa.array(cls[text]), *(pa.array(x, pa.int32()) for x in (n[text], left, rare[text]))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "cls", "n", "left", "rare"])

    return docs.select("text").mapInArrow(tokens, "key long, cls long, n int, left int, rare int")


def document_map(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed doc_ids of ids, at most MAP_BITS of them: 8 MB however many documents there are."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)) + 1
    parts = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(MAP_BITS // 8 + 4096, np.uint8)
    for row in parts.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        start = (row["part"] - 1) * 4096
        out[start : start + len(bits)] = bits
    return out


def packed(token: np.ndarray, bounds: np.ndarray, kind: str) -> pa.Array:
    """Numbers as one binary value per set."""
    flat = np.ascontiguousarray(token.astype(kind))
    ends = pa.array(bounds * flat.itemsize, pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, ends.buffers()[1], pa.py_buffer(flat)]).cast(pa.binary())


def further_prefixes(token: np.ndarray, bounds: np.ndarray, percent: int) -> list[pa.Array]:
    """For each further order the sorted upper halves of the prefix tokens' ranks, one binary value per set."""
    out = []
    for seed in MORE_ORDERS:
        rank = mix(token ^ U(seed))
        # Of the ranks themselves, as mixing is a bijection.
        kept, text, _ = ordered_prefixes(rank, bounds, rank, percent)
        out.append(packed(kept >> U(32), np.searchsorted(text, np.arange(len(bounds))), "<u4"))
    return out


def class_sets(docs: DataFrame, chosen: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """cls, tokens (sorted, 64 bits each), f1, f2 (prefixes under the further orders) of documents, at least of those in
    chosen (doc_id). Texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(document_map(chosen))
    rows = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("at"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            wanted = (bits[at >> 3] >> (at & 7)) & 1
            if not wanted.any():
                continue
            for data, offsets, _ in slices(batch.column("text").filter(pa.array(wanted.astype(bool)))):
                token, bounds = shingles(data, offsets, size)
                columns = [pa.array(class_ids(token, bounds)), packed(token, bounds, "<u8"), *further_prefixes(token, bounds, percent)]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "tokens", "f1", "f2"])

    return rows.mapInArrow(sets, "cls long, tokens binary, f1 binary, f2 binary").where("cls <> 0")


def together(pairs: DataFrame, values: DataFrame, columns: list[str], judge: Callable, result: str) -> DataFrame:
    """a, b and a number, what judge makes of the values (cls and columns) of both, for pairs a, b of classes.

    Each class moves to the places of its partners, and all pairs of one a follow its values. Values that no pair names
    stay where they are, as far as a map of bounded size tells.
    """
    # A class of very many partners is dealt over several tasks, each with the values of a.
    many = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / PARTNERS) + 1).alias("parts"))
    ends = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    heads = ends.select("a", F.col("a").alias("b"), "salt").distinct()
    named = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    held = in_map(values.select(F.col("cls").alias("b"), *columns), "b", document_map(named.distinct()))
    # Merged at every size: pairs grow with the documents, so they are never sent to all tasks.
    rows = heads.unionByName(ends).join(held.hint("merge"), "b").select("a", "salt", "b", *columns, (F.col("a") != F.col("b")).alias("partner"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x = None, None
        for batch in batches:
            ends = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), strict=True)
            data = [batch.column(c) for c in columns]
            out = []
            for i, (a, part, b) in enumerate(ends):
                y = [c[i].as_buffer() for c in data]
                if a == b:
                    key, x = (a, part), y
                elif key == (a, part):
                    out.append((a, b, judge(x, y)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), (result, pa.int64())])
    # Copies of a class have its values too: one answer per pair.
    return rows.drop("partner").mapInArrow(compare, f"a long, b long, {result} long").dropDuplicates(["a", "b"])


def in_map(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose number may be among those of a `document_map`."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy(zero_copy_only=False)
            wanted = (shared.value[at >> 3] >> (at & 7)) & 1
            if wanted.any():
                yield batch.drop_columns("_at").filter(pa.array(wanted.astype(bool)))

    return rows.withColumn("_at", F.pmod(F.xxhash64(column), F.lit(MAP_BITS))).mapInArrow(pick, rows.schema)


def share_prefixes(x: list, y: list) -> int:
    """1 if two classes share a prefix token under every further order, else 0."""
    return int(all(_common(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in zip(x, y, strict=True)))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def verify(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """a, b, shared (tokens in both) of the candidate pairs (different, each once) that pass all filters.

    The filters of the further orders are intersected first, on the prefixes alone; whole sets move for pairs that pass all.
    Both steps are written to folder.
    """
    passed = stored(together(pairs, sets, ["f1", "f2"], share_prefixes, "passed").where("passed = 1").select("a", "b"), f"{folder}/passed")

    def shared(x: list, y: list) -> int:
        return _common(np.frombuffer(x[0], "<u8"), np.frombuffer(y[0], "<u8"))

    return stored(together(passed, sets, ["tokens"], shared, "shared"), f"{folder}/shared")


def linked(compared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, b of the compared pairs (a, b, shared) that are alike enough. sizes: cls, n."""
    both = compared.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("_na")), "a")
    both = both.join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("_nb")), "b")
    return both.where(100 * F.col("shared") >= percent * (F.col("_na") + F.col("_nb") - F.col("shared"))).select("a", "b")


def enough(left: Column, right: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether two sets of n and m tokens can be linked if they share none before a token with so many left in either."""
    return F.least(left, right).cast("long") * (100 + percent) >= (n.cast("long") + m) * percent


def held_tokens(judged: DataFrame) -> DataFrame:
    """cls, held (its tokens in judged, sorted), weights (how many tokens each stands for)."""
    listed = judged.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("held"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("held")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            token, weight = (c.to_numpy() for c in lists.flatten().flatten())
            columns = [batch.column("cls"), *(packed(c, bounds - bounds[0], "<i8") for c in (token, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "held", "weights"])

    return listed.mapInArrow(pack, "cls long, held binary, weights binary")


def weigh(x: list, y: list) -> int:
    """How many tokens two classes have in common, of those in `held_tokens`."""
    (ours, weights), theirs = (np.frombuffer(v, "<i8") for v in x), np.frombuffer(y[0], "<i8")
    return int(weights[theirs[np.minimum(np.searchsorted(theirs, ours), len(theirs) - 1)] == ours].sum())


def enough_in_prefixes(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, common) whose first prefixes share enough tokens for a link.

    What two sets share beyond the prefix that ends first lies in the rest of that set, and what they share in it lies in
    the other prefix too.
    """
    both = pairs.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("_na")), "a")
    both = both.join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("_nb")), "b")
    rest = F.floor((F.greatest("_na", "_nb") * percent + 99) / 100) - 1
    return both.where((F.col("common") + rest) * (100 + percent) >= (F.col("_na") + F.col("_nb")) * percent).select("a", "b")


def linked_classes(docs: DataFrame, base: DataFrame, frequent: tuple[np.ndarray, np.ndarray], folder: str, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """a, b: links between classes, enough to connect all that are connected. base: doc_id, n, cls of docs, written."""
    # Rows of one key in order, pivot first; a key of one class goes.
    in_key = Window.partitionBy("key").orderBy("rare", F.desc("n"), "cls")
    first = {c: F.first(c).over(in_key) for c in ("cls", "n", "left")}
    tokens = prefix_tokens(docs, frequent, percent, size).withColumns(
        {"pivot": first["cls"], "pn": first["n"], "pleft": first["left"], "more": F.lead("cls").over(in_key)}
    )
    grouped = F.col("key") >= 1 << KEY_BITS
    members = tokens.where((F.col("cls") != F.col("pivot")) | (F.col("more") != F.col("cls")) | grouped)
    members = members.withColumns({"token": F.col("key").bitwiseAND((1 << KEY_BITS) - 1), "grouped": grouped})
    members = stored(members.drop("more", "key"), f"{folder}/members")
    # The best of the groups' pivots is the frequent token's: GROUPS rows of one token at most, FREQUENT tokens in all.
    in_token = Window.partitionBy("token").orderBy("rare", F.desc("n"), "cls")
    heads = members.where(F.col("grouped") & (F.col("cls") == F.col("pivot"))).dropDuplicates(["token", "cls"])
    best = {c: F.first(c).over(in_token).alias(f"best_{c}") for c in ("cls", "n", "left")}
    best = stored(heads.select("token", *best.values()).distinct(), f"{folder}/best")
    with_best = members.join(F.broadcast(best), "token", "left")
    pivot, pn, pleft = (F.when(F.col("grouped"), F.col(f"best_{c}")).otherwise(F.col(p)) for c, p in (("cls", "pivot"), ("n", "pn"), ("left", "pleft")))
    possible = enough(F.col("left"), pleft, F.col("n"), pn, percent)
    # Of two classes the same one is the pivot under every token, so no pair is there from both ends.
    pairs = with_best.where((F.col("cls") != pivot) & possible).select(pivot.alias("a"), F.col("cls").alias("b"))
    pairs = stored(pairs.distinct(), f"{folder}/pairs")
    sets = chosen_sets(docs, base, _named(pairs), f"{folder}/sets", percent, size)
    sizes = stored(members.groupBy("cls").agg(F.max(F.col("n").cast("long")).alias("n"), F.max(F.when(F.col("grouped"), F.col("left"))).alias("usual")), f"{folder}/sizes")
    compared = verify(pairs, sets, f"{folder}/checked")
    links = stored(linked(compared, sizes, percent), f"{folder}/first-links")

    # A token's classes that are not in the component of most of them are compared with all of them that can be linked.
    roots = stored(connected_components(links, f"{folder}/first-roots"), f"{folder}/first-roots/all")
    own = roots.select(F.col("node").alias("cls"), F.col("root").alias("own"))
    # The pivot of a frequent token, and how many rare tokens it has.
    best_of = best.join(sizes, best["best_cls"] == sizes["cls"]).select(
        "token", F.lit(True).alias("grouped"), F.col("best_cls").alias("pivot"), (sizes["n"] - F.col("usual")).alias("odd")
    )
    placed = members.select("token", "cls", "n", "left", "grouped").distinct().join(own, "cls", "left").withColumn("own", F.coalesce("own", "cls"))
    placed = stored(placed, f"{folder}/placed")
    # Sums over the classes of a token tell tokens that are held by the same ones.
    half = F.xxhash64("cls")
    sums = {"low": half.bitwiseAND(0xFFFFFFFF), "high": F.shiftright(half, 32)}
    most = placed.groupBy("token", "own").agg(
        F.count(F.lit(1)).alias("held"), F.max("grouped").alias("usual"), *(F.sum(h).alias(c) for c, h in sums.items())
    )
    most = most.groupBy("token").agg(
        F.max(F.struct("held", "own"))["own"].alias("most"),
        F.count(F.lit(1)).alias("parts"),
        F.max("usual").alias("usual"),
        *(F.sum(c).alias(c) for c in ("held", "low", "high")),
    )
    # Tokens whose classes lie in one component need no more. Of rare tokens with the same classes the first one in the order
    # stands for all: it has the most left in each class. weight: how many it stands for.
    alone = F.when(F.col("usual"), F.col("token")).alias("alone")
    most = most.where("parts > 1").groupBy(alone, "held", "low", "high", "most").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight"))
    judged = placed.join(most.select("token", "most", "weight"), "token").withColumn("far", F.col("own") != F.col("most"))
    # What a class shares with the pivot of a frequent token, and how many other frequent tokens it has.
    judged = judged.join(F.broadcast(best_of), ["token", "grouped"], "left").join(sizes.select("cls", "usual"), "cls")
    judged = judged.join(compared.select(F.col("a").alias("pivot"), F.col("b").alias("cls"), "shared"), ["pivot", "cls"], "left")
    same = F.when(F.col("cls") == F.col("pivot"), F.col("n").cast("long")).otherwise(F.col("shared"))
    # What it shares may be rare tokens of the pivot, which then do not count among its frequent ones.
    judged = judged.withColumn("same", same).withColumn("other", F.greatest(F.col("usual") - F.col("same") + F.col("odd"), F.lit(0)))
    judged = stored(judged.select("token", "weight", "cls", "n", "left", "own", "far", "grouped", "same", "other"), f"{folder}/judged")
    distant = judged.where("far").select("token", *(F.col(c).alias(f"x_{c}") for c in ("cls", "n", "left", "own", "same", "other")))
    # Two distant ones meet from both ends; one of them is enough.
    once = ~F.col("far") | (F.col("x_cls") < F.col("cls"))
    possible = enough(F.col("x_left"), F.col("left"), F.col("x_n"), F.col("n"), percent)
    # A pair that shares a rare token is met there, as rare ones come first. Here only frequent tokens can be shared: those
    # of the pivot, no more than either has, and others, no more than either has.
    most_shared = F.least("x_same", "same") + F.least("x_other", "other")
    by_pivot = F.coalesce(most_shared * (100 + percent) >= (F.col("x_n").cast("long") + F.col("n")) * percent, F.lit(True))
    across = distant.join(judged, "token").where((F.col("x_own") != F.col("own")) & once & possible & (~F.col("grouped") | by_pivot))
    across = across.select(F.least("x_cls", "cls").alias("a"), F.greatest("x_cls", "cls").alias("b")).distinct()
    known = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = stored(across.join(known, ["a", "b"], "left_anti"), f"{folder}/met")
    held = stored(held_tokens(judged), f"{folder}/held")
    across = stored(enough_in_prefixes(together(met, held, ["held", "weights"], weigh, "common"), sizes, percent), f"{folder}/across")
    missing = _named(across).join(_named(pairs), "cls", "left_anti")
    if not missing.isEmpty():
        sets = sets.unionByName(chosen_sets(docs, base, missing, f"{folder}/more-sets", percent, size))
    return links.unionByName(linked(verify(across, sets, f"{folder}/checked-across"), sizes, percent))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def chosen_sets(docs: DataFrame, base: DataFrame, classes: DataFrame, folder: str, percent: int, size: int) -> DataFrame:
    """`class_sets` of one document of each class, written."""
    chosen = base.join(classes, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    return stored(class_sets(docs, stored(chosen, f"{folder}/chosen"), percent, size), f"{folder}/rows")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, class_id (number of its set), component_id: a row per document.

    component_id is the smallest doc_id that links reach, its own included. A null text, an empty one and one without words
    have an empty set: they are linked with nothing and are their own component. Equal sets are linked. A null doc_id is
    not counted among the smallest; a document in a group of such alone has none. Repeated rows are linked like copies. No
    documents: no rows. Columns of docs other than doc_id and text are not read.
    """
    folder = work_folder(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    found = stored(word_sets(docs, size), f"{folder}/base")
    base = found.where("n is not null").select("doc_id", "n", "cls")
    frequent = frequent_tokens(found.where("token is not null").select("token", "often"), folder)
    links = stored(linked_classes(docs, base, frequent, folder, percent, size), f"{folder}/links")
    roots = stored(connected_components(links, f"{folder}/components"), f"{folder}/roots")
    least = base.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    rooted = least.join(roots, least["cls"] == roots["node"], "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    rooted = stored(rooted, f"{folder}/classes")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of_class = rooted.join(smallest, "root").select(F.col("cls").alias("_cls"), "component")
    out = base.join(of_class, F.col("cls") == F.col("_cls"), "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), own.alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """docs without the documents that a smaller doc_id is linked to, directly or through others.

    Rows of equal doc_id are one document and stay or go together by their texts' groups; rows without an id stay.
    """
    found = jaccard_components(docs, percent, size).where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
