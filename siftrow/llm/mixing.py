"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents in a shuffled order (the digest of doc_id), again from the start after
each pass, cut into blocks of equally many words. A schedule of slots is laid over the sources: slot j takes a point of
the golden-ratio sequence, the point falls into a source's share of the targets, and the source's k-th slot takes its
k-th block. What the slots reach is the mix, in the order of the slots; nothing else is. Points are spread so evenly that
each source gets its share of slots to within a few, at every length of the schedule, so its words come near its target;
blocks are as small as it takes for `LEAST_SLOTS` slots.

All of it is DataFrame work. Ranks and stream positions are sums over (source, range) before they are sums within one
range, so a source that holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrow.llm.common import running_start, stored, words, work_folder

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words at most so often.
MOST_PASSES = 3
#: Most words in a block, and how many slots a mix has at least, where it has so many words.
BLOCK, LEAST_SLOTS = 1024, 1 << 16
SEED = "mix"
#: The golden ratio's fractional part times 2^31, made odd: multiples modulo 2^31 are the points of the sequence.
STEP, TURN = 1_327_217_885, 1 << 31
#: Slots ranked together, and cells of the unit interval in which a point looks for its source.
CHUNK, CELLS = 4096, 4096


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words (null text: 0), key and tie (place in the shuffled order), bucket (its range)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        key.alias("key"),
        F.xxhash64("text").alias("tie"),
        F.substring(key, 1, 2).alias("bucket"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: the words of all sources shared by weight, no source above 3 times its own.

    Sources fill up in the order of limit by weight. If the first k are full, the others share what is left at one level
    per unit of weight. That level is highest for the right k, so the largest level is the one that holds.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    limit = MOST_PASSES * F.col("source_size")
    by_limit = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    levelled = weighed.withColumn("level", left.cast("double") / F.sum("weight").over(rest).cast("double"))
    level = F.max("level").over(all_rows)
    return levelled.withColumn("_level", level).select(
        "source", "source_size", F.least(limit.cast("double"), F.col("weight").cast("double") * F.col("_level")).alias("target")
    )


def block_words(total: int) -> int:
    """Words in a block of a mix of so many words."""
    return max(1, min(BLOCK, total // LEAST_SLOTS))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """slot, source_no, k: the k-th slot of a source, from 0. goals: source_no, quota (words to take)."""
    by_no = Window.orderBy("source_no")
    shares = goals.where("quota > 0").select(
        "source_no",
        (F.sum("quota").over(by_no) - F.col("quota")).alias("lo"),
        F.sum("quota").over(by_no).alias("hi"),
        F.sum("quota").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    # Bounds on the scale of the points; neighbours share a bound, so each point has one source.
    bound = lambda c: F.floor(F.col(c).cast("double") / F.col("total").cast("double") * TURN)
    shares = shares.select("source_no", bound("lo").alias("lo"), bound("hi").alias("hi"), "total").where("hi > lo")
    width = TURN // CELLS
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    n_slots = goals.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("q")).first()["q"]
    slots = (
        goals.sparkSession.range(-(-n_slots // block))
        .select(F.col("id").alias("slot"), ((F.col("id") % TURN) * STEP % TURN).alias("x"))
        .withColumn("cell", F.floor(F.col("x") / width))
    )
    drawn = slots.join(cells, "cell").where("x >= lo and x < hi").select("slot", "source_no", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).alias("one"))
    return running_start(drawn, "source_no", "chunk", [F.col("slot")], "one", "k").select("slot", "source_no", F.col("k").cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int | None = None, seed: str = SEED) -> DataFrame:
    """The mix as spans of documents, and a row without words for each document that it leaves out.

    Columns: doc_id, source, size, tie, start (the document's place in its source's stream), source_size, target, turn
    (pass over the source, from 0), first_word and n_words of the span, block (of the source), slot (null: left out). The
    order of the mix is slot, turn, start. A source's last block ends where it has been taken three times.

    A null or empty text has no words and is left out. Null sources are one source, the last. Null doc_ids and repeated
    rows are documents of their own, told apart by start. No documents: no rows. Other columns of docs are not read. Sizes
    are written once to the shared folder. At most one row per slot, document and pass, or block boundary is made.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "mix")
    sizes = stored(sized(docs, seed), f"{folder}/sizes")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    goals = stored(targets(sizes, weights).select("source", "source_size", "target", quota.alias("quota"), number.alias("source_no")), f"{folder}/goals")
    if block is None:
        block = block_words(goals.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("q")).first()["q"])
    slots = stored(schedule(goals, block), f"{folder}/slots")
    reached = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("n_slots"))
    end = F.least(F.coalesce("n_slots", F.lit(0)) * block, MOST_PASSES * F.col("source_size"))
    ends = goals.join(reached, "source_no", "left").withColumn("end", end)

    order: list[Column] = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("tie")]
    placed = running_start(sizes, "source", "bucket", order, "size", "start").select("doc_id", "source", "size", "tie", "start")
    own = ends.select(F.col("source").alias("_source"), "source_size", "target", "end", "source_no")
    placed = placed.join(own, placed["source"].eqNullSafe(own["_source"])).drop("_source")
    # Passes that reach the document: those whose stream position lies before the end of the last slot's block.
    passes = F.when((F.col("size") > 0) & (F.col("start") < F.col("end")), F.ceil((F.col("end") - F.col("start")) / F.col("source_size")))
    turns = placed.withColumn("turn", F.explode_outer(F.sequence(F.lit(0).cast("long"), passes - 1)))
    at = F.col("turn") * F.col("source_size") + F.col("start")
    turns = turns.withColumn("_at", at).withColumn("_end", F.least(at + F.col("size"), F.col("end")))
    cut = turns.withColumn("block", F.explode_outer(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_end") - 1) / block))))
    lo, hi = F.greatest("_at", F.col("block") * block), F.least("_end", (F.col("block") + 1) * block)
    spans = cut.withColumn("first_word", lo - F.col("_at")).withColumn("n_words", F.coalesce(hi - lo, F.lit(0).cast("long"))).drop("_at", "_end", "end")
    # Every block has its slot, since the blocks end where the slots do.
    of_slot = slots.select("slot", F.col("source_no").alias("_no"), F.col("k").alias("_k"))
    out = spans.join(of_slot, (spans["source_no"] == of_slot["_no"]) & (spans["block"] == of_slot["_k"]), "left")
    return out.drop("source_no", "_no", "_k")


def taken_words(spans: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null: left out): one row per document, from `mix_sources`."""
    keys = ["doc_id", "source", "start", "tie", "size", "source_size", "target"]
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(0))
    rows = spans.groupBy(*keys).agg(taken.alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("_rows"))
    # Wordless documents can share a place in the stream; each has one row among the spans.
    copies = F.when(F.col("size") == 0, F.col("_rows")).otherwise(F.lit(1).cast("long"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int | None = None, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: a row per document and pass, whole, with the columns of docs, whatever their names.

    Of the document that a source's last block cuts, the whole is taken if at least half of it is in the mix, else
    nothing. What the mix leaves out is gone. Rows that repeat in docs are taken as often as the mix takes each.
    """
    spans = mix_sources(docs, weights, block, seed).where("slot is not null")
    turns = spans.groupBy("doc_id", "source", "start", "tie", "size", "turn").agg(F.sum("n_words").alias("n")).where("2 * n >= size")
    # Equal rows of docs have equal shares of the rows taken from them.
    counted = turns.groupBy("doc_id", "source", "tie").agg(F.count(F.lit(1)).alias("rows"))
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("t"))
    kinds = Window.partitionBy("doc_id", "source", "t")
    named = named.withColumns({"copy": F.row_number().over(kinds.orderBy("doc_id")), "of": F.count(F.lit(1)).over(kinds)}).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("t") == F.col("tie"))
    share = F.floor(F.col("rows") / F.col("of")) + F.when(F.col("copy") <= F.col("rows") % F.col("of"), 1).otherwise(0)
    joined = named.join(counted.alias("c"), on).select("row", share.alias("share")).where("share > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share")))).select("row.*")
