"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs. A run is a bucketed table of line hashes, sorted within its buckets, with the document that
first held each line. A batch of documents, later in doc_id than all before it, is deduplicated like this: its distinct
hashes are merge-anti-joined with every run, what is left becomes a run of its own, and a line stays only in a document
that some run names as its first. When a level holds `fan_in` runs they are merged into one run of the next level, so the
number of runs stays logarithmic in the number of batches.

Runs are bucketed by hash in as many buckets as the session has shuffle partitions, so neither the joins nor the merges
shuffle a run. They lie in the warehouse, which all executors share. All work is DataFrame work. A line that very many
documents hold is one row per task after the partial aggregate, and its documents are told apart by (hash, doc_id) in the
final join, so it gathers nowhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.llm.common import BLANKS, lower_ascii, stored, work_folder

#: Shorter keys are left alone.
MIN_KEY = 10
#: Batches that one table is split into, and runs of a level that are merged.
BATCHES, FAN_IN = 4, 3
HASH = ("h1", "h2")


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, pos, h1, h2 of every line whose key is long enough; 128 bits of hash. A null text is one empty line.

    Rows of equal doc_id are told apart by row, the hash of their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.trim(F.col("line"), F.lit(BLANKS))).where(F.length("line") >= MIN_KEY)
    key = lower_ascii(F.col("line"))
    return trimmed.select("doc_id", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineIndex:
    """The runs of all batches so far. Keep one object for a series of batches; `drop` removes its tables."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def runs(self) -> list[str]:
        """Names of the run tables, oldest first."""
        return [name for level in reversed(self.levels) for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        table = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def add(self, lines: DataFrame) -> None:
        """Take in one batch: lines as of `line_hashes`, of documents later than all before."""
        firsts = lines.groupBy(*HASH).agg(F.min("doc_id").alias("first_doc"))
        for run in self.runs():
            firsts = firsts.join(self.spark.table(run).select(*HASH), list(HASH), "left_anti")
        self._write(firsts, 0)
        self._compact()

    def _compact(self) -> None:
        """Merge the runs of every level that is full. Runs hold different hashes, so merging needs no aggregate."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                old, self.levels[level] = self.levels[level], []
                rows = self.spark.table(old[0])
                for run in old[1:]:
                    rows = rows.unionByName(self.spark.table(run))
                # Dealt by hash again, so that each bucket is one file.
                self._write(rows.repartition(self.buckets, *HASH), level + 1)
                for run in old:
                    self.spark.sql(f"DROP TABLE {run}")
            level += 1

    def firsts(self) -> DataFrame:
        """h1, h2, first_doc over all runs."""
        rows = None
        for run in self.runs():
            rows = self.spark.table(run) if rows is None else rows.unionByName(self.spark.table(run))
        return rows

    def drop(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.levels = []


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Last doc_id of each batch but the last one, from approximate quantiles; fewer where ids are few."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """docs with text cut to the lines that stay, and n_lines and n_dropped (lines before, lines dropped).

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least ten code points that several
    documents hold loses all its lines but those in the document of the smallest doc_id; there, all stay. Ties: rows of
    equal doc_id are one document here, so a line that only they share stays in each. A null doc_id is smaller than none:
    such a row keeps only lines that no other document holds, and rows without an id are one document. A null or empty
    text is one empty line and comes out empty. No documents: no rows. Clashing columns n_lines and n_dropped are replaced, and n_chars, where
    docs have it, is the length of the new text.

    The table is taken in `batches` ranges of ascending doc_id. Hashes are computed once and written to the shared folder
    (doc_id, place, 16 bytes). Which lines go is written there too, so the tables of the index are dropped before it
    returns.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "lines")
    lines = stored(line_hashes(docs), f"{folder}/hashes")
    index = LineIndex(spark, fan_in)
    bounds = batch_bounds(docs, batches)
    edges: list[Column] = []
    for i in range(len(bounds) + 1):
        after = F.col("doc_id") > bounds[i - 1] if i else F.col("doc_id").isNotNull()
        edges.append(after & (F.col("doc_id") <= bounds[i]) if i < len(bounds) else after)
    for edge in [*edges, F.col("doc_id").isNull()]:
        index.add(lines.where(edge))

    firsts = index.firsts().select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first_doc").alias("_doc"))
    on = (lines["h1"] == firsts["_h1"]) & (lines["h2"] == firsts["_h2"]) & lines["doc_id"].eqNullSafe(firsts["_doc"])
    gone = (
        lines.join(firsts, on, "left_anti")
        .groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
        .agg(F.collect_set("pos").alias("_gone"))
    )
    gone = stored(gone, f"{folder}/gone")
    index.drop()
    text = F.coalesce(F.col("text"), F.lit(""))
    # The caller's columns travel in one of their own, whatever they are called.
    parts = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("own"), F.split(text, "\n").alias("lines"))
    joined = parts.join(gone, parts["id"].eqNullSafe(gone["_id"]) & (parts["own"] == gone["_row"]), "left")
    # Positions of the lines that stay; a set difference, so a long document takes no longer per line.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.col("lines")[i]))
    out = joined.select("row", "_gone", "lines", F.array_join(kept, "\n").alias("text"))
    results = {
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"),
        "text": F.col("text"),
    }
    if "n_chars" in docs.columns:
        results["n_chars"] = F.length("text").cast("long")
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return out.select(*(results[c].alias(c) if c in results else F.col("row")[c].alias(c) for c in names))
