"""Token ids as flat binary files, with offsets, read back through memory maps.

A dataset is a folder of shards. Shard i holds the documents of one range of doc_id, in ascending order, in three files:

- `i.ids`: the token ids of its documents, one after another, unsigned, little-endian, 16 bits wide if the vocabulary and
  the end id have at most 65,536 numbers, else 32 (the shard table names the width);
- `i.off`: signed 64-bit, little-endian; where each document starts in `i.ids`, in ids, and at last the number of ids;
- `i.doc`: signed 64-bit, little-endian; the doc_id of each document (the smallest number stands for null).

A shard's task writes under names of its own and renames them at the end, so a lost or repeated attempt leaves whole files
only, and the same ones. Each task returns its number of documents and ids; prefix sums over these give every shard's base,
the number of ids before it. Any file system that pyarrow knows by its address can hold a dataset; files on local or
mounted paths are memory-mapped, others are read as streams.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.llm.bytes import slices, worker_memory
from siftrow.llm.common import stored

NO_ID = -(1 << 63)
#: Documents per shard, about; it sets the number of shards from the number of rows.
ROWS_PER_SHARD = 4096
#: Bytes of words and ids that a worker remembers; beyond, it starts anew.
MEMORY = 48 << 20
#: Bytes of text that are handled together; a longer text stands alone, whole.
SLICE = 8 << 20
META = "shard long, docs long, ids long, base long, width int"


class Encoder:
    """Texts to ids (unsigned 32-bit), as the tokenizers library gives them for whole texts.

    Both kinds of vocabulary split a text into words before they merge, so a word that has been seen need not be encoded
    again. Texts are cut where every tokenizer of the kind cuts them too: before a blank that follows something else, and
    between a letter and a mark (both ASCII). The pieces of a slice become a dictionary, only its unknown entries are
    encoded, and the ids of all pieces are gathered from one array. A text that holds a special token or white space
    beyond ASCII blanks, which could be cut elsewhere, is encoded whole. kind "word": white space is dropped. kind "byte":
    a blank belongs to the word after it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = next(iter(added.items()), None)
        self.odd = "|".join([_WIDE_SPACE, *[re.escape(x) for x in added]])
        form = self.tokenizer.pre_tokenizer.__getstate__()
        self.kind = "byte" if b'"type":"ByteLevel"' in form[:40] else "word"
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that hold no special token, and how many each has: many in one text, with a special token between."""
        if not self.between:
            ids = self.whole(words)
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        token, mark = self.between
        runs = [words[lo : lo + 1024] for lo in range(0, len(words), 1024)]
        ids = np.concatenate([np.array([*self.tokenizer.encode(token.join(r), add_special_tokens=False).ids, mark], np.uint32) for r in runs])
        ends = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(ends, prepend=-1) - 1

    def width(self, end_id: int) -> int:
        """Bytes that hold every id."""
        return 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def learn(self, words: pa.Array) -> None:
        """Remember the ids of words that are not known yet, in this order."""
        ids, lengths = self.apart(words.cast(pa.large_string()).to_pylist())
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.known = pa.concat_arrays([self.known, words])
        self.flat = np.concatenate([self.flat, ids])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut, one after another, and where each text's begin (one number more than texts)."""
        if self.kind == "word":
            data = _SPACED[data]
        kind = _KIND[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = ((kind[1:] == _GAP) & (kind[:-1] != _GAP)) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        edges = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        if self.known.nbytes + self.flat.nbytes > MEMORY:
            self.forget()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        at = place.fill_null(0).to_numpy().astype(np.int64)
        if place.null_count:
            new = place.is_null()
            at[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(place.null_count)
            self.learn(coded.dictionary.filter(new))
        each = at[coded.indices.to_numpy()]
        lengths = self.lengths[each]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(before[-1]) + np.repeat(self.starts[each] - before[:-1], lengths)]
        return ids, before[np.searchsorted(starts, offsets)]

    def encode(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a column of texts: number of the first text, ids of all its texts, where each begins (and the end).

        A null text is empty. With end_id each text's ids end with it.
        """
        column = column.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        for data, offsets, at in slices(column, SLICE):
            n = len(offsets) - 1
            rows = np.flatnonzero(whole[at : at + n])
            if len(rows):
                # Cut texts and whole ones, put back in order.
                sizes = np.diff(offsets)
                sizes[rows] = 0
                rest = data[np.repeat(~whole[at : at + n], np.diff(offsets))]
                cut, bounds = self.plain(rest, np.concatenate([[0], np.cumsum(sizes)]))
                parts = [cut[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for row, ids in zip(rows, self.whole(column.take(pa.array(at + rows)).to_pylist()), strict=True):
                    parts[row] = ids
                ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            else:
                ids, bounds = self.plain(data, offsets)
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
            yield at, ids, bounds


_LETTER, _GAP, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _GAP
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[9, 10, 11, 12, 13]] = 32
# White space other than ASCII blanks.
_WIDE_SPACE = r"[\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; one for all tasks of a worker."""
    return worker_memory(f"encoder {path}", lambda: Encoder(path))


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address or a plain path."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return pafs.LocalFileSystem(), folder


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Encode every whole text, add end_id to each, write the dataset in ascending doc_id; returns its shard table.

    The table (shard, docs, ids, base) is written to `folder`/shards. A null text is empty: its only id is end_id. A null
    doc_id comes first. Rows of equal doc_id stand in order of their text. No documents: an empty shard table and no file.
    Other columns are not read. Texts are shuffled once, by range of doc_id.
    """
    spark = docs.sparkSession
    n = docs.count()
    shards = max(1, -(-n // rows_per_shard))
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartitionByRange(shards, by_id)
        .sortWithinPartitions(by_id, "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        made = encoder(vocabulary)
        kind_of_id = f"<u{made.width(end_id)}"
        fs.create_dir(path, recursive=True)
        from pyspark import TaskContext

        # Partitions are ranges in ascending order, so a partition's number is its shard's.
        shard, own, files, docs_in, ids_in = TaskContext.get().partitionId(), uuid.uuid4().hex, {}, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                files = {k: fs.open_output_stream(f"{path}/{shard}.{k}.{own}") for k in ("ids", "off", "doc")}
            for _, ids, bounds in made.encode(batch.column("text"), end_id):
                files["ids"].write(ids.astype(kind_of_id).tobytes())
                files["off"].write((ids_in + bounds[:-1]).astype("<i8").tobytes())
                docs_in, ids_in = docs_in + len(bounds) - 1, ids_in + len(ids)
            files["doc"].write(np.asarray(batch.column("doc_id").fill_null(NO_ID)).astype("<i8").tobytes())
        if files:
            files["off"].write(np.int64(ids_in).tobytes())
            for kind, f in files.items():
                f.close()
                fs.move(f"{path}/{shard}.{kind}.{own}", f"{path}/{shard}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs_in], "ids": [ids_in], "width": pa.array([made.width(end_id)], pa.int32())})

    counts = stored(ordered.mapInArrow(write, "shard long, docs long, ids long, width int"), f"{folder}/counts")
    # One small row per shard: the prefix sums are taken here and kept with the dataset.
    rows, base, table = sorted(counts.collect()), 0, []
    for row in rows:
        table.append((row["shard"], row["docs"], row["ids"], base, row["width"]))
        base += row["ids"]
    return stored(spark.createDataFrame(table, META).coalesce(1), f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str, shards: DataFrame | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (array of long): a row per document of a dataset."""
    return _read(spark, folder, shards, "ids array<long>", lambda view: pa.array([x.astype(np.int64) for x in view], pa.list_(pa.int64())))


def token_digests(spark: SparkSession, folder: str, shards: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document's ids, from the files."""
    return _read(spark, folder, shards, "ids_crc32 long", lambda view: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in view], pa.int64()))


def _read(spark: SparkSession, folder: str, shards: DataFrame | None, column: str, make) -> DataFrame:
    shards = spark.read.schema(META).parquet(f"{folder}/shards") if shards is None else shards
    schema = T.StructType.fromDDL(f"doc_id long, start long, n_tokens long, {column}")

    def view_of(fs: pafs.FileSystem, path: str, kind: str, dtype: str):
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path + kind, dtype, "r")
        with fs.open_input_file(path + kind) as f:
            return np.frombuffer(f.read(), dtype)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{path}/{row['shard']}."
                ids, off, doc = view_of(fs, at, "ids", f"<u{row['width']}"), view_of(fs, at, "off", "<i8"), view_of(fs, at, "doc", "<i8")
                for lo in range(0, len(doc), 1024):
                    hi = min(lo + 1024, len(doc))
                    edges = off[lo : hi + 1]
                    numbers = pa.array(np.asarray(doc[lo:hi]), pa.int64(), mask=np.asarray(doc[lo:hi]) == NO_ID)
                    yield pa.RecordBatch.from_arrays(
                        [
                            numbers,
                            pa.array(np.asarray(edges[:-1]) + row["base"], pa.int64()),
                            pa.array(np.diff(edges), pa.int64()),
                            make([ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]),
                        ],
                        names=schema.names,
                    )

    # A shard per task: each reads three files and keeps none.
    spread = shards.repartition(max(1, min(shards.count(), spark.sparkContext.defaultParallelism * 4)))
    return spread.mapInArrow(scan, schema)
