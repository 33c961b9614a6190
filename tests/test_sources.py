import pytest
from pyspark.sql import functions as F

from siftrow.sources import documents as documents_module
from siftrow import (
    DEFAULT_CATALOG,
    Catalog,
    Entry,
    GuardError,
    append_results,
    count_output_rows,
    create_empty_output,
    export_csv,
    first_per_key,
    read_documents,
    read_header,
    read_results,
    scan_documents,
)
from siftrow.operators.catalog import require_header
from siftrow.sources.paths import scratch_folder
from siftrow.sources.results import results_schema
from tests.conftest import plan_of
from tests.test_ledger import write_run


def names(df):
    return [r.doc_key for r in df.collect()]


def touch(folder, *files):
    folder.mkdir(parents=True, exist_ok=True)
    for f in files:
        (folder / f).write_bytes(b"x")


def test_scan_is_sorted_top_level_and_case_sensitive(spark, tmp_path):
    touch(tmp_path, "b.pdf", "a.pdf", "notes.txt", "report.PDF")
    touch(tmp_path / "sub", "nested.pdf")
    touch(tmp_path / "k=v", "part.pdf")
    df = scan_documents(spark, str(tmp_path))
    assert names(df) == ["a.pdf", "b.pdf"]
    assert df.columns == ["doc_key", "path", "length", "modified"]
    assert "content" not in plan_of(df)


def test_scan_of_empty_missing_and_file(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert names(scan_documents(spark, str(tmp_path / "empty"))) == []
    touch(tmp_path / "only nested" / "k=v", "x.pdf")
    assert names(scan_documents(spark, str(tmp_path / "only nested"))) == []
    with pytest.raises(GuardError, match="does not exist"):
        scan_documents(spark, str(tmp_path / "missing"))
    touch(tmp_path, "file.pdf")
    with pytest.raises(GuardError, match="not a folder"):
        scan_documents(spark, str(tmp_path / "file.pdf"))


def test_scan_of_a_folder_with_glob_characters(spark, tmp_path):
    touch(tmp_path / "a[1] {x}", "a b.pdf")
    assert names(scan_documents(spark, str(tmp_path / "a[1] {x}"))) == ["a b.pdf"]


def test_read_documents_isolates_bad_files(spark, tmp_path, monkeypatch):
    """Spark's own listing leaves out files of zero bytes; see the README."""
    (tmp_path / "good.txt").write_text("grün", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "huge.txt").write_bytes(b"y" * 100)
    monkeypatch.setattr(documents_module, "MAX_VALUE_BYTES", 50)
    got = {r.doc_key: (r.text, r.reason) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {
        "good.txt": ("grün", None),
        "bad.txt": (None, "could not open: no readable text"),
        "huge.txt": (None, "could not open: more than the 50 bytes of one value"),
    }


def test_first_per_key(spark):
    rows = [("a", "/y/a", "2"), ("a", "/x/a", "1"), ("b", "/x/b", "3")]
    df = first_per_key(spark.createDataFrame(rows, "doc_key string, path string, text string"))
    assert {(r.doc_key, r.text) for r in df.collect()} == {("a", "1"), ("b", "3")}


def test_header_of_csv_template(spark, tmp_path):
    path = tmp_path / "template.csv"
    path.write_text('Title,,Year,Title,"a, b"\n', encoding="utf-8")
    assert read_header(spark, str(path)) == ["Title", "", "Year", "Title", "a, b"]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(GuardError, match="no header"):
        read_header(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(GuardError, match="PATH_NOT_FOUND"):
        read_header(spark, str(tmp_path / "missing.csv"))


def sample(spark, *keys):
    cells = [F.concat(F.col("doc_key"), F.lit(f"-{i}")).alias(c) for i, c in enumerate(DEFAULT_CATALOG.columns)]
    return spark.createDataFrame([(k,) for k in keys], "doc_key string").select("doc_key", *cells)


def test_results_append_and_visibility(spark, tmp_path):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    assert count_output_rows(spark, out, ledger) == 0
    append_results(sample(spark, "a", "b"), out, "r1")
    assert count_output_rows(spark, out, ledger) == 0
    write_run(spark, ledger, "r1", [("a", "done", None, 1)])
    append_results(sample(spark, "c"), out, "r2")
    assert count_output_rows(spark, out, ledger) == 2
    write_run(spark, ledger, "r2", [("c", "done", None, 1)])
    append_results(sample(spark, "c"), out, "r2")
    rows = read_results(spark, out, ledger).orderBy("doc_key").collect()
    assert [(r.doc_key, r.run_id, r["GMR Brief"]) for r in rows] == [
        ("a", "r1", "a-38"), ("b", "r1", "b-38"), ("c", "r2", "c-38"),
    ]


def test_empty_output_keeps_columns_and_rows(spark, tmp_path):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    create_empty_output(spark, out)
    require_header(read_header(spark, f"{out}/attempt=empty", "parquet")[1:])
    assert count_output_rows(spark, out, ledger) == 0
    append_results(sample(spark, "a"), out, "r1")
    write_run(spark, ledger, "r1", [("a", "done", None, 1)])
    create_empty_output(spark, out)
    assert count_output_rows(spark, out, ledger) == 1
    assert read_results(spark, out, ledger).columns == results_schema().names


def test_export_csv_keeps_cells_as_they_are(spark, tmp_path):
    path = str(tmp_path / "csv")
    cells = [" padded ", 'say "hi", then', "two\nlines", "back\\slash", "plain"]
    catalog = Catalog(tuple(Entry(f"C{i}", f"c{i}", "b") for i in range(len(cells))))
    df = spark.createDataFrame([("k", *cells)], ["doc_key", *catalog.columns])
    export_csv(df, path, catalog)
    assert read_header(spark, path) == list(catalog.columns)
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    assert list(back.head()) == cells


def test_export_csv_has_the_header_and_key_order(spark, tmp_path):
    path = str(tmp_path / "csv")
    export_csv(sample(spark, "b", "a").coalesce(1), path)
    require_header(read_header(spark, path))
    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    assert [r["Title"] for r in rows.collect()] == ["a-2", "b-2"]


class FakeSession:
    """What a session says about folders; everything is looked up, nothing is set."""

    def __init__(self, checkpoint=None, set_by_code=None):
        self.asked = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": "/warehouse"}
        self.set_by_code = set_by_code
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.asked.get(key) or default

    def getCheckpointDir(self):
        return self.set_by_code


def test_scratch_folder_follows_the_session():
    cluster = FakeSession("/shared/place/")
    assert scratch_folder(cluster).startswith("/shared/place/siftrow-")
    assert scratch_folder(cluster) != scratch_folder(cluster)
    assert scratch_folder(FakeSession(set_by_code="/set")).startswith("/set/siftrow-")
    # Never a folder that only one machine sees.
    assert scratch_folder(FakeSession()).startswith("/warehouse/siftrow-")


def test_any_number_of_names_is_read_where_the_names_are(spark, tmp_path, monkeypatch):
    """100,000 names: tasks open the files; the driver never sees a path."""
    from pyspark.sql import functions as F
    from siftrow.sources import documents

    for i in range(10):
        (tmp_path / f"é {i} 100%.txt").write_text(f"text {i}\n" * i)
    (tmp_path / "bad").write_bytes(b"ok \xff")
    (tmp_path / "folder").mkdir()
    name = F.concat(F.lit(f"file:{tmp_path}/é "), (F.col("id") % 10).cast("string"), F.lit(" 100%.txt"))
    names = spark.range(100_000).select(
        F.col("id").cast("string").alias("doc_key"), name.alias("path"), F.lit(5).cast("bigint").alias("length"), F.current_timestamp().alias("modified")
    )
    odd = [("gone", "nowhere.txt", 1), ("bad", "bad", 1), ("folder", "folder", 1), ("huge", "bad", documents.MAX_VALUE_BYTES + 1)]
    more = spark.createDataFrame([(k, f"file://{tmp_path}/{p}", n) for k, p, n in odd], "doc_key string, path string, length bigint")
    monkeypatch.setattr(documents, "BATCH_BYTES", 1000)
    read = documents.read_listed(names.unionByName(more.withColumn("modified", F.current_timestamp())), files_per_task=9_000)
    assert read.columns == ["doc_key", "path", "length", "modified", "text", "reason"]
    rows = read.groupBy("text", "reason").agg(F.count("*").alias("n")).collect()
    texts = {r.text: r.n for r in rows if r.reason is None}
    assert texts == {f"text {i}\n" * i: 10_000 for i in range(10)}
    failed = {r.doc_key: r.reason for r in read.where("reason is not null").collect()}
    assert failed["bad"] == "could not open: no readable text" and "bytes" in failed["huge"] and failed["folder"].startswith("could not open")
    assert read.where("doc_key = 'gone'").count() == 0


def test_files_are_dealt_over_tasks_by_bytes_too(spark, tmp_path, monkeypatch):
    from siftrow.sources import documents

    for i in range(6):
        (tmp_path / f"{i}.txt").write_text("line\n" * 10)
    listing = scan_documents(spark, str(tmp_path), ".txt", ordered=False)
    monkeypatch.setattr(documents, "TASK_BYTES", 100)
    read = documents.read_listed(listing)
    assert read.rdd.getNumPartitions() == 3
    assert sorted((r.doc_key, r.text) for r in read.collect()) == [(f"{i}.txt", "line\n" * 10) for i in range(6)]
    monkeypatch.setattr(documents, "TASK_BYTES", 1)
    assert documents.read_listed(listing).rdd.getNumPartitions() == 6


def test_text_files_stay_small_however_many_documents_there_are(spark, tmp_path, monkeypatch):
    from siftrow.plans.queries import texts

    # Long texts stand together in the table; they must not in a file.
    rows = [(i, ("x" * 400 if i < 60 else "y" * 20) + f"\nend {i}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(texts, "FILE_BYTES", 4_000)
    listing = scan_documents(spark, texts._text_files(spark, str(tmp_path)), ".txt", ordered=False)
    sizes = [r.length for r in listing.collect()]
    assert sum(sizes) == sum(len(t) + 1 for _, t in rows) and max(sizes) < 2 * 4_000
    got = {r.line: r.n for r in texts.lines_of_files(spark, str(tmp_path)).collect()}
    assert got == {"x" * 400: 60, "y" * 20: 240, **{f"end {i}": 1 for i in range(300)}}
