import pytest

from siftrow import DEFAULT_CATALOG, Catalog, Entry, GuardError, catalog_integrity, header_diff
from siftrow.operators import catalog as catalog_module
from siftrow.operators.catalog import require_header


def test_default_catalog_shape():
    assert len(DEFAULT_CATALOG.columns) == 39
    assert [b.name for b in DEFAULT_CATALOG.batches] == [
        "classification", "bibliographic", "study_context", "participants", "measurements", "subjective_comfort",
        "indexes", "strategies", "modeling", "review", "synthesis",
    ]
    assert [len(b.fields) for b in DEFAULT_CATALOG.batches] == [2, 5, 5, 6, 2, 3, 1, 4, 1, 6, 4]
    assert sum(len(b.fields) for b in DEFAULT_CATALOG.part(synthesis=False)) == 35
    assert DEFAULT_CATALOG.columns[6] == "DOI / Unique Identifier"
    assert all(b.instruction for b in DEFAULT_CATALOG.batches)


def test_default_catalog_is_sound(spark):
    row = catalog_integrity(DEFAULT_CATALOG.to_df(spark)).head().asDict()
    assert row == {
        "columns": 39, "columns_twice": 0, "fields": 39, "fields_twice": 0, "shared_fields": 0, "batches": 11,
        "unmapped": 0,
    }


def test_integrity_finds_faults(spark):
    rows = [(1, "A", "a", "x"), (2, "A", "b", "x"), (3, "B", "b", "y"), (4, "C", None, "y")]
    df = spark.createDataFrame(rows, "ordinal int, column string, field string, batch string")
    row = catalog_integrity(df).head()
    assert (row.columns_twice, row.fields_twice, row.shared_fields, row.unmapped) == (1, 1, 1, 1)


def test_catalog_from_table_round_trip(spark):
    assert Catalog.of(DEFAULT_CATALOG.to_df(spark)) == DEFAULT_CATALOG


def test_catalog_refuses_repeats_and_size(spark, monkeypatch):
    with pytest.raises(GuardError, match="field"):
        Catalog((Entry("A", "a", "x"), Entry("B", "a", "y")))
    monkeypatch.setattr(catalog_module, "MAX_CATALOG_ROWS", 10)
    with pytest.raises(GuardError, match="at most 10"):
        Catalog.of(DEFAULT_CATALOG.to_df(spark))


EXPECTED = ["Title", "Year", "Journal"]
HEADERS = {
    "equal": ["Title", "Year", "Journal"],
    "missing": ["Title", "Year"],
    "extra": ["Title", "Year", "Journal", "Notes"],
    "swapped": ["Year", "Title", "Journal"],
    "duplicate": ["Title", "Year", "Journal", "Title"],
    "empty cell": ["Title", "", "Journal"],
}


def test_header_diff(spark):
    rows = [(k, i, n) for k, names in HEADERS.items() for i, n in enumerate(names, 1)]
    df = spark.createDataFrame(rows, "doc_key string, ordinal int, name string")
    got = {}
    for r in header_diff(df, EXPECTED).collect():
        got.setdefault(r.doc_key, set()).add((r.kind, r.ordinal, r.name))
    assert got == {
        "missing": {("missing", 3, "Journal")},
        "extra": {("unexpected", 4, "Notes")},
        "swapped": {("moved", 1, "Year"), ("moved", 2, "Title")},
        "duplicate": {("moved", 4, "Title")},
        "empty cell": {("unexpected", 2, ""), ("missing", 2, "Year")},
    }


def test_header_diff_of_empty_headers_and_null_names(spark):
    df = spark.createDataFrame([("null name", 1, "Title"), ("null name", 2, None)], "doc_key string, ordinal int, name string")
    files = spark.createDataFrame([("null name",), ("nothing",)], "doc_key string")
    got = {(r.doc_key, r.kind, r.ordinal, r.name) for r in header_diff(df, EXPECTED, files=files).collect()}
    lacking = {("nothing", "missing", i, n) for i, n in enumerate(EXPECTED, 1)}
    assert got == lacking | {("null name", "unexpected", 2, "")} | {("null name", "missing", i, n) for i, n in enumerate(EXPECTED, 1) if i > 1}


def test_require_header():
    catalog = Catalog(tuple(Entry(c, c.lower(), "b") for c in EXPECTED))
    require_header(HEADERS["equal"], catalog)
    for name in set(HEADERS) - {"equal"}:
        with pytest.raises(GuardError):
            require_header(HEADERS[name], catalog)
    with pytest.raises(GuardError, match="order or repetition"):
        require_header(HEADERS["swapped"], catalog)
