"""Documents to one tidy table on Spark, driven by a column catalog."""

import sys

from pyspark import cloudpickle

from siftrow.errors import GuardError
from siftrow.functions.text import (
    cap_cell,
    clean_cell,
    fill_na,
    is_blank,
    page_count,
    sanitize_cell,
    truncate_middle,
)
from siftrow.operators.answers import (
    all_or_nothing,
    flatten_row,
    join_synthesis,
    merge_answers,
    merge_batches,
    merge_responses,
    nest,
    parse_answers,
    parse_strict,
)
from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog, Entry, catalog_integrity, header_diff
from siftrow.operators.checks import (
    by_field,
    check_authors,
    check_brief,
    check_grounding,
    check_identifier,
    check_labels,
    check_methodology,
    check_study_type,
    check_vocabulary,
    check_year,
    explode_multi,
    grounding_share,
    label_class,
    label_profile,
    labelled_sections,
)
from siftrow.operators.extract import Rule, TransientError, extract_by_rules, extract_documents, extract_with, to_answers
from siftrow.operators.ledger import (
    document_outcome,
    failures_report,
    fold_ledger,
    outcome,
    pending_documents,
    run_summary,
    run_verdict,
)
from siftrow.operators.pages import assemble_pages, assemble_trimmed, split_pages
from siftrow.operators.requests import SYSTEM_TEXT, fan_out, render_request, request_volume
from siftrow.plans.run import first_per_key, plan_requests, run, run_folder, store_documents
from siftrow.sources.documents import load_text, read_documents, read_header, scan_documents
from siftrow.sources.ledger import (
    compact_ledger,
    import_snapshot,
    read_ledger,
    read_runs,
    read_snapshot,
    vacuum,
    write_snapshot,
)
from siftrow.sources.results import (
    append_results,
    count_output_rows,
    create_empty_output,
    export_csv,
    read_results,
)
from siftrow.streaming.incremental import incremental_run

# Functions sent to Python workers carry this package's code with them, so it
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Catalog",
    "DEFAULT_CATALOG",
    "Entry",
    "GuardError",
    "Rule",
    "SYSTEM_TEXT",
    "TransientError",
    "all_or_nothing",
    "append_results",
    "assemble_pages",
    "assemble_trimmed",
    "by_field",
    "cap_cell",
    "catalog_integrity",
    "check_authors",
    "check_brief",
    "check_grounding",
    "check_identifier",
    "check_labels",
    "check_methodology",
    "check_study_type",
    "check_vocabulary",
    "check_year",
    "clean_cell",
    "compact_ledger",
    "count_output_rows",
    "create_empty_output",
    "document_outcome",
    "explode_multi",
    "export_csv",
    "extract_by_rules",
    "extract_documents",
    "extract_with",
    "failures_report",
    "fan_out",
    "fill_na",
    "first_per_key",
    "flatten_row",
    "fold_ledger",
    "grounding_share",
    "header_diff",
    "import_snapshot",
    "incremental_run",
    "is_blank",
    "join_synthesis",
    "label_class",
    "label_profile",
    "labelled_sections",
    "load_text",
    "merge_answers",
    "merge_batches",
    "merge_responses",
    "nest",
    "outcome",
    "page_count",
    "parse_answers",
    "parse_strict",
    "pending_documents",
    "plan_requests",
    "read_documents",
    "read_header",
    "read_ledger",
    "read_results",
    "read_runs",
    "read_snapshot",
    "render_request",
    "request_volume",
    "run",
    "run_folder",
    "run_summary",
    "run_verdict",
    "sanitize_cell",
    "scan_documents",
    "split_pages",
    "store_documents",
    "to_answers",
    "truncate_middle",
    "vacuum",
    "write_snapshot",
]
