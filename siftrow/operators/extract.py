"""Extraction: by declarative rules inside the JVM, or by a function of the user."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.errors import GuardError
from siftrow.functions import sql
from siftrow.functions.text import NOT_AVAILABLE, VALUE_SEPARATOR
from siftrow.operators.catalog import DEFAULT_CATALOG, MAX_CATALOG_ROWS, Catalog, batch_fingerprints
from siftrow.operators.requests import REQUEST_FRAME

MAX_ATTEMPTS = 5
#: Documents whose calls and answers a task holds at a time, and bytes of their texts; a longer text stands alone.
DOCUMENTS_AT_A_TIME, TEXT_BYTES_AT_A_TIME = 256, 4 << 20

RESPONSE_FIELDS = (
    T.StructField("batch", T.StringType()),
    T.StructField("batch_ordinal", T.IntegerType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
)


@dataclass(frozen=True)
class Rule:
    """Take ``group`` of ``pattern`` in ``source`` as the value of ``field``.

    With ``every`` all matches are kept, joined as a multi-value cell.
    """

    field: str
    source: str
    pattern: str
    group: int = 1
    every: bool = False


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (field, source, pattern, group, every); they become columns."""
    rows = table.orderBy("field", "source", "pattern").limit(MAX_CATALOG_ROWS + 1).collect()
    if len(rows) > MAX_CATALOG_ROWS:
        raise GuardError(f"at most {MAX_CATALOG_ROWS} rules")
    return tuple(Rule(r.field, r.source, r.pattern, r.group, r.every) for r in rows)


def _rule_value(rule: Rule) -> Column:
    source, pattern = F.col(rule.source), F.lit(rule.pattern)
    if rule.every:
        found = F.regexp_extract_all(source, pattern, F.lit(rule.group))
        value = F.array_join(found, VALUE_SEPARATOR)
    else:
        value = F.regexp_extract(source, rule.pattern, rule.group)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(NOT_AVAILABLE))


def extract_by_rules(
    docs: DataFrame, rules: Sequence[Rule], catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key"
) -> DataFrame:
    """Wide record per document: key and one column per catalog field.

    One projection over the scan, so the text is read once and never shuffled.
    A field without a rule or without a match is ``NA``.
    """
    by_field = {r.field: r for r in rules}
    if len(by_field) < len(rules):
        fields = [r.field for r in rules]
        raise GuardError(f"several rules for one field: {sorted({f for f in fields if fields.count(f) > 1})}")
    unknown = sorted(set(by_field) - {e.field for e in catalog.entries})
    if unknown:
        raise GuardError(f"rules for fields that are not in the catalog: {unknown}")
    return docs.select(
        key,
        *(
            (_rule_value(by_field[e.field]) if e.field in by_field else F.lit(NOT_AVAILABLE)).alias(e.field)
            for e in catalog.entries
        ),
    )


def to_answers(wide: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """Wide record to long answers (key, batch, field, value)."""
    cells = sql.listing(
        f"struct({sql.text(e.batch)} AS batch, {sql.text(e.field)} AS field, {sql.name(e.field)} AS value)"
        for e in catalog.entries
    )
    return wide.select(key, F.expr(f"inline(array({cells}))"))


class TransientError(Exception):
    """Raise this from an extractor for a failure that is worth another attempt."""


TRANSIENT = (TransientError, TimeoutError, ConnectionError)


def exponential_wait(attempt: int) -> float:
    """Seconds after a failed attempt: doubling from 1, held within 2 and 30."""
    return float(min(30, max(2, 2 ** (attempt - 1))))


def pacer(
    seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
) -> Callable[[], None]:
    """A function that returns no sooner than ``seconds`` after it last returned, to whichever thread."""
    last: list[float] = []
    turn = threading.Lock()

    def ready() -> None:
        with turn:
            if last and (rest := last[0] + seconds - clock()) > 0:
                sleep(rest)
            last[:] = [clock()]

    return ready


def _caller(
    extractor: Callable[[Mapping], str],
    transient: tuple[type[BaseException], ...],
    max_attempts: int,
    wait: Callable[[int], float],
    per_task: bool,
    seconds_between_calls: float,
) -> Callable[[Mapping], tuple[str | None, str | None, int]]:
    """Made once per task: a request in, (response, error, attempts) out, whatever the extractor raises."""
    fn = extractor() if per_task else extractor
    ready = pacer(seconds_between_calls)

    def call(row: Mapping) -> tuple[str | None, str | None, int]:
        problem = None
        for attempt in range(1, max_attempts + 1):
            ready()
            try:
                return fn(row), None, attempt
            except transient as exc:
                problem = f"unavailable after {attempt} attempts: {exc}"
                pause = wait(attempt) if attempt < max_attempts else 0
                if pause > 0:
                    time.sleep(pause)
            except Exception as exc:  # one request must never end the run
                return None, f"extraction failed: {exc}", attempt
        return None, problem, max_attempts

    return call


def extract_with(
    requests: DataFrame,
    extractor: Callable[[Mapping], str],
    *,
    key: str = "doc_key",
    transient: tuple[type[BaseException], ...] = TRANSIENT,
    max_attempts: int = MAX_ATTEMPTS,
    wait: Callable[[int], float] = exponential_wait,
    per_task: bool = False,
    seconds_between_calls: float = 0.0,
    system: str | None = None,
) -> DataFrame:
    """Call ``extractor(request_row) -> JSON text`` once per request.

    Returns (key, batch, batch_ordinal, response, error, attempts). A request
    that fails becomes a row with ``error``; the rest go on. Transient errors
    are tried up to ``max_attempts`` times. A row that comes with a non-null
    ``error`` is passed through without a call.

    ``per_task=True`` means ``extractor`` is a factory called once per task,
    for clients that cannot be pickled. ``seconds_between_calls`` is the least
    time from the start of one attempt to the start of the next in a task,
    repeated attempts included. ``system`` is handed over with each request, as
    ``request_row["system"]``. The result should be written before it is used twice, since every
    further action would repeat the calls.
    """
    if max_attempts < 1:
        raise GuardError("max_attempts must be at least 1")
    schema = T.StructType([requests.schema[key], *RESPONSE_FIELDS])
    has_error = "error" in requests.columns
    names = schema.names

    def run_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _caller(extractor, transient, max_attempts, wait, per_task, seconds_between_calls)
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if has_error and row["error"] is not None:
                    answer = (None, row["error"], 0)
                else:
                    if system is not None:
                        row["system"] = system
                    answer = call(row)
                out.append((row[key], row["batch"], row["batch_ordinal"], *answer))
            yield pd.DataFrame(out, columns=names)

    return requests.mapInPandas(run_batches, schema)


# One answer as it comes from the extractor. Its fields are those of RESPONSE_FIELDS and what was asked.
_CALLED = "array<struct<batch:string,batch_ordinal:int,asked:string,response:string,error:string,attempts:int>>"


def few_documents(frame: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ``DOCUMENTS_AT_A_TIME`` rows and ``TEXT_BYTES_AT_A_TIME`` of texts, one row at least."""
    start = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(frame.column(text)), 0).to_pylist()):
        if at > start and (at - start == DOCUMENTS_AT_A_TIME or held + size > TEXT_BYTES_AT_A_TIME):
            yield frame.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < frame.num_rows:
        yield frame.slice(start)


def extract_documents(
    docs: DataFrame,
    extractor: Callable[[Mapping], str],
    catalog: Catalog = DEFAULT_CATALOG,
    *,
    key: str = "doc_key",
    text: str = "text",
    transient: tuple[type[BaseException], ...] = TRANSIENT,
    max_attempts: int = MAX_ATTEMPTS,
    wait: Callable[[int], float] = exponential_wait,
    per_task: bool = False,
    seconds_between_calls: float = 0.0,
    system: str | None = None,
    threads: int = 1,
) -> DataFrame:
    """All batches of each document in one trip: ``docs`` without its text, with ``answers``.

    The text goes to Python once and does not come back; the fan-out happens
    there. ``answers`` has an entry per batch (batch, batch_ordinal, asked,
    response, error, attempts), in catalog order. The extractor sees the same
    request as with :func:`extract_with` (key, batch, batch_ordinal, request,
    system), and the ``text`` beside it.

    Two columns of ``docs`` are obeyed if they are there: a document with a
    non-null ``error`` gets no call and no answers, and neither do the batches
    named by ``have array<string>``, which is not handed on. All other columns
    are. ``threads`` calls run at a time in a task; the extractor must allow
    that. A task holds the calls and answers of ``DOCUMENTS_AT_A_TIME`` documents
    at most, however many rows Spark sends it at once. The other settings are those of :func:`extract_with`, and so is the
    advice to write the result before it is used twice.
    """
    if max_attempts < 1 or threads < 1:
        raise GuardError("max_attempts and threads must be at least 1")
    has_error, has_have = "error" in docs.columns, "have" in docs.columns
    kept = [c for c in docs.columns if c not in (text, "have", "answers")]
    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(f"answers {_CALLED}")])
    asked = batch_fingerprints(catalog, system)
    batches = [(b.name, b.ordinal, b.instruction, asked[b.name]) for b in catalog.batches]
    before, after = REQUEST_FRAME.split("{text}")

    def run_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = _caller(extractor, transient, max_attempts, wait, per_task, seconds_between_calls)

        def ask(question: tuple) -> tuple:
            key_, body, (name, ordinal, instruction, digest) = question
            row = {key: key_, "batch": name, "batch_ordinal": ordinal, "text": body}
            # The request is put together for its call alone.
            row["request"] = instruction + before + body + after
            if system is not None:
                row["system"] = system
            response, error, attempts = call(row)
            return name, ordinal, digest, response, error, attempts

        with ThreadPoolExecutor(threads) as pool:
            each = pool.map if threads > 1 else map
            for frame in (part for whole in frames for part in few_documents(whole, text)):
                keys, texts = frame.column(key).to_pylist(), frame.column(text).to_pylist()
                barred = frame.column("error").is_valid().to_pylist() if has_error else [False] * len(keys)
                have = frame.column("have").to_pylist() if has_have else [None] * len(keys)
                questions = [
                    [(k, body, b) for b in batches if b[0] not in (done or ())] if not stop and body is not None else []
                    for k, body, stop, done in zip(keys, texts, barred, have, strict=True)
                ]
                answered = iter(list(each(ask, (q for of_one in questions for q in of_one))))
                names = ("batch", "batch_ordinal", "asked", "response", "error", "attempts")
                answers = [[dict(zip(names, next(answered), strict=True)) for _ in of_one] for of_one in questions]
                nested = pa.array(answers, _ARROW_ANSWERS)
                yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in kept), nested], names=schema.names)

    columns = [*kept, text, *(["have"] if has_have else [])]
    return docs.select(*columns).mapInArrow(run_batches, schema)


_ARROW_ANSWERS = pa.list_(
    pa.struct(
        [
            ("batch", pa.string()),
            ("batch_ordinal", pa.int32()),
            ("asked", pa.string()),
            ("response", pa.string()),
            ("error", pa.string()),
            ("attempts", pa.int32()),
        ]
    )
)
