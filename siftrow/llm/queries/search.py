"""Ranked lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftrow.llm.common import read
from siftrow.llm.lexical import ranked_search
from siftrow.llm.queries.registry import query

# The terms of a table's texts in DuckDB, with repeats.
TERMS = r"""unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""


@query(f"""
WITH held AS (SELECT doc_id, {TERMS.format(text="text")} AS term FROM documents),
     counted AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM held GROUP BY ALL),
     sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
     corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
     weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
                 FROM counted, corpus GROUP BY term),
     asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {TERMS.format(text="text")} AS term FROM benchmark)),
     scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
                FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("item_id", "rank", "doc_id", "score")
