"""The similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftrow.llm.common import read
from siftrow.llm.jaccard import jaccard_components
from siftrow.llm.queries.registry import query


@query(r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     shingled AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS t FROM worded),
     sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
     shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingled x JOIN shingled y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
     reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
""")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
