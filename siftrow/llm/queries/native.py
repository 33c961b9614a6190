"""Line dedup, quality rules and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.llm.common import read
from siftrow.llm.line_dedup import dedup_lines
from siftrow.llm.mixing import mix_sources, taken_words
from siftrow.llm.quality_rules import quality_rules
from siftrow.llm.queries.registry import query

# A line's key in DuckDB.
KEY = """translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


@query(f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
     keyed AS (SELECT doc_id, line, pos, {KEY} AS key FROM each),
     held AS (SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key),
     judged AS (SELECT k.*, coalesce(h.n >= 2 AND h.first_doc <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@query("""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                      md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
     sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
     weighed AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sums),
     levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER rest)::DOUBLE AS level
                FROM weighed
                WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                       rest AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
     goals AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w::DOUBLE * max(level) OVER ()) AS target FROM levels),
     placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
     quotas AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM goals),
     cut AS (SELECT sum(quota)::BIGINT AS total, greatest(1, least(1024, sum(quota)::BIGINT // 65536))::BIGINT AS block FROM quotas),
     edges AS (SELECT source, coalesce(sum(quota) OVER before, 0)::DOUBLE AS lo, sum(quota) OVER upto::DOUBLE AS hi FROM quotas WHERE quota > 0
               WINDOW before AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      upto AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     shares AS (SELECT source, floor(lo / total * 2147483648)::BIGINT AS lo, floor(hi / total * 2147483648)::BIGINT AS hi FROM edges, cut),
     points AS (SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS x
                FROM (SELECT unnest(range((total + block - 1) // block))::BIGINT AS slot FROM cut)),
     drawn AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM points JOIN shares ON x >= lo AND x < hi),
     reach AS (SELECT source, count(*) AS n FROM drawn GROUP BY source),
     met AS (SELECT p.doc_id, p.source, p.size, q.source_size, q.target, p.start, least(coalesce(r.n, 0) * block, 3 * q.source_size)::BIGINT AS stop, block
             FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
             LEFT JOIN reach r ON p.source IS NOT DISTINCT FROM r.source CROSS JOIN cut),
     spread AS (SELECT *, CASE WHEN source_size = 0 THEN 0
                  ELSE (stop // source_size) * size + greatest(0, least(size, stop % source_size - start)) END::BIGINT AS taken FROM met)
SELECT s.doc_id, s.size, s.source_size, s.target, s.taken, d.slot AS first_slot
FROM spread s LEFT JOIN drawn d ON s.taken > 0 AND s.source IS NOT DISTINCT FROM d.source AND d.k = s.start // s.block
""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source")))
