"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontam import op2_decontamination
from .html_blocks import op9_html_extraction
from .ngram_lm import op7_ngram_lm
from .quality_mcd import op3_quality_mcd
from .simhash import op1_simhash
from .sp_bpe import op5_sentencepiece
from .suffix_dedup import op10_suffix_dedup
from .token_store import op8_token_store
from .toxicity import op6_toxicity
from .warc import op4_warc


def _over(op, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark, *(read_table(spark, sf_dir, t) for t in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": _over(op1_simhash, "documents"),
    "op2_decontamination": _over(op2_decontamination, "documents", "benchmark"),
    "op3_quality_mcd": _over(op3_quality_mcd, "documents"),
    "op4_warc": _over(op4_warc, "pages"),
    "op5_sentencepiece": _over(op5_sentencepiece, "documents"),
    "op6_toxicity_ftrl": _over(op6_toxicity, "documents", "labels"),
    "op7_ngram_lm": _over(op7_ngram_lm, "documents"),
    "op8_token_store": _over(op8_token_store, "documents"),
    "op9_html_extraction": _over(op9_html_extraction, "pages"),
    "op10_suffix_dedup": _over(op10_suffix_dedup, "documents"),
}
#: The others need hashes, models or libraries that SQL does not have; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN n > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> top THEN top END AS refers_to
FROM d LEFT JOIN g ON g.payload_digest = d.payload_digest AND payload_bytes >= 1000
""",
    "op10_suffix_dedup": """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS j FROM t WHERE len(w) >= 50),
g AS (SELECT doc_id, j - 1 AS p, array_to_string(w[j:j + 49], ' ') AS k FROM i),
f AS (SELECT k, min({'d': doc_id, 'p': p}) AS m FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT g.doc_id, g.p, m.d AS rd, m.p AS rp FROM g JOIN f USING (k)),
s AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, rd, rp - p ORDER BY p) AS island FROM r)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(count(*) + 49 AS INTEGER) AS n_words, rd AS rep_doc_id, CAST(min(rp) AS INTEGER) AS rep_start_word, rd = doc_id AND min(rp) = min(p) AS is_first
FROM s GROUP BY doc_id, rd, rp - p, island
""",
}
