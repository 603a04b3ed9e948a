"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.htmltext import op8_main_text
from lumenframe.llm.jaccard import op5_jaccard_join
from lumenframe.llm.langid import op2_language_id
from lumenframe.llm.licenses import op9_license_scan
from lumenframe.llm.linedup import op10_line_dedup
from lumenframe.llm.mpegts import op1_transport_streams
from lumenframe.llm.packing import op4_best_fit_packing
from lumenframe.llm.pieces import op7_sentencepiece
from lumenframe.llm.quality import op6_quality_outliers
from lumenframe.llm.tokencount import op3_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_streams": op1_transport_streams,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_outliers": op6_quality_outliers,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_main_text": op8_main_text,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 60 * (zx.n + zy.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles,
  (SELECT count(*) FROM link WHERE link.x = d.doc_id)::BIGINT AS n_similar, min(r.y)::BIGINT AS component_id
FROM documents d LEFT JOIN z USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
""",
}
