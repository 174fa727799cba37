"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from rankloom.llm import asof, mixing, substrings
from rankloom.llm.asof import op13_point_in_time
from rankloom.llm.embeddings import op2_embedding_near_dedup
from rankloom.llm.licenses import op9_license_scan
from rankloom.llm.media import op3_media_columns
from rankloom.llm.mixing import op7_mixture
from rankloom.llm.packing import op4_cost_balanced_packing
from rankloom.llm.periods import op11_periodic_runs
from rankloom.llm.quality import op8_quality
from rankloom.llm.secrets import op1_secret_scan
from rankloom.llm.simhash import op6_simhash
from rankloom.llm.substrings import op12_substring_dedup
from rankloom.llm.token_files import op5_token_files
from rankloom.llm.toxicity import op10_toxicity

_ALL = (
    op1_secret_scan, op2_embedding_near_dedup, op3_media_columns, op4_cost_balanced_packing, op5_token_files,
    op6_simhash, op7_mixture, op8_quality, op9_license_scan, op10_toxicity,
    op11_periodic_runs, op12_substring_dedup, op13_point_in_time,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict:
    return {"op2_embedding_near_dedup": EMBEDDINGS_SQL, "op7_mixture": mixing.ORACLE_SQL, "op12_substring_dedup": substrings.ORACLE_SQL, "op13_point_in_time": asof.ORACLE_SQL}


#: All pairs, and each vector's reach by a recursive walk.
EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
