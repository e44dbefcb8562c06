"""The queries of the ten operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as _PIPELINE_SQL
from corpus_pipeline import run as _pipeline

from vexil.llm.bpe import op4_bpe_round_trip
from vexil.llm.langid import op6_language_id
from vexil.llm.neardup_vectors import op2_embedding_near_dedup
from vexil.llm.packing import op7_best_fit_packing
from vexil.llm.quality import op9_quality_classifier
from vexil.llm.secrets import op3_secret_scan
from vexil.llm.simhash import op10_simhash_near_dedup
from vexil.llm.topk import op5_exact_topk
from vexil.llm.toxicity import op8_toxicity
from vexil.llm.urls import op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_exact_topk": op5_exact_topk,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "pipeline": _pipeline,
}

ORACLE_SQL = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
        ), reach AS (
            SELECT vec_id, vec_id AS other FROM v
            UNION
            SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), component AS (
            SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
        )
        SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept
        FROM component c
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
if _PIPELINE_SQL:
    ORACLE_SQL["pipeline"] = _PIPELINE_SQL
