"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from assetlens.llm import fill_in_middle, filter_audit
from assetlens.llm.balanced_sharding import op13_balanced_sharding
from assetlens.llm.best_fit_packing import op4_best_two_fit
from assetlens.llm.block_labeller import op1_html_extraction
from assetlens.llm.fill_in_middle import op12_fill_in_middle
from assetlens.llm.filter_audit import op11_filter_audit
from assetlens.llm.jpeg_media import op5_jpeg_media
from assetlens.llm.line_dedup import op2_line_dedup
from assetlens.llm.pivot_search import op3_pivot_topk
from assetlens.llm.pivotal_mixing import op6_pivotal_mixing
from assetlens.llm.seed_extend import op7_seed_extend
from assetlens.llm.simhash_dedup import op9_simhash
from assetlens.llm.suffix_dedup import op10_suffix_dedup
from assetlens.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_line_dedup": op2_line_dedup,
    "op3_pivot_topk": op3_pivot_topk,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_jpeg_media": op5_jpeg_media,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_seed_extend": op7_seed_extend,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_balanced_sharding": op13_balanced_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op3_pivot_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, e.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM whole q JOIN whole e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
