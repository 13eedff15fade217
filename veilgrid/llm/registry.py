"""The operators' queries, by name, and their oracle SQL."""

from __future__ import annotations

from . import oracle
from .ann import op9_posting_lists_ann
from .bpe import op4_word_table_bpe
from .embed_dedup import op7_pq_near_dedup
from .jaccard import op10_grouped_prefix_join
from .packing import op1_dominance_packing
from .shards import op6_stratified_shards
from .suffixes import op3_sparse_suffix_dedup
from .toxicity import op2_ftrl_toxicity
from .training_order import op5_training_order
from .warc import op8_gzip_normaliser

QUERIES = [
    op1_dominance_packing, op2_ftrl_toxicity, op3_sparse_suffix_dedup, op4_word_table_bpe, op5_training_order,
    op6_stratified_shards, op7_pq_near_dedup, op8_gzip_normaliser, op9_posting_lists_ann, op10_grouped_prefix_join,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    """Tokenizers, models and approximate search are beyond it; those are tested against brute force."""
    return {"op6_stratified_shards": oracle.OP6, "op7_pq_near_dedup": oracle.OP7, "op8_gzip_normaliser": oracle.OP8, "op10_grouped_prefix_join": oracle.OP10}
