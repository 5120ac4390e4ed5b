"""The corpus operators' queries, and the SQL for those that SQL expresses over whole tables."""

from __future__ import annotations

from waymark.llm.contain import op9_decontamination
from waymark.llm.embeddings import op10_embedding_dedup
from waymark.llm.jaccard import op4_jaccard_join
from waymark.llm.langid import op1_language_id
from waymark.llm.lengths import op6_token_counts
from waymark.llm.lm import op8_lm_score
from waymark.llm.oracles import OP4_SQL, OP9_SQL, OP10_SQL
from waymark.llm.pieces import op3_pieces
from waymark.llm.quality import op5_quality
from waymark.llm.secrets import op7_secret_scan
from waymark.llm.urls import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_pieces": op3_pieces,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_lm_score": op8_lm_score,
    "op9_decontamination": op9_decontamination,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op9_decontamination": OP9_SQL, "op10_embedding_dedup": OP10_SQL}
