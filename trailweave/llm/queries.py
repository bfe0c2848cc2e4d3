"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from trailweave.llm import embeddings
from trailweave.llm.decontaminate import op8_decontamination
from trailweave.llm.embeddings import op1_embedding_near_dedup
from trailweave.llm.langid import op2_language_id
from trailweave.llm.pieces import op3_sentencepiece, op6_token_counts
from trailweave.llm.pii import op9_pii
from trailweave.llm.scratch import own_session
from trailweave.llm.simhash import op7_simhash
from trailweave.llm.substrings import op5_substring_dedup
from trailweave.llm.suffixlm import op10_lm_scoring
from trailweave.llm.toxicity import op4_toxicity

def _bounded(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(own_session(spark), sf_dir)

    return run


QUERIES = {
    f.__name__: _bounded(f)
    for f in (
        op1_embedding_near_dedup, op2_language_id, op3_sentencepiece, op4_toxicity, op5_substring_dedup,
        op6_token_counts, op7_simhash, op8_decontamination, op9_pii, op10_lm_scoring,
    )
}

ORACLE_SQL = {"op1_embedding_near_dedup": embeddings.ORACLE_SQL}
