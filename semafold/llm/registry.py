"""The opN queries and the SQL that states the same result, where SQL can."""

from __future__ import annotations

import functools

from semafold.llm import ann, bpe_chunks, chat_format, exact_dedup, lm_score, minhash_dedup, packing, sharding, suffix_dedup, toxicity
from semafold.llm.common import small_batches

MODULES = [ann, bpe_chunks, chat_format, exact_dedup, lm_score, minhash_dedup, packing, sharding, suffix_dedup, toxicity]


def _run(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(small_batches(spark), sf_dir)

    return run


def queries() -> dict:
    return {k: _run(f) for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
