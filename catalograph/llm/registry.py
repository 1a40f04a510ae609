"""The corpus queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .decontamination import OP3_SQL, op3_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .language_id import op10_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import op1_mixing
from .multi_index import op12_nearest_neighbours
from .ngram_join import OP8_SQL, op8_ngram_join
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .sharding import op2_sharding
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .toxicity import op4_toxicity
from .url_filter import OP7_SQL, op7_url_filter


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_ngram_join": op8_ngram_join,
        "op9_line_dedup": op9_line_dedup,
        "op10_language_id": op10_language_id,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op8_ngram_join": OP8_SQL,
        "op9_line_dedup": OP9_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
