"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from .common import ship_package
from .bpe import op7_bpe
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .iblt import op10_fingerprints
from .lm_score import OP1_SQL, op1_lm_score
from .packing import op8_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op5_quality
from .ranked_search import OP12_SQL, op12_ranked_search
from .sharding import OP11_SQL, op11_sharding
from .simhash import op4_simhash
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op6_toxicity

_QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_sharding": op11_sharding,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}
_SQL = {
    "op1_lm_score": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_sharding": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}


def _run(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _run(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict:
    return dict(_SQL)
