"""Queries of this subpackage for the driver's registry, with their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import pipeline
from tessera.llm.decontaminate import OP4_SQL, op4_decontaminate
from tessera.llm.html_text import op9_html_text
from tessera.llm.hyperminhash import OP12_SQL, op12_hyperminhash
from tessera.llm.importance import OP11_SQL, op11_importance_resampling
from tessera.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from tessera.llm.line_dedup import OP3_SQL, op3_line_dedup
from tessera.llm.packing import op10_best_fit_packing
from tessera.llm.quality import OP1_SQL, op1_quality_rules
from tessera.llm.sharding import OP6_SQL, op6_size_tiered_sharding
from tessera.llm.token_counts import op7_token_counts
from tessera.llm.token_shards import op2_token_shards
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_shards": op2_token_shards,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_size_tiered_sharding": op6_size_tiered_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_html_text": op9_html_text,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hyperminhash": op12_hyperminhash,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline.run,
}

ORACLE = {
    "op1_quality_rules": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op6_size_tiered_sharding": OP6_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_hyperminhash": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
