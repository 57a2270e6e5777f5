"""Registered queries of the text operators and, where SQL can state one, its DuckDB text."""

from __future__ import annotations

from .audio import op5_chroma
from .chaining import op9_chaining
from .classlm import op4_class_lm
from .decontam import op6_decontamination
from .interaction import op13_interaction
from .licenses import op11_licenses
from .oracles import ORACLE_SQL
from .packing import op8_packing
from .pii import op7_pii
from .resampling import op12_resampling
from .simhash import op3_simhash
from .tokens import op1_token_ids
from .toxicity import op2_toxicity
from .urlgraph import op10_url_graph

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_class_lm": op4_class_lm,
    "op5_chroma": op5_chroma,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_chaining": op9_chaining,
    "op10_url_graph": op10_url_graph,
    "op11_licenses": op11_licenses,
    "op12_resampling": op12_resampling,
    "op13_interaction": op13_interaction,
}


__all__ = ["ORACLE_SQL", "QUERIES"]
