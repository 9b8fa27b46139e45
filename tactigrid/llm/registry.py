"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from tactigrid.llm.linejoin import op4_line_dedup
from tactigrid.llm.minhash import op7_minhash_dedup
from tactigrid.llm.packing import op5_packing
from tactigrid.llm.quality import op9_quality
from tactigrid.llm.recompress import OP2_SQL, op2_recompression_dedup
from tactigrid.llm.spotsigs import op10_spotsigs
from tactigrid.llm.token_counts import op3_token_counts
from tactigrid.llm.toxicity import op1_toxicity
from tactigrid.llm.url_filter import OP8_SQL, op8_url_filter
from tactigrid.llm.winnow import OP6_SQL, op6_winnow_decontamination

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_recompression_dedup": op2_recompression_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_winnow_decontamination": op6_winnow_decontamination,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_spotsigs": op10_spotsigs,
}

ORACLES = {
    "op2_recompression_dedup": OP2_SQL,
    "op6_winnow_decontamination": OP6_SQL,
    "op8_url_filter": OP8_SQL,
}
