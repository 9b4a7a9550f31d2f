"""Registered queries of the package and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from lacuna.llm.audit import OP13_SQL, op13_filter_audit
from lacuna.llm.chat import OP7_SQL, op7_chat_formatting
from lacuna.llm.decontaminate import op3_decontamination
from lacuna.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lacuna.llm.licenses import OP6_SQL, op6_license_scan
from lacuna.llm.near_dedup import op5_near_dedup
from lacuna.llm.online_packing import op12_sum_of_squares_packing
from lacuna.llm.packing import op8_best_fit_packing
from lacuna.llm.periodic import op11_periodic_runs
from lacuna.llm.pii import op4_pii
from lacuna.llm.toxicity import op9_toxicity
from lacuna.llm.warc import OP10_SQL, op10_warc
from lacuna.llm.wavelet import op1_wavelet_shards

QUERIES = {
    "op1_wavelet_shards": op1_wavelet_shards,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_near_dedup": op5_near_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sum_of_squares_packing": op12_sum_of_squares_packing,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op6_license_scan": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op13_filter_audit": OP13_SQL,
}
