"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_benchmark_decontamination
from .embeddings import op10_embedding_near_dedup
from .interactions import OP11_SQL, op11_filter_audit
from .language import op6_language_id
from .lm import op2_lm_scoring
from .middles import OP13_SQL, op13_fill_in_middle
from .mixing import op1_source_mixing
from .quality import op8_quality_classifier
from .secrets import op5_secret_scan
from .simhash import op4_simhash_near_dedup
from .substrings import op9_substring_dedup
from .versions import op12_document_fingerprints
from .warc import op3_warc

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_warc": op3_warc,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op7_benchmark_decontamination": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
