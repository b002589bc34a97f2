"""Queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pitsports.llm.codes import op11_vector_codes
from pitsports.llm.contamination import OP1_SQL, op1_benchmark_decontamination
from pitsports.llm.html import op6_html_extraction
from pitsports.llm.jaccard import op9_ngram_jaccard_join
from pitsports.llm.language import op5_language_id
from pitsports.llm.lines import OP3_SQL, op3_line_dedup
from pitsports.llm.packing import op13_sequence_packing
from pitsports.llm.pii import op7_pii
from pitsports.llm.quality import op8_quality_rules
from pitsports.llm.segmentation import op2_sentencepiece_sampling
from pitsports.llm.spelling import op12_spelling_variants
from pitsports.llm.suffixes import op4_suffix_array_dedup
from pitsports.llm.tokens import op10_token_output

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_token_output": op10_token_output,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sequence_packing": op13_sequence_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
}
