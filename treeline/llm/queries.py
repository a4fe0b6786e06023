"""The registered ``opN_<name>`` queries and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import oracles
from .ann import op6_ann
from .bytebpe import op10_byte_bpe
from .fim import op13_fill_in_middle
from .html_text import op2_html_text
from .language_model import op5_lm_scores
from .neardup import op4_near_duplicates
from .packing import op9_packing
from .pii import op1_pii
from .quality import op3_quality_rules
from .subword import op12_quality_classifier
from .tokens import op7_token_counts
from .toxicity import op8_toxicity
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_pii": op1_pii,
    "op2_html_text": op2_html_text,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_lm_scores": op5_lm_scores,
    "op6_ann": op6_ann,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op3_quality_rules": oracles.OP3, "op4_near_duplicates": oracles.OP4, "op11_vector_codes": oracles.OP11, "op13_fill_in_middle": oracles.OP13}
