"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .decontaminate import op2_decontaminate
from .line_dedup import OP10_SQL, op10_line_dedup
from .lm_scoring import op1_lm_scoring
from .pii import op3_pii
from .quality import op8_quality
from .sentencepiece_codec import op6_sentencepiece
from .simhash import op9_simhash
from .token_counts import op7_token_counts
from .toxicity import op4_toxicity
from .url_filter import op5_url_filter

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES = {"op10_line_dedup": OP10_SQL}
