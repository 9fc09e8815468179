"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .brown import op10_brown_bigrams
from .crf import op1_crf_language
from .exact import OP6_SQL, op6_exact_dedup
from .licenses import OP8_SQL, op8_license_diagonals
from .mixing import OP3_SQL, op3_poisson_mix
from .packing import op9_pattern_packing
from .quality import OP2_SQL, op2_weak_quality
from .simhash import op5_simhash_bytes
from .tokens import op7_token_cache
from .toxicity import op4_lexicon_toxicity

QUERIES = {f.__name__: f for f in (op1_crf_language, op2_weak_quality, op3_poisson_mix, op4_lexicon_toxicity, op5_simhash_bytes, op6_exact_dedup, op7_token_cache, op8_license_diagonals, op9_pattern_packing, op10_brown_bigrams)}
ORACLES = {"op2_weak_quality": OP2_SQL, "op3_poisson_mix": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op8_license_diagonals": OP8_SQL}
