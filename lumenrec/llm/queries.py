"""Registry of the package's queries and of their SQL."""

from __future__ import annotations

from .byte_bpe import op6_byte_bpe
from .divergence import OP13_SQL, op13_source_divergence
from .embedding_dedup import OP9_SQL, op9_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .language_id import op12_language_id
from .language_model import op5_language_model
from .lloyd import OP11_SQL, op11_centroid_clustering
from .packing import op4_best_fit_packing
from .quality import op10_quality
from .simhash import op1_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op3_toxicity
from .url_filter import OP8_SQL, op8_url_filters

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_model": op5_language_model,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_quality": op10_quality,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_language_id": op12_language_id,
    "op13_source_divergence": op13_source_divergence,
}
SQL = {"op2_substring_dedup": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filters": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op11_centroid_clustering": OP11_SQL, "op13_source_divergence": OP13_SQL}
