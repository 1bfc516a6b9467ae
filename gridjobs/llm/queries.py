"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .chats import op11_reply_trees
from .fingerprints import op5_spotsigs
from .language_id import op2_language_id
from .line_dedup import op8_fuzzy_lines
from .near_dedup import op1_chosen_path
from .nearest import op6_score_aware_search
from .packing import op7_vector_packing
from .phrases import SQL as COLLOCATIONS
from .phrases import op12_collocations
from .quality import op9_quality
from .repair import op13_repair
from .repeats import op4_merged_suffixes
from .token_counts import op3_token_counts

QUERIES = {f.__name__: f for f in (op1_chosen_path, op2_language_id, op3_token_counts, op4_merged_suffixes, op5_spotsigs, op6_score_aware_search, op7_vector_packing, op8_fuzzy_lines, op9_quality, op10_byte_bpe, op11_reply_trees, op12_collocations, op13_repair)}
ORACLES: dict[str, str] = {"op12_collocations": COLLOCATIONS}
