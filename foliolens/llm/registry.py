"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from foliolens.llm.chat import OP5_SQL, op5_chat_formatting
from foliolens.llm.langid import op11_recurrent_langid
from foliolens.llm.packing import op8_best_fit_packing
from foliolens.llm.quality import OP7_SQL, op7_quality_cascade
from foliolens.llm.secrets import op4_recursive_secret_scan
from foliolens.llm.sharding import op1_feistel_sharding
from foliolens.llm.simhash import op6_simhash_pigeonring
from foliolens.llm.spelling import op13_spelling_variants
from foliolens.llm.syncmers import op2_closed_syncmers
from foliolens.llm.token_files import op3_token_files
from foliolens.llm.unigram import op9_trie_token_counts, op10_sampled_pieces
from foliolens.llm.whitening import op12_tiled_whitening

_ALL = (
    op1_feistel_sharding,
    op2_closed_syncmers,
    op3_token_files,
    op4_recursive_secret_scan,
    op5_chat_formatting,
    op6_simhash_pigeonring,
    op7_quality_cascade,
    op8_best_fit_packing,
    op9_trie_token_counts,
    op10_sampled_pieces,
    op11_recurrent_langid,
    op12_tiled_whitening,
    op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op5_chat_formatting": OP5_SQL, "op7_quality_cascade": OP7_SQL}
