"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from seqloom.llm.alignment import op13_pair_hashing
from seqloom.llm.chat_windows import OP1_SQL, op1_chat_windows
from seqloom.llm.language_id import op3_crf_language
from seqloom.llm.line_frequency import OP2_SQL, op2_line_frequency
from seqloom.llm.line_quality import op4_crf_quality
from seqloom.llm.near_duplicates import op9_tensored_minhash
from seqloom.llm.packing import op5_certified_packing
from seqloom.llm.pivot_search import OP8_SQL, op8_pivot_search
from seqloom.llm.sanitise import op7_disclosure_sanitising
from seqloom.llm.spelling import OP12_SQL, op12_asymmetric_chunks
from seqloom.llm.text_density import OP11_SQL, op11_text_density
from seqloom.llm.token_counts import op6_token_counts
from seqloom.llm.word_shuffle import op10_word_shuffle_bpe

_ALL = (
    op1_chat_windows,
    op2_line_frequency,
    op3_crf_language,
    op4_crf_quality,
    op5_certified_packing,
    op6_token_counts,
    op7_disclosure_sanitising,
    op8_pivot_search,
    op9_tensored_minhash,
    op10_word_shuffle_bpe,
    op11_text_density,
    op12_asymmetric_chunks,
    op13_pair_hashing,
)
QUERIES: dict[str, Callable] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op1_chat_windows": OP1_SQL, "op2_line_frequency": OP2_SQL, "op8_pivot_search": OP8_SQL, "op11_text_density": OP11_SQL, "op12_asymmetric_chunks": OP12_SQL}
