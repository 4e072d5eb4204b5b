"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontamination import op8_decontamination
from .exact_search import OP3_SQL, op3_exact_search
from .langid import op10_language_id
from .licenses import op9_licenses
from .line_dedup import OP1_SQL, op1_line_dedup
from .simhash import op6_simhash
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op7_token_counts
from .token_files import op2_token_files

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_exact_search": op3_exact_search,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_exact_search": OP3_SQL}
