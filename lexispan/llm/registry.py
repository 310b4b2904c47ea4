"""Queries and oracle SQL of this subpackage, by name."""

from .bpe import op4_bpe_round_trip
from .jaccard import op9_jaccard_join
from .language import op2_language_id
from .licenses import op3_license_scan
from .mixing import op1_mix_sources
from .nearest import op10_nearest
from .substrings import op7_suffix_dedup
from .token_files import op6_token_files
from .topk import OP5_SQL, op5_max_score
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_max_score": op5_max_score,
    "op6_token_files": op6_token_files,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_nearest": op10_nearest,
}

ORACLE_SQL: dict[str, str] = {"op5_max_score": OP5_SQL, "op8_warc": OP8_SQL}
