"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat
from .fingerprints import op7_fingerprints
from .media import op10_media
from .minhash import op5_minhash
from .packing import op8_packing
from .pieces import op1_sentencepiece
from .quality import op9_quality
from .suffix_dedup import op6_suffix_dedup
from .token_store import op2_token_files
from .warc import op3_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op4_chat": op4_chat,
    "op5_minhash": op5_minhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": OP4_SQL,
}
