"""The queries of this package by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op11_alignment
from .chat import OP3_SQL, op3_chat
from .lexical import OP13_SQL, op13_lexical
from .licenses import op2_licenses
from .linededup import OP12_SQL, op12_lines
from .media import media_sequences, op1_media
from .mixing import OP7_SQL, op7_mixing
from .neardup import OP10_SQL, op10_minhash
from .neighbours import op9_neighbours
from .packing import op5_packing
from .quality import op4_quality
from .toxicity import op6_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_media": op1_media,
    "op2_licenses": op2_licenses,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_neighbours": op9_neighbours,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_lines": op12_lines,
    "op13_lexical": op13_lexical,
    "media_sequences": media_sequences,
}

ORACLE_SQL = {
    "op3_chat": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op10_minhash": OP10_SQL,
    "op12_lines": OP12_SQL,
    "op13_lexical": OP13_SQL,
}
