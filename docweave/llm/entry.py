"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op10_byte_bpe
from .chat import OP5_SQL, op5_chat_rotation
from .hilbert import op4_hilbert
from .merkle import OP13_SQL, op13_merkle
from .minhash import OP8_SQL, op8_minhash
from .mixing import op3_mixing
from .quality import op7_quality
from .sharding import op6_sharding
from .spelling import OP11_SQL, op11_spelling
from .token_orc import op9_token_orc
from .toxicity import op1_toxicity
from .va_file import OP2_SQL, op2_va_file
from .wrapper import op12_wrapper

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_va_file": op2_va_file,
    "op3_mixing": op3_mixing,
    "op4_hilbert": op4_hilbert,
    "op5_chat_rotation": op5_chat_rotation,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_token_orc": op9_token_orc,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling": op11_spelling,
    "op12_wrapper": op12_wrapper,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_va_file": OP2_SQL,
    "op5_chat_rotation": OP5_SQL,
    "op8_minhash": OP8_SQL,
    "op11_spelling": OP11_SQL,
    "op13_merkle": OP13_SQL,
}
