"""Queries of the text operators over the standard tables, and their oracles."""

from __future__ import annotations

from ferrule.llm.chat import OP10_SQL, op10_chat_formatting
from ferrule.llm.decontaminate import op8_decontamination
from ferrule.llm.line_dedup import OP9_SQL, op9_line_dedup
from ferrule.llm.media import op5_media_columns
from ferrule.llm.near_dup import OP2_SQL, op2_near_duplicates
from ferrule.llm.pieces import op7_sentencepiece
from ferrule.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from ferrule.llm.repeats import op6_repeats
from ferrule.llm.secrets import op4_secret_scan
from ferrule.llm.sharding import op3_sharding
from ferrule.llm.simhash import op13_simhash
from ferrule.llm.toxicity import op1_toxicity
from ferrule.llm.whitening import op11_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_sharding": op3_sharding,
    "op4_secret_scan": op4_secret_scan,
    "op5_media_columns": op5_media_columns,
    "op6_repeats": op6_repeats,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}
ORACLES = {"op9_line_dedup": OP9_SQL, "op2_near_duplicates": OP2_SQL, "op10_chat_formatting": OP10_SQL, "op12_prefix_trie": OP12_SQL}
