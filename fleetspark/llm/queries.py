"""The registered queries of this subpackage, and the SQL of those that have one."""

from .chat import OP6_SQL, op6_chat_perspectives
from .language import language_of_pages, op1_language_id
from .merkle import op11_merkle_manifest
from .mixing import op3_source_mixing
from .packing import op10_packing
from .polytope import op13_nearest_neighbours
from .quality import op5_quality_classifier
from .repair import op12_conversation_repair
from .rules import op9_quality_rules
from .simhash import op8_simhash_dedup
from .sketches import op7_fingerprints
from .suffixes import op4_suffix_dedup
from .token_files import op2_token_ids

QUERIES = {
    "op1_language_id": op1_language_id,
    "language_of_pages": language_of_pages,
    "op2_token_ids": op2_token_ids,
    "op3_source_mixing": op3_source_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_fingerprints": op7_fingerprints,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

SQL = {"op6_chat_perspectives": OP6_SQL}
