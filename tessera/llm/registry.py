"""Queries of the training-data operators, one for each, over their whole tables."""

from tessera.llm.conversation_trie import OP11_SQL, op11_conversation_trie
from tessera.llm.embedding_dedup import op10_embedding_dedup
from tessera.llm.jaccard_join import op6_jaccard_join
from tessera.llm.language_id import op9_language_id
from tessera.llm.license_scan import OP12_SQL, op12_license_scan
from tessera.llm.oracle import OP1_SQL, OP3_SQL, OP6_SQL, OP10_SQL
from tessera.llm.packing import op7_packing
from tessera.llm.periodic_runs import op13_periodic_runs
from tessera.llm.quality_classifier import op2_quality_classifier
from tessera.llm.quality_rules import OP4_SQL, op4_quality_rules
from tessera.llm.sentencepiece_lattice import op5_sentencepiece
from tessera.llm.substring_dedup import op1_substring_dedup
from tessera.llm.suffix_array_dedup import op3_suffix_array_dedup
from tessera.llm.token_counts import op8_token_counts

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_license_scan": op12_license_scan,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_license_scan": OP12_SQL,
}
