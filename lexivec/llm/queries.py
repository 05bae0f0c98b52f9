"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexivec.llm.as_of_join import OP13_SQL, op13_as_of_join
from lexivec.llm.chat import OP3_SQL, op3_chat_formatting
from lexivec.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from lexivec.llm.merkle import OP11_SQL, op11_merkle_manifest
from lexivec.llm.mixing import OP7_SQL, op7_mixing
from lexivec.llm.ngram_join import op10_ngram_jaccard_join
from lexivec.llm.packing import op9_best_fit_packing
from lexivec.llm.pii import OP4_SQL, op4_pii
from lexivec.llm.quality import OP5_SQL, op5_quality_rules
from lexivec.llm.substring_dedup import op12_substring_dedup
from lexivec.llm.suffix_dedup import op1_suffix_dedup
from lexivec.llm.toxicity import op2_toxicity
from lexivec.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_as_of_join": op13_as_of_join,
}

ORACLES = {
    "op3_chat_formatting": OP3_SQL,
    "op4_pii": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_as_of_join": OP13_SQL,
}
