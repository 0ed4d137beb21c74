"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from furrow.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from furrow.llm.fill_middle import OP13_SQL, op13_fill_middle
from furrow.llm.isolation import op12_isolation_rules
from furrow.llm.language_id import op5_language_id
from furrow.llm.mixing import op10_mixing
from furrow.llm.ngram_join import OP9_SQL, op9_ngram_join
from furrow.llm.packing import op6_best_fit
from furrow.llm.sentence_dedup import op2_sentence_dedup
from furrow.llm.suffix_dedup import op7_suffix_dedup
from furrow.llm.token_files import op3_token_files
from furrow.llm.url_filter import OP4_SQL, op4_url_filter
from furrow.llm.vector_codes import OP11_SQL, op11_vector_codes
from furrow.llm.vp_search import op8_vp_search

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentence_dedup": op2_sentence_dedup,
    "op3_token_files": op3_token_files,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_best_fit": op6_best_fit,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_vp_search": op8_vp_search,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_isolation_rules": op12_isolation_rules,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op4_url_filter": OP4_SQL, "op9_ngram_join": OP9_SQL, "op11_vector_codes": OP11_SQL, "op13_fill_middle": OP13_SQL}
