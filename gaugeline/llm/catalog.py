"""The registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from gaugeline.llm.decontaminate import op1_benchmark_decontamination
from gaugeline.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from gaugeline.llm.filter_audit import OP12_SQL, op12_filter_interaction_audit
from gaugeline.llm.html_text import op3_html_extraction
from gaugeline.llm.language import op2_language_id
from gaugeline.llm.merkle import OP11_SQL, op11_merkle_dataset_manifest
from gaugeline.llm.minhash_join import OP13_SQL, op13_minhash_near_dedup
from gaugeline.llm.ngram_join import OP7_SQL, op7_ngram_jaccard_join
from gaugeline.llm.packing import op8_packing
from gaugeline.llm.pii import op5_pii
from gaugeline.llm.quality import op10_quality_classifier
from gaugeline.llm.substring_dedup import op4_substring_dedup
from gaugeline.llm.token_counts import op9_token_counts

QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination,
    op2_language_id,
    op3_html_extraction,
    op4_substring_dedup,
    op5_pii,
    op6_exact_dedup,
    op7_ngram_jaccard_join,
    op8_packing,
    op9_token_counts,
    op10_quality_classifier,
    op11_merkle_dataset_manifest,
    op12_filter_interaction_audit,
    op13_minhash_near_dedup,
)}
SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op11_merkle_dataset_manifest": OP11_SQL,
    "op12_filter_interaction_audit": OP12_SQL,
    "op13_minhash_near_dedup": OP13_SQL,
}
