"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm.decontaminate import op10_benchmark_decontamination
from lodestone.llm.hamming import ORACLE as OP3_SQL
from lodestone.llm.hamming import op3_exact_top_k
from lodestone.llm.langid import op7_language_id
from lodestone.llm.licenses import op8_license_scan
from lodestone.llm.packing import op6_best_fit_packing
from lodestone.llm.pages import op2_html_extraction
from lodestone.llm.simhash import op1_simhash_near_dedup
from lodestone.llm.substring import ORACLE as OP4_SQL
from lodestone.llm.substring import op4_substring_dedup
from lodestone.llm.tokencount import op9_token_counts
from lodestone.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "pipeline": corpus_pipeline.run,
}

#: The others can't be said in SQL, or not on whole tables: no seeded XXH64, tokenizer, learning or packing there. They
#: are tested against brute force, the library itself, or held-out labels.
ORACLES: dict[str, str] = {"op3_exact_top_k": OP3_SQL, "op4_substring_dedup": OP4_SQL}
