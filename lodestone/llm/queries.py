"""The queries and the SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from lodestone.llm.decontamination import OP10_SQL, op10_decontamination
from lodestone.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from lodestone.llm.html_extraction import op5_html_extraction
from lodestone.llm.language_id import op2_language_id
from lodestone.llm.license_scan import op8_license_scan
from lodestone.llm.nearest_vectors import op11_nearest_vectors
from lodestone.llm.ngram_join import OP3_SQL, op3_ngram_jaccard_join
from lodestone.llm.packing import op9_packing
from lodestone.llm.periodic_runs import op12_periodic_runs
from lodestone.llm.quality_rules import op7_quality_rules
from lodestone.llm.sharding import op6_sharding
from lodestone.llm.token_files import op4_token_files
from lodestone.llm.url_filters import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_html_extraction": op5_html_extraction,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_nearest_vectors": op11_nearest_vectors,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The others need models, hashes, tokenizers or automata that SQL doesn't have, or are approximate; tests hold them against plain Python.
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op10_decontamination": OP10_SQL, "op13_hard_negatives": OP13_SQL}
