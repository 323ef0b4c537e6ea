"""The corpus queries by name, and the SQL of those that SQL can express."""

from leafmill.llm import (
    decontamination,
    fill_in_middle,
    katz,
    language_id,
    mixing,
    near_dedup,
    personal_data,
    quality_classifier,
    quality_rules,
    source_divergence,
    token_counts,
    token_output,
    url_filters,
)

QUERIES = {
    "op1_token_output": token_output.query,
    "op2_token_counts": token_counts.query,
    "op3_quality_rules": quality_rules.query,
    "op4_near_dedup": near_dedup.query,
    "op5_url_filters": url_filters.query,
    "op6_personal_data": personal_data.query,
    "op7_decontamination": decontamination.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_mixing": mixing.query,
    "op10_katz_scores": katz.query,
    "op11_language_id": language_id.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_source_divergence": source_divergence.query,
}

#: Others need whole-corpus models, tokenizers or regular expressions that DuckDB hasn't; tests/llm checks those by brute force.
ORACLES = {
    "op9_mixing": mixing.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_source_divergence": source_divergence.SQL,
}
