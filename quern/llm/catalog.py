"""The queries of this subpackage and the SQL of those that SQL can express."""

from quern.llm import exact_dedup, fingerprints, language_model, mixing, near_dedup, packing, pii, quality, token_files, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_pii": pii.op2_pii,
    "op3_token_files": token_files.op3_token_files,
    "op4_quality": quality.op4_quality,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_packing": packing.op7_packing,
    "op8_language_model": language_model.op8_language_model,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op1_url_filters": url_filters.ORACLE, "op2_pii": pii.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op10_mixing": mixing.ORACLE}
