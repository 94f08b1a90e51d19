"""The queries of this subpackage and their SQL."""

from stratalith.llm import chat_format, decontaminate, fingerprints, license_scan, mixing, simhash_dedup, substring_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_source_mixing": mixing.query,
    "op5_token_files": token_files.query,
    "op6_fingerprints": fingerprints.query,
    "op7_preference_format": chat_format.query,
    "op8_simhash_dedup": simhash_dedup.query,
    "op9_url_filter": url_filter.query,
    "op10_decontamination": decontaminate.query,
}
#: The others have no equal in SQL (trained fields, tokenizers, XXH64, random walks); tests hold them against brute force.
ORACLE = {
    "op1_license_scan": license_scan.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op4_source_mixing": mixing.SQL,
    "op7_preference_format": chat_format.SQL,
    "op9_url_filter": url_filter.SQL,
}
