"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, license_scan, near_dedup, repeats, secret_scan, token_store, toxicity, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_token_store": token_store.op2_token_store,
    "op3_repeats": repeats.op3_repeats,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_license_scan": license_scan.oracle(),
    "op6_decontaminate": decontaminate.ORACLE,
    "op9_secret_scan": secret_scan.oracle(),
    "op10_url_filter": url_filter.oracle(),
}
