"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from gaugeworks.llm import alignment, byte_bpe, exact_dedup, extraction, fingerprint, mixing, packing, pii, resampling, sharding, simhash, token_file, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_file": token_file.op2_token_file,
    "op3_extraction": extraction.op3_extraction,
    "op4_sharding": sharding.op4_sharding,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_pii": pii.op6_pii,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_fingerprints": fingerprint.op10_fingerprints,
    "op11_resampling": resampling.op11_resampling,
    "op12_mixing": mixing.op12_mixing,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op7_exact_dedup": exact_dedup.OP7_SQL, "op11_resampling": resampling.OP11_SQL, "op12_mixing": mixing.OP12_SQL}
