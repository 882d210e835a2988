"""The corpus operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from trackloom.llm import (
    decontam, fertility, language, licenses, lm_score, manifest, mixing, near_dedup, packing, periodic, quality_crf, secrets, token_counts,
)

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_quality_crf": quality_crf.op2_quality_crf,
    "op3_fertility_rules": fertility.op3_fertility_rules,
    "op4_near_duplicates": near_dedup.op4_near_duplicates,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_license_scan": licenses.op7_license_scan,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_pack_sequences": packing.op13_pack_sequences,
}
ORACLES = {"op8_mix_sources": mixing.OP8_SQL, "op11_merkle_manifest": manifest.OP11_SQL}
