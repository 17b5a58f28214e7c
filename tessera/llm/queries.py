"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import collocations, factors, linededup, manifest, minhash, packing, pieces, quality_rules, repair, rotation, rule_ensemble, srs, suffixes


def queries() -> dict:
    return {
        "op1_rule_ensemble_quality": rule_ensemble.op1,
        "op2_repair_ids": repair.op2,
        "op3_stable_projection_knn": srs.op3,
        "op4_piece_codec": pieces.op4,
        "op5_bin_slack_packing": packing.op5,
        "op6_line_chunk_dedup": linededup.op6,
        "op7_perspective_rotation": rotation.op7,
        "op8_risk_controlled_rules": quality_rules.op8,
        "op9_sketch_near_dedup": minhash.op9,
        "op10_column_suffix_dedup": suffixes.op10,
        "op11_window_merkle_manifest": manifest.op11,
        "op12_apriori_collocations": collocations.op12,
        "op13_reference_factor_dedup": factors.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_chunk_dedup": linededup.ORACLE, "op7_perspective_rotation": rotation.ORACLE, "op11_window_merkle_manifest": manifest.ORACLE, "op12_apriori_collocations": collocations.ORACLE}
