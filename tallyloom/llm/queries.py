"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import archive, chaining, fingerprints, neardup, negatives, packing, pieces, privacy, quality, scoring, suffixdup, urls, whitening

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_suffix_dedup": suffixdup.op2_suffix_dedup,
    "op3_near_dedup": neardup.op3_near_dedup,
    "op4_url_filter": urls.op4_url_filter,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_merge_dropout": pieces.op7_merge_dropout,
    "op8_privacy": privacy.op8_privacy,
    "op9_collinear_chains": chaining.op9_collinear_chains,
    "op10_ppm_scores": scoring.op10_ppm_scores,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_warc_archive": archive.op13_warc_archive,
}

SQL = {
    "op4_url_filter": urls.OP4_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_warc_archive": archive.OP13_SQL,
}
