"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audio, bitsliced, centroids, decontaminate, langid, licenses, line_dedup, mixing, near_duplicates, pseudonyms, secrets, sql, toxicity, warc

QUERIES = {
    "op1_hyperdimensional_language": langid.query,
    "op2_inferred_secrets": secrets.query,
    "op3_entropy_mix": mixing.query,
    "op4_warc_revisits": warc.query,
    "op5_feistel_pseudonyms": pseudonyms.query,
    "op6_winnowing": decontaminate.query,
    "op7_line_dedup": line_dedup.query,
    "op8_jaccard_components": near_duplicates.query,
    "op9_license_digests": licenses.query,
    "op10_audio_features": audio.query,
    "op11_bit_sliced_search": bitsliced.query,
    "op12_nonnegative_toxicity": toxicity.query,
    "op13_weighted_lloyd": centroids.query,
}
ORACLES = {
    "op4_warc_revisits": warc.ORACLE,
    "op6_winnowing": decontaminate.ORACLE,
    "op7_line_dedup": sql.LINE_DEDUP,
    "op8_jaccard_components": sql.JACCARD_COMPONENTS,
    "op9_license_digests": licenses.oracle(),
    "op11_bit_sliced_search": bitsliced.ORACLE,
    "op13_weighted_lloyd": centroids.oracle(),
}
