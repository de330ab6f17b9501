"""The queries of this subpackage and their oracles."""

from __future__ import annotations

from . import bpe, chat, decontamination, fingerprints, html, jaccard, lexical, licenses, lm, negatives, packing, quality, secrets

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_lm": lm.query,
    "op3_secrets": secrets.query,
    "op4_jaccard": jaccard.query,
    "op5_decontamination": decontamination.query,
    "op6_bpe": bpe.query,
    "op7_quality": quality.query,
    "op8_html": html.query,
    "op9_fingerprints": fingerprints.query,
    "op10_chat": chat.query,
    "op11_lexical": lexical.query,
    "op12_packing": packing.query,
    "op13_negatives": negatives.query,
}
ORACLES: dict[str, str] = {"op10_chat": chat.ORACLE, "op11_lexical": lexical.ORACLE, "op13_negatives": negatives.ORACLE}
