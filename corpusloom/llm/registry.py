"""The queries of this subpackage and the SQL that states the same results where SQL can."""

from __future__ import annotations

from . import bpe, decontaminate, html_main, language_id, line_dedup, lm_score, media_copies, merkle, pii, simhash, spelling, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_bpe": bpe.query,
    "op3_simhash": simhash.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": language_id.query,
    "op6_token_counts": token_counts.query,
    "op7_media_copies": media_copies.query,
    "op8_line_dedup": line_dedup.query,
    "op9_lm_score": lm_score.query,
    "op10_html_main": html_main.query,
    "op11_merkle": merkle.query,
    "op12_pii": pii.query,
    "op13_spelling": spelling.query,
}
ORACLES = {"op1_decontaminate": decontaminate.SQL, "op8_line_dedup": line_dedup.SQL, "op11_merkle": merkle.SQL, "op13_spelling": spelling.SQL}
