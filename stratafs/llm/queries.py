"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import byte_bpe, chat, decontaminate, html_text, media, negatives, packing, pii, quality, simhash, spelling, substrings, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_substrings": substrings.op2_substrings,
    "op3_pii": pii.op3_pii,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_html_text": html_text.op7_html_text,
    "op8_media": media.op8_media,
    "op9_quality": quality.op9_quality,
    "op10_chat": chat.op10_chat,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_negatives": negatives.op12_negatives,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op2_substrings": substrings.ORACLE,
    "op3_pii": pii.ORACLE,
    "op9_quality": quality.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
    "op12_negatives": negatives.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
