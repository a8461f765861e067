"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import ann, bpe, chat, codes, lines, minhash, mixing, pii, quality, token_counts, topk, urls, validtime

QUERIES = {
    "op1_minhash": minhash.query,
    "op2_byte_bpe": bpe.query,
    "op3_quote_links": chat.query,
    "op4_mix_sources": mixing.query,
    "op5_trie_token_counts": token_counts.query,
    "op6_adaptive_scan": ann.query,
    "op7_additive_quality": quality.query,
    "op8_line_runs": lines.query,
    "op9_disclosure": pii.query,
    "op10_ball_tree": topk.query,
    "op11_path_templates": urls.query,
    "op12_bucket_state": validtime.query,
    "op13_annular_codes": codes.query,
}

ORACLE_SQL = {
    "op3_quote_links": chat.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op8_line_runs": lines.ORACLE,
    "op10_ball_tree": topk.ORACLE,
    "op11_path_templates": urls.ORACLE,
    "op12_bucket_state": validtime.ORACLE,
    "op13_annular_codes": codes.ORACLE,
}
