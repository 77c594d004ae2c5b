"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import asof, chat, html, mixing, neardup, pieces, pii, quality, secrets, suffixdedup, topk, trie, vectorlinks

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_sample_pieces": pieces.op2_sample_pieces,
    "op3_dedup_passages": suffixdedup.op3_dedup_passages,
    "op4_jaccard_join": neardup.op4_jaccard_join,
    "op5_format_chats": chat.op5_format_chats,
    "op6_find_pii": pii.op6_find_pii,
    "op7_scan_secrets": secrets.op7_scan_secrets,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_top_k": topk.op9_top_k,
    "op10_extract_html": html.op10_extract_html,
    "op11_near_vectors": vectorlinks.op11_near_vectors,
    "op12_asof_orders": asof.op12_asof_orders,
    "op13_conversation_trie": trie.op13_conversation_trie,
}
ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op4_jaccard_join": neardup.OP4_SQL,
    "op5_format_chats": chat.OP5_SQL,
    "op7_scan_secrets": secrets.OP7_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op11_near_vectors": vectorlinks.OP11_SQL,
    "op12_asof_orders": asof.OP12_SQL,
    "op13_conversation_trie": trie.OP13_SQL,
}
