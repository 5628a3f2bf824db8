"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from tracelab.llm import decontaminate, html_text, importance, language_id, licenses, line_dedup, mixing, near_dup, nearest, personal_data, prefix_trie, token_ids, warc

QUERIES = {
    "op1_token_ids": token_ids.op1_token_ids,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_personal_data": personal_data.op3_personal_data,
    "op4_language_id": language_id.op4_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_html_text": html_text.op6_html_text,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_warc": warc.op8_warc,
    "op9_nearest": nearest.op9_nearest,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_importance": importance.op11_importance,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_licenses": licenses.op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": mixing.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_licenses": licenses.ORACLE,
}
