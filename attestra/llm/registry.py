"""Queries of the training-data operators, one opN_<name> each, and their oracle SQL."""

from __future__ import annotations

from attestra.llm import bpe, chat, decontam, langid, lm, media, minhash, quality, rollup, search, substring, suffix, trie

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_quality": quality.op2_quality,
    "op3_chat_format": chat.op3_chat_format,
    "op4_lm_score": lm.op4_lm_score,
    "op5_media": media.op5_media,
    "op6_langid": langid.op6_langid,
    "op7_substring": substring.op7_substring,
    "op8_bpe": bpe.op8_bpe,
    "op9_token_rollup": rollup.op9_token_rollup,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_suffix": suffix.op11_suffix,
    "op12_search": search.op12_search,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op3_chat_format": chat.OP3_SQL, "op10_decontaminate": decontam.OP10_SQL, "op12_search": search.OP12_SQL, "op13_prefix_trie": trie.OP13_SQL}
