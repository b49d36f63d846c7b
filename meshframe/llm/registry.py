"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from . import ann, bpe, chat, html_text, language, media, mixing, quality, simhash, suffix, toxicity, trie


def queries() -> dict[str, Callable]:
    made = (bpe.op1_byte_bpe, suffix.op2_suffix_array, chat.op3_chat, quality.op4_quality, html_text.op5_html, mixing.op6_mixing, language.op7_language, toxicity.op8_toxicity, simhash.op9_simhash, media.op10_matroska, ann.op11_ann, trie.op12_trie)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.ORACLE}
