"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontam, langid, orderminhash, ppm, quality, runbwt, surrogates, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_suffix_dedup": runbwt.op3_suffix_dedup,
    "op4_order_minhash": orderminhash.op4_order_minhash,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_prefix_tree": chat.op6_prefix_tree,
    "op7_url_filter": urls.op7_url_filter,
    "op8_bpe": bpe.op8_bpe,
    "op9_langid": langid.op9_langid,
    "op10_ppm": ppm.op10_ppm,
}

ORACLES: dict[str, str] = {
    "op1_quality": quality.ORACLE,
    "op6_prefix_tree": chat.ORACLE,
    "op7_url_filter": urls.ORACLE,
}
