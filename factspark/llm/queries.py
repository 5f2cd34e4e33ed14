"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import bestfit, chat, codes, decontam, embeddings, fim, jaccard, langid, packing, rans, shards, suffix, warc

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_histogram_shards": shards.op2_histogram_shards,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_embedding_near_dup": embeddings.op4_embedding_near_dup,
    "op5_pack": packing.op5_pack,
    "op6_chat_format": chat.op6_chat_format,
    "op7_warc": warc.op7_warc,
    "op8_rans_tokens": rans.op8_rans_tokens,
    "op9_suffix_array_dedup": suffix.op9_suffix_array_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_best_fit": bestfit.op13_best_fit,
}

ORACLE_SQL = {
    "op1_decontaminate": decontam.ORACLE,
    "op3_jaccard_join": jaccard.ORACLE,
    "op4_embedding_near_dup": embeddings.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_suffix_array_dedup": suffix.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
