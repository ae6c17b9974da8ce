"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pricebasket.llm import bpe, codes, decontamination, jaccard, language, media, mixing, records, resampling, search, sentences, sharding, suffixes

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_language_id": language.op2_language_id,
    "op3_sentence_spans": sentences.op3_sentence_spans,
    "op4_media": media.op4_media,
    "op5_sharding": sharding.op5_sharding,
    "op6_suffix_array": suffixes.op6_suffix_array,
    "op7_top_k": search.op7_top_k,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_token_records": records.op10_token_records,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_resampling": resampling.op12_resampling,
    "op13_decontamination": decontamination.op13_decontamination,
}
SQL = {
    "op3_sentence_spans": sentences.OP3_SQL, "op5_sharding": sharding.OP5_SQL, "op11_vector_codes": codes.OP11_SQL, "op12_resampling": resampling.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
