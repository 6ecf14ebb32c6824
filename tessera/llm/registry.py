"""The queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from tessera.llm import embeddings, jaccard, language, mixing, packing, quality, rans, repeats, unigram, warc

QUERIES = {
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op1_language_id": language.op1_language_id,
    "op7_token_counts": unigram.op7_token_counts,
    "op5_quality_rules": quality.op5_quality_rules,
    "op4_warc_archive": warc.op4_warc_archive,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op9_token_archive": rans.op9_token_archive,
}

SQL: dict[str, str] = {
    "op8_ngram_jaccard_join": jaccard.SQL,
    "op2_embedding_near_dedup": embeddings.SQL,
    "op5_quality_rules": quality.SQL,
    "op4_warc_archive": warc.SQL,
}
