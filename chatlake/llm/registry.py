"""The queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from chatlake.llm import ann_forest, embedding_dedup, langid_ppm, mixing, ngram_join, nra_search, packing, quality_crf, substring_dedup, suffix_dedup, toxicity_fm, url_filter, word_runs


def queries() -> dict:
    return {"op1_substring_dedup": substring_dedup.op1, "op2_packing": packing.op2, "op3_embedding_dedup": embedding_dedup.op3, "op4_quality_crf": quality_crf.op4, "op5_ann_forest": ann_forest.op5, "op6_toxicity_fm": toxicity_fm.op6, "op7_ngram_join": ngram_join.op7, "op8_suffix_array_dedup": suffix_dedup.op8, "op9_mixing": mixing.op9, "op10_url_filter": url_filter.op10, "op11_langid_ppm": langid_ppm.op11, "op12_nra_search": nra_search.op12, "op13_word_runs": word_runs.op13}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op3_embedding_dedup": embedding_dedup.SQL,
        "op7_ngram_join": ngram_join.SQL,
        "op8_suffix_array_dedup": suffix_dedup.SQL,
        "op10_url_filter": url_filter.SQL,
        "op12_nra_search": nra_search.SQL,
    }
