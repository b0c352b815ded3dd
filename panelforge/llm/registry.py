"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from panelforge.llm import collocations, dedup, grammar, hmm, html_extract, jaccard, middle, packing, quality, sentencepieces, topk, url_filter, warc


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepieces.op1_sentencepiece,
        "op2_retrieval_packing": packing.op2_retrieval_packing,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_hmm_score": hmm.op4_hmm_score,
        "op5_repair_shards": grammar.op5_repair_shards,
        "op6_warc": warc.op6_warc,
        "op7_quality_llr": quality.op7_quality_llr,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_exact_dedup": dedup.op9_exact_dedup,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_fill_in_middle": middle.op11_fill_in_middle,
        "op12_exact_topk": topk.op12_exact_topk,
        "op13_collocations": collocations.op13_collocations,
        "quality_base_counts": quality.base_counts,
        "url_rules": url_filter.url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": warc.SQL,
        "op8_jaccard_join": jaccard.SQL,
        "op9_exact_dedup": dedup.SQL,
        "op11_fill_in_middle": middle.SQL,
        "op12_exact_topk": topk.SQL,
        "op13_collocations": collocations.SQL,
        "quality_base_counts": quality.SQL,
        "url_rules": url_filter.SQL,
    }
