"""Queries of the corpus operators and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from chronoframe.llm import quality, search
from chronoframe.llm.bpe import op2_bpe_round_trip
from chronoframe.llm.html import op9_html_extract
from chronoframe.llm.licenses import op1_license_scan
from chronoframe.llm.mixing import op5_mix_sources
from chronoframe.llm.neardup import op7_dart_minhash
from chronoframe.llm.quality import op6_quality_rules
from chronoframe.llm.search import op10_max_score
from chronoframe.llm.tokens import op3_token_counts
from chronoframe.llm.toxicity import op8_toxicity
from chronoframe.llm.urls import op4_url_filter


def queries():
    return {
        "op1_license_scan": op1_license_scan,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_token_counts": op3_token_counts,
        "op4_url_filter": op4_url_filter,
        "op5_mix_sources": op5_mix_sources,
        "op6_quality_rules": op6_quality_rules,
        "op7_dart_minhash": op7_dart_minhash,
        "op8_toxicity": op8_toxicity,
        "op9_html_extract": op9_html_extract,
        "op10_max_score": op10_max_score,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op6_quality_rules": quality.SQL, "op10_max_score": search.SQL}
