"""Registered queries of the training-data operators: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
from clientlens.llm import (bpe, chat, classifier, divergence, exact_dedup, language, mixing, partenum, phrases,
                            quality_rules, secrets, token_counts, warc)
from clientlens.llm.common import documents

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_token_counts": token_counts.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_quality_rules": lambda spark, sf_dir: quality_rules.op4(documents(spark, sf_dir)),
    "op5_source_mix": mixing.op5,
    "op6_tool_linking": chat.op6,
    "op7_secret_ownership": secrets.op7,
    "op8_quality_qda": classifier.op8,
    "op9_warc_revisit": warc.op9,
    "op10_partenum_join": partenum.op10,
    "op11_source_divergence": divergence.op11,
    "op12_phrase_mining": phrases.op12,
    "op13_cross_parsing": language.op13,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op5_source_mix": mixing.SQL,
    "op6_tool_linking": chat.SQL,
    "op9_warc_revisit": warc.SQL,
    "op10_partenum_join": partenum.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_phrase_mining": phrases.SQL,
}
