"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import (
    bpe_codec, embedding_dedup, exact_dedup, fill_middle, html_extract, ngram_join, packing, resampling, secret_scan, sentencepiece_codec, sharding, substring_dedup, toxicity,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_resampling": resampling.op11_resampling,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_bpe": bpe_codec.op13_bpe,
}
SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op11_resampling": resampling.OP11_SQL, "op12_fill_middle": fill_middle.OP12_SQL}
