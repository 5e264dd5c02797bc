"""The operators' queries and their SQL counterparts."""

from __future__ import annotations

from tocsin.llm import (
    bitslices, decontaminate, imatch, linededup, neardup, packing, pii, secrets, spelling, substrings, tokens, toxicity, urls,
)

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_pii_pseudonyms": pii.query,
    "op3_secret_scan": secrets.query,
    "op4_url_filter": urls.query,
    "op5_minhash": neardup.query,
    "op6_line_dedup": linededup.query,
    "op7_sentencepiece": tokens.query,
    "op8_toxicity": toxicity.query,
    "op9_imatch": imatch.query,
    "op10_suffix_dedup": substrings.query,
    "op11_ranked_search": bitslices.query,
    "op12_packing": packing.query,
    "op13_spelling_variants": spelling.query,
}
ORACLE = {
    "op1_decontamination": decontaminate.SQL,
    "op3_secret_scan": secrets.SQL,
    "op6_line_dedup": linededup.SQL,
    "op11_ranked_search": bitslices.SQL,
    "op13_spelling_variants": spelling.SQL,
}
