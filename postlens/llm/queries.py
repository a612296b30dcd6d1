"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from postlens.llm import chat, decontaminate, infill, jaccard, manifest, mixing, pii, quality, repeats, sentencepiece, sharding, toxicity, warc

QUERIES = {
    "op1_pii_spans": pii.query,
    "op2_prefix_tokens": sentencepiece.query,
    "op3_ring_sharding": sharding.query,
    "op4_reply_trees": chat.query,
    "op5_jaccard_join": jaccard.query,
    "op6_decontamination": decontaminate.query,
    "op7_toxicity": toxicity.query,
    "op8_warc_revisits": warc.query,
    "op9_host_quality": quality.query,
    "op10_repeated_text": repeats.query,
    "op11_fill_in_middle": infill.query,
    "op12_merkle_manifest": manifest.query,
    "op13_source_mix": mixing.query,
}

ORACLES = {
    "op4_reply_trees": chat.SQL,
    "op5_jaccard_join": jaccard.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op8_warc_revisits": warc.SQL,
    "op9_host_quality": quality.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_source_mix": mixing.SQL,
}
