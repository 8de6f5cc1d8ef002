"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embeddings, lines, mixing, ngrams, packing, quality, sharding, toxicity, urls, warc

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_shard_bytes": sharding.op3_shard_bytes,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_url_filter": urls.op6_url_filter,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_ngram_jaccard_join": ngrams.op9_ngram_jaccard_join,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLES = {
    "op1_embedding_near_dedup": embeddings.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op6_url_filter": urls.ORACLE,
    "op8_warc_round_trip": warc.ORACLE,
}
