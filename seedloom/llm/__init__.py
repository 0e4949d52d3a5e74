"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from seedloom.llm import bpe, collocations, decontam, imatch, jaccard, langid, linededup, periodic, pii, sharding, toxicity, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe": bpe.op3_bpe,
    "op4_imatch": imatch.op4_imatch,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_shards": sharding.op8_shards,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_urls": urls.op10_urls,
    "op11_language": langid.op11_language,
    "op12_collocations": collocations.op12_collocations,
    "op13_runs": periodic.op13_runs,
}
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op10_urls": urls.OP10_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
