"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from turnloom.llm import alignment, fim, minhash, mixing, neighbours, packing, pii, quality, secrets, segmentation, suffixes, transducer, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_token_counts": transducer.op3_token_counts,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_segmentations": segmentation.op5_segmentations,
    "op6_pii": pii.op6_pii,
    "op7_secrets": secrets.op7_secrets,
    "op8_minhash": minhash.op8_minhash,
    "op9_packing": packing.op9_packing,
    "op10_warc": warc.op10_warc,
    "op11_mixing": mixing.op11_mixing,
    "op12_fim": fim.op12_fim,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op1_quality": quality.OP1_SQL,
    "op6_pii": pii.OP6_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_mixing": mixing.OP11_SQL,
    "op12_fim": fim.OP12_SQL,
}
