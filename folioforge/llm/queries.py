"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import centroids, host_rules, itq
from .centroids import op12_centroids
from .host_rules import op3_host_rules
from .itq import op9_embeddings
from .langid import op4_langid
from .lm import op11_lm
from .mixing import op5_mixing
from .packing import op6_packing
from .quality import op10_quality
from .simhash import op8_simhash
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op2_toxicity
from .warc import op7_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_host_rules": op3_host_rules,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_embeddings": op9_embeddings,
    "op10_quality": op10_quality,
    "op11_lm": op11_lm,
    "op12_centroids": op12_centroids,
}

ORACLES = {"op3_host_rules": host_rules.ORACLE, "op9_embeddings": itq.ORACLE, "op12_centroids": centroids.ORACLE}
