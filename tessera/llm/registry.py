"""The subpackage's queries and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import ctw, decontaminate, fixity, near, packing, quality, repetition, sharding, toxicity, urlfilter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_fixity": fixity.op1_fixity,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_near": near.op4_near,
    "op5_ctw": ctw.op5_ctw,
    "op6_packing": packing.op6_packing,
    "op7_repetition": repetition.op7_repetition,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_urlfilter": urlfilter.op10_urlfilter,
}
ORACLES = {"op1_fixity": fixity.SQL, "op3_sharding": sharding.SQL, "op10_urlfilter": urlfilter.SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
