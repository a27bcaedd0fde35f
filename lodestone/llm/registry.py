"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import op01_lm_score as op1
from lodestone.llm import op02_toxicity as op2
from lodestone.llm import op03_mixing as op3
from lodestone.llm import op04_language_id as op4
from lodestone.llm import op05_sentencepiece as op5
from lodestone.llm import op06_exact_dedup as op6
from lodestone.llm import op07_warc as op7
from lodestone.llm import op08_minhash_forest as op8
from lodestone.llm import op09_multi_index as op9
from lodestone.llm import op10_pii as op10

QUERIES = {
    "op1_lm_score": op1.op1_lm_score,
    "op2_toxicity": op2.op2_toxicity,
    "op3_mixing": op3.op3_mixing,
    "op4_language_id": op4.op4_language_id,
    "op5_sentencepiece": op5.op5_sentencepiece,
    "op6_exact_dedup": op6.op6_exact_dedup,
    "op7_warc": op7.op7_warc,
    "op8_minhash_forest": op8.op8_minhash_forest,
    "op9_multi_index": op9.op9_multi_index,
    "op10_pii": op10.op10_pii,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_mixing": op3.ORACLE,
    "op6_exact_dedup": op6.ORACLE,
    "op8_minhash_forest": op8.ORACLE,
    "op9_multi_index": op9.ORACLE,
}
