"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op9_bpe
from tidemark.llm.hmm import op5_hmm
from tidemark.llm.language import op4_language
from tidemark.llm.lines import op10_lines
from tidemark.llm.merkle import op8_merkle
from tidemark.llm.mixing import OP1_SQL, op1_mixing
from tidemark.llm.neardup import op6_minhash
from tidemark.llm.quality import op3_quality
from tidemark.llm.sharding import op2_sharding
from tidemark.llm.substring import op7_substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_hmm": op5_hmm,
    "op6_minhash": op6_minhash,
    "op7_substring": op7_substring,
    "op8_merkle": op8_merkle,
    "op9_bpe": op9_bpe,
    "op10_lines": op10_lines,
}

ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL}
