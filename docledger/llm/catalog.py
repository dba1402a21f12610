"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docledger.llm.bpe import op1_bpe
from docledger.llm.chat import OP9_SQL, op9_chat
from docledger.llm.decontaminate import OP6_SQL, op6_decontaminate
from docledger.llm.fingerprints import op8_fingerprints
from docledger.llm.langid import op2_language
from docledger.llm.licenses import op5_licenses
from docledger.llm.minhash import OP13_SQL, op13_minhash
from docledger.llm.quality import op3_quality
from docledger.llm.repair import OP12_SQL, op12_repair
from docledger.llm.simhash import op4_simhash
from docledger.llm.token_files import op7_token_files
from docledger.llm.toxicity import op10_toxicity
from docledger.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_repair": op12_repair,
    "op13_minhash": op13_minhash,
}

ORACLES: dict[str, str] = {
    "op6_decontaminate": OP6_SQL,
    "op9_chat": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_repair": OP12_SQL,
    "op13_minhash": OP13_SQL,
}
