"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.bpe import op8_bpe
from tidelog.llm.decontaminate import op10_decontaminate
from tidelog.llm.language_id import op1_language_id
from tidelog.llm.ngram_join import op2_ngram_join
from tidelog.llm.pii import op7_pii
from tidelog.llm.quality_rules import op9_quality_rules
from tidelog.llm.repeated_passages import op6_repeated_passages
from tidelog.llm.sharding import op3_sharding
from tidelog.llm.token_planes import op5_token_planes
from tidelog.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_token_planes": op5_token_planes,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": OP4_SQL,
}
