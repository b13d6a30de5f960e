"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.bpe import op7_bpe
from quantloom.llm.hnsw import op9_nearest
from quantloom.llm.jaccard import op6_jaccard
from quantloom.llm.langid import op4_language_id
from quantloom.llm.mixing import op1_mixing
from quantloom.llm.near_vectors import op10_near_vectors
from quantloom.llm.oracle import SQL
from quantloom.llm.pii import op5_pii
from quantloom.llm.secrets import op2_secrets
from quantloom.llm.sharding import op8_sharding
from quantloom.llm.warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_jaccard": op6_jaccard,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_nearest": op9_nearest,
    "op10_near_vectors": op10_near_vectors,
}

ORACLE_SQL: dict[str, str] = SQL
