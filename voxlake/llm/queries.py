"""Queries of the training-data operators, for registration in __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroid_clustering import OP11_SQL, op11_query
from .chroma import op3_query
from .decontamination import op4_query
from .html_extract import op8_query
from .language_id import op1_query
from .line_dedup import OP7_SQL, op7_query
from .pii import op6_query
from .piece_encoding import op12_query
from .simhash import op10_query
from .suffix_dedup import op2_query
from .token_alignment import op13_query
from .token_records import op5_query
from .vector_packing import op9_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_query,
    "op2_suffix_dedup": op2_query,
    "op3_chroma": op3_query,
    "op4_decontamination": op4_query,
    "op5_token_records": op5_query,
    "op6_pii": op6_query,
    "op7_line_dedup": op7_query,
    "op8_html_extract": op8_query,
    "op9_vector_packing": op9_query,
    "op10_simhash": op10_query,
    "op11_centroid_clustering": op11_query,
    "op12_sentencepiece": op12_query,
    "op13_token_alignment": op13_query,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": OP7_SQL,
    "op11_centroid_clustering": OP11_SQL,
}
