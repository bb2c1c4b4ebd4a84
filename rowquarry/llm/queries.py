"""The queries of the training-data operators, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_decontamination
from .embeddings import op6_embeddings
from .html import op4_html
from .packing import op8_packing
from .quality import op7_quality
from .secrets import op2_secrets
from .simhash import op3_simhash
from .substrings import op9_substrings
from .tokens import op1_token_counts
from .toxicity import op5_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_html": op4_html,
    "op5_toxicity": op5_toxicity,
    "op6_embeddings": op6_embeddings,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_decontamination": op10_decontamination,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}
