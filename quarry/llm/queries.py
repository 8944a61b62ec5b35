"""Queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import OP3_SQL, op3_decontamination
from .embeddings import OP7_SQL, op7_embeddings
from .langid import op8_language_id
from .linededup import OP10_SQL, op10_line_dedup
from .packing import op9_packing
from .pii import op6_pii
from .simhash import op5_simhash
from .tokens import op2_token_counts
from .toxicity import op1_toxicity
from .urls import OP4_SQL, op4_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_decontamination, op4_url_filters, op5_simhash, op6_pii, op7_embeddings, op8_language_id, op9_packing, op10_line_dedup)}

SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_url_filters": OP4_SQL, "op7_embeddings": OP7_SQL, "op10_line_dedup": OP10_SQL}
