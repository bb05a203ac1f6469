"""Queries of this subpackage for the driver, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_decontaminate
from .linedup import OP3_SQL, op3_line_dedup
from .mixing import op8_mixing
from .pii import op9_pii
from .quality import op7_quality
from .secrets import op1_secrets
from .simhash import op4_simhash
from .toolcalls import OP5_SQL, op5_chat_format
from .urls import OP6_SQL, op6_url_filter
from .vectors import op2_embedding_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_simhash": op4_simhash,
        "op5_chat_format": op5_chat_format,
        "op6_url_filter": op6_url_filter,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_url_filter": OP6_SQL}
