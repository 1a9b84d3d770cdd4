"""The training-data queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_lines import op1_lines
from .op2_decontaminate import op2_decontaminate
from .op3_chat import op3_chat
from .op4_simhash import op4_simhash
from .op5_rules import op5_rules
from .op6_tokens import op6_tokens
from .op7_secrets import op7_secrets
from .op8_packing import op8_packing
from .op9_quality import op9_quality
from .op10_urls import op10_urls
from .oracles import OP1, OP2


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lines": op1_lines,
        "op2_decontaminate": op2_decontaminate,
        "op3_chat": op3_chat,
        "op4_simhash": op4_simhash,
        "op5_rules": op5_rules,
        "op6_tokens": op6_tokens,
        "op7_secrets": op7_secrets,
        "op8_packing": op8_packing,
        "op9_quality": op9_quality,
        "op10_urls": op10_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": OP1, "op2_decontaminate": OP2}
