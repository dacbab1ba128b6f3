"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP4_SQL, op4_chat_formatting
from .decontam import op7_decontamination
from .licenses import op8_license_scan
from .neardup import op3_near_duplicates
from .packing import op5_best_fit_packing
from .pages import op1_html_extraction
from .pii import OP2_SQL, op2_personal_data
from .pseudo import op6_lm_scoring
from .quality import op9_quality_rules
from .resample import op11_importance_resampling
from .sstable import op10_token_shards
from .trie import OP12_SQL, op12_prefix_trie
from .warc import OP13_SQL, op13_warc_captures


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_personal_data, op3_near_duplicates, op4_chat_formatting, op5_best_fit_packing, op6_lm_scoring, op7_decontamination, op8_license_scan, op9_quality_rules, op10_token_shards, op11_importance_resampling, op12_prefix_trie, op13_warc_captures]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_personal_data": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op12_prefix_trie": OP12_SQL, "op13_warc_captures": OP13_SQL}
