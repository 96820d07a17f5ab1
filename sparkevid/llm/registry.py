"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import op11_conversation_repair
from .histogram_packing import op12_histogram_packing
from .html_text import op9_html_extraction
from .license_scan import ORACLE as LICENSE_SQL
from .license_scan import op10_license_scan
from .motion_jpeg import op6_media_columns
from .packing import op1_best_fit_packing
from .quality_rules import op3_quality_rules
from .sentencepiece_codec import op7_sentencepiece_codec
from .simhash import op8_simhash_near_dedup
from .substring_dedup import ORACLE as SUBSTRING_SQL
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op2_suffix_array_dedup
from .token_counts import op5_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_media_columns": op6_media_columns,
    "op7_sentencepiece_codec": op7_sentencepiece_codec,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_histogram_packing": op12_histogram_packing,
}
ORACLE: dict[str, str] = {"op4_substring_dedup": SUBSTRING_SQL, "op10_license_scan": LICENSE_SQL}
