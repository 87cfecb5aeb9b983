"""The subpackage's queries and their SQL, as the driver's entry module lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm.decontamination import op9_decontamination
from kinmatch.llm.license_scan import OP8_SQL, op8_license_scan
from kinmatch.llm.line_dedup import OP6_SQL, op6_line_dedup
from kinmatch.llm.near_dup import op1_near_duplicates
from kinmatch.llm.pii import op4_pii
from kinmatch.llm.piece_sampling import op2_piece_sampling
from kinmatch.llm.quality_rules import OP7_SQL, op7_quality_rules
from kinmatch.llm.secret_scan import op10_secret_scan
from kinmatch.llm.token_counts import op5_token_counts
from kinmatch.llm.warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_piece_sampling": op2_piece_sampling,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_license_scan": OP8_SQL,
}
