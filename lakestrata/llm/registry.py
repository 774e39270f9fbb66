"""The queries of this package and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bagminhash import op8_bagminhash
from .bpe import op10_bpe
from .collocations import op13_collocations, op13_sql
from .licenses import op2_licenses, op2_sql
from .onebit import op9_nearest
from .packing import op7_packing
from .passages import op6_passages
from .pii import op12_personal_data
from .quality import op5_quality
from .runs import op11_runs
from .syncmers import op4_syncmers
from .token_files import op1_token_files
from .warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_licenses": op2_licenses,
    "op3_warc": op3_warc,
    "op4_syncmers": op4_syncmers,
    "op5_quality": op5_quality,
    "op6_passages": op6_passages,
    "op7_packing": op7_packing,
    "op8_bagminhash": op8_bagminhash,
    "op9_nearest": op9_nearest,
    "op10_bpe": op10_bpe,
    "op11_runs": op11_runs,
    "op12_personal_data": op12_personal_data,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op2_licenses": op2_sql(), "op3_warc": OP3_SQL, "op13_collocations": op13_sql()}
