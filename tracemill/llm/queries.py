"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP6_SQL, op6_decontamination
from .licenses import op9_license_scan
from .lines import op5_line_dedup
from .mixing import op2_temperature_mixing
from .quality import op8_compression_bands
from .runs import op12_periodic_runs
from .secrets import op10_secret_forest
from .simhash import op4_simhash_near_dedup
from .suffixes import op3_suffix_dedup
from .toxicity import op1_toxicity
from .urls import op7_path_templates
from .warc import OP11_SQL, op11_warc_revisits
from .whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_path_templates": op7_path_templates,
    "op8_compression_bands": op8_compression_bands,
    "op9_license_scan": op9_license_scan,
    "op10_secret_forest": op10_secret_forest,
    "op11_warc_revisits": op11_warc_revisits,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op11_warc_revisits": OP11_SQL}
