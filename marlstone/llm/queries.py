"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import exact_dedup, licenses, media, mixing, packing, pii, simhash, substring_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_warc": warc.op2_warc,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_media": media.op7_media,
        "op8_packing": packing.op8_packing,
        "op9_licenses": licenses.op9_licenses,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op3_exact_dedup": exact_dedup.SQL, "op4_mixing": mixing.SQL}
