"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cws, langid, licenses, line_dedup, media, mixing, packing, secrets, simhash, substring


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_media_copies": media.op5_media_copies,
        "op6_language_id": langid.op6_language_id,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_substring_dedup": substring.op8_substring_dedup,
        "op9_source_mixing": mixing.op9_source_mixing,
        "op10_document_fingerprints": cws.op10_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.op1_sql(), "op9_source_mixing": mixing.OP9_SQL}
