"""Queries ``opN_<name>`` of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tillroll.llm import (bpe, decontaminate, hard_negatives, html_blocks, licenses, line_quality, multi_index, secrets,
                          sharding, simhash, spelling, toxicity, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_line_quality": line_quality.op1_line_quality,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_stratified_shards": sharding.op4_stratified_shards,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_html_blocks": html_blocks.op6_html_blocks,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_multi_index": multi_index.op13_multi_index,
}
ORACLE_SQL: dict[str, str] = {
    "op4_stratified_shards": sharding.OP4_SQL,
    "op5_license_scan": licenses.OP5_SQL,
}
