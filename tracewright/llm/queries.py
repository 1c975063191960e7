"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import (
    op01_nearest,
    op02_sharding,
    op03_repeats,
    op04_pii,
    op05_language_id,
    op06_html,
    op07_packing,
    op08_decontamination,
    op09_secrets,
    op10_jaccard_join,
    op11_importance_resampling,
    op12_centroids,
    op13_embedding_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_matrix_nearest": op01_nearest.op1_block_matrix_nearest,
    "op2_jump_hash_sharding": op02_sharding.op2_jump_hash_sharding,
    "op3_radix_repeats": op03_repeats.op3_radix_repeats,
    "op4_information_theoretic_pii": op04_pii.op4_information_theoretic_pii,
    "op5_compression_language_id": op05_language_id.op5_compression_language_id,
    "op6_minimum_cut_html": op06_html.op6_minimum_cut_html,
    "op7_best_fit_packing": op07_packing.op7_best_fit_packing,
    "op8_decontamination": op08_decontamination.op8_decontamination,
    "op9_multipart_secrets": op09_secrets.op9_multipart_secrets,
    "op10_minhash_jaccard_join": op10_jaccard_join.op10_minhash_jaccard_join,
    "op11_importance_resampling": op11_importance_resampling.op11_importance_resampling,
    "op12_centroid_clustering": op12_centroids.op12_centroid_clustering,
    "op13_embedding_near_dedup": op13_embedding_dedup.op13_embedding_near_dedup,
}
ORACLES: dict[str, str] = {
    "op1_block_matrix_nearest": op01_nearest.ORACLE,
    "op2_jump_hash_sharding": op02_sharding.ORACLE,
    "op8_decontamination": op08_decontamination.ORACLE,
    "op11_importance_resampling": op11_importance_resampling.ORACLE,
    "op12_centroid_clustering": op12_centroids.ORACLE,
    "op13_embedding_near_dedup": op13_embedding_dedup.ORACLE,
}
