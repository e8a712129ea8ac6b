"""Queries of this package: a thin opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, language, line_rules, mixing, quality_model, revisits, sharding, simhash, token_counts, weighted_sampling


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash,
        token_counts.op2_token_counts,
        revisits.op3_revisits,
        sharding.op4_histogram_shards,
        weighted_sampling.op5_weighted_sampling,
        language.op6_language,
        mixing.op7_mixing,
        bpe.op8_bpe,
        line_rules.op9_line_rules,
        quality_model.op10_quality_model,
        pipeline,
    )
}

ORACLE_SQL = {"op9_line_rules": line_rules.OP9_SQL, "op3_revisits": revisits.OP3_SQL}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
