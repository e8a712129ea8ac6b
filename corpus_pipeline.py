"""A corpus from documents: quality rules, quality classifier, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one returns tokens.

In every stage null and empty texts, very long ones, ties, repeated rows and an empty table are defined: null and empty texts fail the
quality rules, so none reaches later stages of run(); given one, the classifier scores it, near_dedup takes it as a copy of the other
ones, the mix takes it as no tokens, and it has no ids. Texts are taken whole. Rows equal in all columns are rows of their own until
near_dedup, where one stays. A null id, language or source is a value like any other. Columns that documents hasn't got pass through,
whatever their names. An empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkin.llm import bpe, line_rules, mixing, quality_model, simhash
from textkin.llm.common import free_name, table, words, written

#: Near-duplicates in the pipeline: sets of five-word shingles with a similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8
#: The mix holds this share of the tokens that reach it, a leaf at most twice.
MIX_SHARE, MAX_EPOCHS = 0.8, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted of their words by removing boilerplate lines, without those lines."""
    kept = line_rules.filtered(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model accepts; it never sees a held-out label."""
    model = quality_model.fit_on_known(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = free_name(docs, "_score")
    return quality_model.scored(docs, model, out_col=score).where(F.col(score) >= quality_model.ACCEPT).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of SimHash links and set links, one row of it."""
    return simhash.deduplicated(docs, words_per_shingle=SHINGLE, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to their sources' budgets; a second epoch repeats rows."""
    domain, tokens, *out = (free_name(docs, c) for c in ("_domain", "_tokens_of", "_epoch_of", "_leaf_budget", "_tokens_before"))
    sized = docs.withColumn(domain, mixing.domain_of(F.col("source"))).withColumn(tokens, F.size(words(F.col("text"))).cast("long"))
    return mixing.mix(sized, mixing.target_weight, MIX_SHARE, MAX_EPOCHS, path=(domain, "lang", "source"), tokens_col=tokens, out=tuple(out)).select(docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, decoded) of each document."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path(), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: The classifier's training isn't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
