"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import decontam, language, line_dedup, lm_score, mixing, negatives, neighbours, periodic, quality, simhash, substring, toxicity, training_order
from emberframe.llm.common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.shards(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "doc_at", "item_at")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.quantised(table(spark, sf_dir, "embeddings"), relabelled=label), F.col("id") % 50 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"), reorder=periodic.cycled)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_neighbours": op2_neighbours,
        "op3_training_order": op3_training_order,
        "op4_decontaminate": op4_decontaminate,
        "op5_line_dedup": op5_line_dedup,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_mix": op9_mix,
        "op10_lm_score": op10_lm_score,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": decontam.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op9_mix": mixing.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op13_substring_dedup": substring.ORACLE}
