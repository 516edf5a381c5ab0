"""Checks and roll-ups of assessment tables: findings by role and hypothesis that cite evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points between the roles' top scores from which they count as apart.
APART = 20


#: What a finding may say of its evidence.
SUFFICIENCY = ("SUFFICIENT", "PARTIAL", "INSUFFICIENT")
#: Words that no hypothesis may hold.
FORBIDDEN = ("blame", "guilt", "responsib", "culpab", "intent", "negligence", "malpractice", "arson", "prosecut", "sanction", "company", "operator", "concession holder")


def _problem(rows: DataFrame, bad, text, *keys: str) -> DataFrame:
    return rows.where(bad).select(*keys, (F.lit(text) if isinstance(text, str) else text).alias("problem"))


def finding_problems(findings: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(role, hypothesis, problem): scores that aren't whole numbers of 0..100, unknown sufficiency, cited ids that don't exist, hypotheses unknown, missing or found twice."""
    keys = ("role", "hypothesis")
    score = F.col("score").cast("double")
    out = _problem(findings, score.isNull() | ~score.between(0, 100), "score out of range", *keys)
    out = out.union(_problem(findings, score.between(0, 100) & (score != F.floor(score)), "score is not a whole number", *keys))
    if "sufficiency" in findings.columns:
        out = out.union(_problem(findings, ~F.coalesce(F.upper("sufficiency").isin(*SUFFICIENCY), F.lit(False)), "unknown sufficiency", *keys))
    known = hypotheses.select("hypothesis").distinct()
    out = out.union(_problem(findings.join(known, "hypothesis", "left_anti").select(*keys).distinct(), F.lit(True), "unknown hypothesis", *keys))
    cited = findings.select(*keys, F.explode("evidence_ids").alias("evidence_id"))
    unknown = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").distinct()
    out = out.union(_problem(unknown, F.lit(True), F.concat(F.lit("unknown evidence "), "evidence_id"), *keys))
    out = out.union(_problem(findings.groupBy(*keys).count(), F.col("count") > 1, "found twice", *keys))
    wanted = findings.select("role").distinct().crossJoin(known)
    return out.union(_problem(wanted.join(findings, list(keys), "left_anti"), F.lit(True), "not found", *keys))


def evidence_problems(evidence: DataFrame) -> DataFrame:
    """(evidence_id, problem): rows without an id, an observation or a source, and ids that occur twice."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    named = evidence.withColumn("evidence_id", F.trim("evidence_id"))
    out = _problem(named, empty("evidence_id"), "no id", "evidence_id")
    for c in ("observation", "source"):
        out = out.union(_problem(named, ~empty("evidence_id") & empty(c), f"no {c}", "evidence_id"))
    twice = named.where(~empty("evidence_id")).groupBy("evidence_id").count()
    return out.union(_problem(twice, F.col("count") > 1, "occurs twice", "evidence_id"))


def hypothesis_problems(hypotheses: DataFrame) -> DataFrame:
    """(hypothesis, problem): without an id or a label, with a forbidden word, or there twice."""
    h = hypotheses.select(F.trim("hypothesis").alias("hypothesis"), F.trim("label").alias("label"))
    missing = (F.coalesce("hypothesis", F.lit("")) == "") | (F.coalesce("label", F.lit("")) == "")
    out = _problem(h, missing, "no id or label", "hypothesis")
    out = out.union(_problem(h, F.lower("label").rlike("|".join(FORBIDDEN)), "forbidden wording", "hypothesis"))
    return out.union(_problem(h.groupBy("hypothesis").count(), F.col("count") > 1, "occurs twice", "hypothesis"))


def evidence_buckets(findings: DataFrame) -> DataFrame:
    """(role, hypothesis, supporting, contradicting, mixed): ids on both sides are mixed."""
    s, c = F.array_distinct("supporting"), F.array_distinct("contradicting")
    return findings.select("role", "hypothesis", F.sort_array(F.array_except(s, c)).alias("supporting"), F.sort_array(F.array_except(c, s)).alias("contradicting"), F.sort_array(F.array_intersect(s, c)).alias("mixed"))


def disagreement(findings: DataFrame, first: str, second: str) -> DataFrame:
    """One row if two roles' leading hypotheses differ, or their scores for the same one by APART or more: the question that stays open."""
    w = Window.partitionBy("role").orderBy(F.desc("score"), "nth", "hypothesis")
    top = findings.where(F.col("role").isin(first, second)).withColumn("n", F.row_number().over(w)).where("n = 1")
    a = top.where(F.col("role") == first).select(F.col("hypothesis").alias("first_top"), F.col("score").alias("first_score"), F.col("evidence_ids").alias("i1"))
    b = top.where(F.col("role") == second).select(F.col("hypothesis").alias("second_top"), F.col("score").alias("second_score"), F.col("evidence_ids").alias("i2"))
    same = F.col("first_top") == F.col("second_top")
    return a.crossJoin(F.broadcast(b)).where(~same | (F.abs(F.col("first_score") - F.col("second_score")) >= APART)).select(
        "first_top", "first_score", "second_top", "second_score", F.when(same, "support differs").otherwise("leading hypotheses differ").alias("question"), F.array_distinct(F.concat("i1", "i2")).alias("evidence_ids")
    )


def open_questions(questions: DataFrame) -> DataFrame:
    """(question, evidence_ids, asked, status): repeats merged by text and set of ids."""
    ids = F.array_sort(F.array_distinct("evidence_ids"))
    return questions.groupBy("question", ids.alias("evidence_ids")).agg(F.count("*").alias("asked"), F.when(F.bool_and("settled"), "CONVERGED").otherwise("UNRESOLVED").alias("status"))
