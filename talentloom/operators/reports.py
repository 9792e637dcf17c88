"""Report queries over rankings and hiring profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx

SHORT_LABELS = ("Technical", "Semantic", "Evidence", "Authenticity", "Narrative", "Behavioral",
                "Recruitability")


def score_histogram(ranked: DataFrame, score: str = "score", bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and the largest score; empty bins are left out."""
    s = F.col(score)
    bounds = ranked.agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    position = F.floor((s - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    bucket = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(position, F.lit(bins - 1))).cast("int")
    return ranked.join(F.broadcast(bounds), F.lit(True)).groupBy(bucket.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def ranking_table(with_metadata: DataFrame) -> DataFrame:
    """The 13-column table: four digits for the score, three for the rest."""
    dims = [fx.round_exact(F.col(key), 3).alias(label.lower())
            for (key, _, _), label in zip(S.DIMENSIONS, SHORT_LABELS)]
    return with_metadata.select(
        "jd_id", "rank", F.col("name").alias("candidate"), "title", F.col("years").alias("experience"),
        fx.round_exact(F.col("final_score"), 4).alias("score"), *dims,
        fx.round_exact(F.col("confidence"), 3).alias("confidence"))


def search(table: DataFrame, min_score: float = 0.0, pattern: str = "") -> DataFrame:
    """Rows at or above a score whose name or title matches a pattern, case-folded."""
    kept = table.where(F.col("score") >= min_score)
    if not pattern:
        return kept
    lowered = pattern.lower()
    return kept.where(F.lower("candidate").rlike(lowered) | F.lower("title").rlike(lowered))


def dimensions_long(ranked: DataFrame, n: int = 5) -> DataFrame:
    """First n per job, one row per dimension."""
    pairs = ", ".join(f"'{label}', {key}" for (key, _, _), label in zip(S.DIMENSIONS, SHORT_LABELS))
    return ranked.where(F.col("rank") <= n).select(
        "jd_id", "rank", "candidate_id",
        F.expr(f"stack({len(S.DIMENSIONS)}, {pairs}) AS (dimension, value)"))


def contribution_matrix(explanations: DataFrame, n: int = 20) -> DataFrame:
    """First n per job, one column per module; missing modules are 0."""
    modules = F.col("module_contributions")
    return explanations.where(F.col("rank") <= n).select("jd_id", "rank", "candidate_id", *[
        F.coalesce(F.try_element_at(modules, F.lit(label)), F.lit(0.0)).alias(key)
        for key, label, _ in S.DIMENSIONS])


def candidate_card(ranked: DataFrame) -> DataFrame:
    """Header and quick stats of each ranked candidate."""
    return ranked.select(
        "jd_id", "rank", "candidate_id", "name", "title", "years",
        F.col("skill.total_skills").alias("skills"), F.col("matched_count").alias("relevant_skills"),
        fx.percent(F.col("skill_coverage")).alias("skill_coverage"),
        F.col("career.total_companies").alias("companies"),
        fx.percent(F.col("skill.assessment_score_avg")).alias("assessment_avg"),
        fx.score_band(F.col("score")).alias("band"))


def headline_metrics(total: DataFrame, ranked: DataFrame, runtime_seconds: float | Column) -> DataFrame:
    """Total, ranked, runtime, throughput and top score in one row."""
    runtime = runtime_seconds if isinstance(runtime_seconds, Column) else F.lit(float(runtime_seconds))
    counted = total.agg(F.count(F.lit(1)).alias("total_candidates"))
    best = ranked.agg(F.count(F.lit(1)).alias("candidates_ranked"), F.max("score").alias("_top"))
    return counted.join(F.broadcast(best), F.lit(True)).select(
        "total_candidates", "candidates_ranked", runtime.alias("runtime_seconds"),
        (F.col("total_candidates") / F.greatest(F.lit(0.1), runtime)).alias("throughput"),
        fx.round_exact(F.col("_top"), 4).alias("top_score"))


def band_counts(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(fx.score_band(F.col(score)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def top_competencies(profiles: DataFrame, n: int = 15) -> DataFrame:
    """First n required and preferred competencies of each job, with their band."""
    def first(column: str) -> Column:
        return F.transform(F.slice(column, 1, n), lambda c, i: F.struct(
            F.lit(column).alias("kind"), (i + 1).alias("ord"), c["name"].alias("name"),
            c["importance"].alias("importance")))
    both = profiles.select("jd_id", F.concat(first("required"), first("preferred")).alias("all"))
    rows = fx.element_rows(both, "all", "jd_id").select("jd_id", "element.*")
    return rows.withColumn("band", fx.score_band(F.col("importance")))


def top_philosophy(profiles: DataFrame, n: int = 5) -> DataFrame:
    top = fx.element_rows(profiles, "philosophy", "jd_id", pos="ord").where(F.col("ord") <= n)
    return top.select("jd_id", "ord", "element.dimension", "element.strength")


def weight_shares(profiles: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{label}', weights.{key}" for key, label, _ in S.DIMENSIONS)
    return profiles.select("jd_id", F.expr(f"stack({len(S.DIMENSIONS)}, {pairs}) AS (dimension, share)"))
