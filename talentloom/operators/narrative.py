"""Career trajectory: moves between adjacent jobs and drift toward the target role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx
from talentloom.operators.authenticity import adjacent


def transitions(career: Column, levels: Column) -> Column:
    """One struct per move, newest first (career_history is newest first)."""
    with_level = F.zip_with(career, levels, lambda e, level: F.struct(
        e["title"].alias("title"), e["industry"].alias("industry"), level.alias("level")))
    newer, older = adjacent(with_level)

    def move(now: Column, before: Column) -> Column:
        same_industry = now["industry"] == before["industry"]
        return F.struct(
            before["title"].alias("from_title"), now["title"].alias("to_title"),
            before["industry"].alias("from_industry"), now["industry"].alias("to_industry"),
            (now["level"] > before["level"]).alias("is_advancement"),
            (now["level"] == before["level"]).alias("is_lateral"),
            (same_industry & (now["level"] >= before["level"])).alias("is_specialization"),
            F.when(same_industry, 0.8).otherwise(0.5).alias("transition_quality"),
        )
    return F.zip_with(newer, older, move)


def transition_rows(prepared: DataFrame) -> DataFrame:
    """One row per move with its position (1 = most recent)."""
    moves = prepared.select("candidate_id", transitions(F.col("career_history"), F.col("levels")).alias("m"))
    return fx.element_rows(moves, "m", "candidate_id").select("candidate_id", "pos", "element.*")


def _share(values: Column, test) -> Column:
    """Share of adjacent (newer, older) pairs that pass the test; NULL without pairs."""
    newer, older = adjacent(values)
    marks = F.zip_with(newer, older, test)
    return F.when(F.size(marks) > 0, fx.sum_of(marks) / F.size(marks))


def progression(levels: Column) -> Column:
    """Share of moves up (0.4) and of moves that are not down (0.3) over a base of 0.3."""
    up = _share(levels, lambda a, b: (a > b).cast("double"))
    steady = _share(levels, lambda a, b: (a >= b).cast("double"))
    return F.when(F.size(levels) < 2, F.lit(0.6)).otherwise(
        fx.clip(F.lit(0.3) + up * 0.4 + steady * 0.3))


def growth(sizes: Column, levels: Column) -> Column:
    """Moves to larger companies and non-decreasing seniority."""
    bigger = _share(sizes, lambda a, b: F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0))
    steady = _share(levels, lambda a, b: (a >= b).cast("double"))
    return F.when(F.size(sizes) < 2, F.lit(0.5)).otherwise(
        fx.clip(F.lit(0.3) + bigger * 0.3 + steady * 0.4))


#: What one target word adds to an entry's score, which is 1 at most.
FIRST_STEP, DOMAIN_STEP = 0.15, 0.12


def recent_and_older(hits: Column) -> Column:
    """Mean scores of the two latest jobs and of the older ones.

    ``hits`` holds the number of target words per job, newest first.
    """
    def averages(scores: Column) -> Column:
        return F.struct(
            fx.mean_of(F.slice(scores, 1, 2)).alias("recent"),
            fx.mean_of(F.slice(scores, 3, F.greatest(F.size(scores), F.lit(1)))).alias("older"))

    return fx.let(F.transform(hits, lambda h: F.least(F.lit(1.0), h * FIRST_STEP)), averages)


def specialization(recent: Column, older: Column) -> Column:
    """Do the two latest jobs mention the target words more than the older ones?"""
    return F.when(recent > older, fx.clip(F.lit(0.5) + recent * 0.5)).otherwise(fx.clip(F.lit(0.3) + recent * 0.4))


def domain_mean(hits: Column) -> Column:
    """Mean score of all jobs."""
    return fx.mean_of(F.transform(hits, lambda h: F.least(F.lit(1.0), h * DOMAIN_STEP)))


def domain_alignment(mean: Column) -> Column:
    return fx.clip(mean)


def direction(progression_score: Column, n_jobs: Column) -> Column:
    return (F.when(n_jobs == 0, "").when(progression_score > 0.7, "ascending")
            .when(progression_score > 0.5, "lateral").when(progression_score > 0.3, "mixed")
            .otherwise("declining"))


def narrative(n_jobs: Column, parts: list[Column]) -> Column:
    """Progression, specialization, growth and domain alignment, weighted; 0.3 without jobs."""
    return F.when(n_jobs == 0, F.lit(0.3)).otherwise(fx.weighted_average(parts, S.NARRATIVE_WEIGHTS))
