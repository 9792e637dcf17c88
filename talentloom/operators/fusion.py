"""Cheap score, seven fused dimensions and the final score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx


def cheap_score(c: Mapping[str, Column]) -> Column:
    """Coverage, experience, title, assessment and completeness: no evidence needed."""
    years, low, high = c["years"], c["min_years"], c["max_years"]
    fit = F.when((years >= low) & (years <= high), 0.15).when(years >= low * 0.7, 0.08).otherwise(0.0)
    return fx.clip(
        c["skill_coverage"] * 0.25 + c["skills_ratio"] * 0.15 + fit + c["title_relevance"] * 0.15
        + c["assessment_avg"] * 0.10 + c["relevant_assessment"] * 0.10
        + (c["completeness"] / 100.0) * 0.05 + c["proficiency"] * 0.05)


def fused_technical(coverage: Column, ratio: Column, proficiency: Column, assessment: Column,
                    title: Column) -> Column:
    return fx.clip(coverage * 0.35 + ratio * 0.25 + proficiency * 0.15 + assessment * 0.15 + title * 0.10)


def fused_evidence(score: Column, coverage: Column, density: Column) -> Column:
    return fx.clip(score * 0.5 + coverage * 0.3 + density * 0.2 * 0.25)


def final_score(dims: Mapping[str, Column], weights: Column) -> Column:
    """Weighted dimensions plus interaction bonuses, less the low-authenticity penalty."""
    keys = [key for key, _, _ in S.DIMENSIONS]
    base = fx.weighted_average(
        [dims[k] for k in keys],
        [F.coalesce(weights[k], F.lit(w)) for k, _, w in S.DIMENSIONS])

    def add(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    tech, evidence = dims["technical_alignment"], dims["evidence_strength"]
    trust = dims["authenticity"]
    return fx.clip(
        base
        + add((tech > 0.6) & (evidence > 0.6), 0.03)
        + add((dims["semantic_relevance"] > 0.5) & (dims["career_narrative"] > 0.5), 0.02)
        + add((trust > 0.7) & (evidence > 0.5), 0.02)
        + add(trust < 0.3, -0.05))
