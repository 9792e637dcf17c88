"""Profile consistency checks (job-free, except the evidence alignment)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx


def semantic_coherence(title_lc: Column, headline_lc: Column, summary_lc: Column, career: Column) -> Column:
    """Do headline and summary repeat the current title and the recent titles?"""
    title_words = fx.words(title_lc)
    in_headline = F.size(F.filter(title_words, lambda w: F.contains(headline_lc, w)))
    headline_part = F.when(F.size(title_words) > 0,
                           in_headline / F.size(title_words) * 0.3).otherwise(F.lit(0.0))
    recent = F.flatten(F.transform(F.slice(career, 1, 3), lambda e: fx.words(F.lower(e["title"]))))
    keywords = F.array_distinct(F.filter(recent, lambda w: F.length(w) > 3))
    in_summary = F.size(F.filter(keywords, lambda w: F.contains(summary_lc, w)))
    score = F.lit(0.5) + headline_part + F.least(F.lit(0.2), in_summary * 0.05)
    return F.when((headline_lc == "") | (summary_lc == ""), F.lit(0.5)).otherwise(fx.clip(score))


def adjacent(values: Column) -> tuple[Column, Column]:
    """(newer, older) neighbours of an array ordered newest first."""
    steps = F.greatest(F.size(values) - 1, F.lit(0))
    return F.slice(values, 1, steps), F.slice(values, 2, steps)


def career_coherence(career: Column) -> Column:
    """Share of moves within the same (1) or a related (0.5) industry."""
    newer, older = adjacent(F.transform(career, lambda e: e["industry"]))

    def relation(now: Column, before: Column) -> Column:
        related = F.exists(fx.words(F.lower(before)),
                           lambda w: (F.length(w) > 3) & F.contains(F.lower(now), w))
        return (F.when((now == "") | (before == ""), 0.0).when(now == before, 1.0)
                .when(related, 0.5).otherwise(0.0))

    moves = F.zip_with(newer, older, relation)
    score = fx.clip(F.lit(0.4) + fx.sum_of(moves) / F.size(moves) * 0.6)
    return F.when(F.size(career) < 2, F.lit(0.7)).otherwise(score)


def evidence_alignment(n_competencies: Column, coverage: Column, evidence_score: Column) -> Column:
    return F.when(n_competencies == 0, F.lit(0.5)).otherwise(
        fx.clip(coverage * 0.5 + evidence_score * 0.5))


def timeline_mismatch(stated_years: Column, total_months: Column, n_jobs: Column) -> Column:
    """True if the summed job months and the stated years differ by more than a factor 2."""
    ratio = F.try_divide(total_months / 12.0, stated_years)
    return (n_jobs >= 2) & (stated_years > 0) & F.coalesce((ratio < 0.5) | (ratio > 2.0), F.lit(False))


def timeline_consistency(n_jobs: Column, mismatch: Column) -> Column:
    return F.when(n_jobs < 2, F.lit(0.9)).when(mismatch, F.lit(0.8)).otherwise(F.lit(1.0))


def timeline_messages(stated_years: Column, total_months: Column, mismatch: Column) -> Column:
    text = F.concat(F.lit("Experience mismatch: stated "), fx.fixed(stated_years, 1),
                    F.lit("y vs computed "), fx.fixed(total_months / 12.0, 1), F.lit("y"))
    return F.when(mismatch, F.array(text)).otherwise(F.array().cast("array<string>"))


def overlapping_jobs(career: Column) -> Column:
    """Number of entry pairs (newer, older) whose dates overlap; informative only.

    Counted inside the row: no pair is ever emitted.
    """
    ends = F.transform(career, lambda e: F.coalesce(e["end_date"], F.lit("")))

    def later_ends(entry: Column, i: Column) -> Column:
        rest = F.slice(ends, i + 2, F.size(ends))
        counted = F.size(F.filter(rest, lambda end: (end != "") & (entry["start_date"] < end)))
        return F.when((entry["start_date"] != "") & ~entry["is_current"], counted).otherwise(0)

    return F.aggregate(F.transform(career, later_ends), F.lit(0), lambda acc, n: acc + n)


def education_alignment(education: Column, title_lc: Column) -> Column:
    def is_tech(field: Column) -> Column:
        hit = F.lit(False)
        for term in S.TECH_FIELDS:
            hit = hit | F.lower(field).contains(term)
        return hit
    tech_role = F.lit(False)
    for term in S.TECH_TITLE_TERMS:
        tech_role = tech_role | title_lc.contains(term)
    studied = F.exists(education, lambda e: is_tech(e["field_of_study"]))
    return (F.when(F.size(education) == 0, 0.5).when(~tech_role, 0.6)
            .when(studied, 0.8).otherwise(0.5))


def profile_support(summary: Column, career: Column, skills: Column, education: Column,
                    certifications: Column) -> Column:
    def add(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)
    score = (F.lit(0.5) + add(F.length(summary) > 50, 0.15) + add(F.size(career) > 0, 0.15)
             + add(F.size(skills) > 0, 0.10) + add(F.size(education) > 0, 0.05)
             + add(F.size(certifications) > 0, 0.05))
    return fx.clip(score)


def authenticity(parts: list[Column]) -> Column:
    """Coherence, career, evidence, timeline, education and support, weighted."""
    return fx.weighted_average(parts, S.AUTHENTICITY_WEIGHTS)
