"""Candidate features that do not depend on a job.

All functions build Columns over one nested candidate row; ``prepare`` adds the
lower-cased and tokenised helpers once so that no later operator repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx


@fx.build_once
def _helpers() -> list[Column]:
    career = F.col("career_history")
    described = F.filter(career, lambda e: e["description"] != "")
    scores = F.map_entries("platform_signals.skill_assessment_scores")
    return [
        fx.lower_or_empty(F.col("profile.current_title")).alias("title_lc"),
        fx.lower_or_empty(F.col("profile.headline")).alias("headline_lc"),
        fx.lower_or_empty(F.col("profile.summary")).alias("summary_lc"),
        fx.lower_or_empty(F.col("profile.current_industry")).alias("industry_lc"),
        F.transform("skills", lambda s: F.struct(
            F.lower(s["name"]).alias("name_lc"), s["endorsements"], s["duration_months"])).alias("skill_facts"),
        F.transform("certifications", lambda c: F.lower(c["name"])).alias("certs_lc"),
        F.transform(career, lambda e: F.lower(e["description"])).alias("descriptions_lc"),
        F.transform(career, lambda e: F.lower(
            F.concat(e["title"], F.lit(" "), e["description"]))).alias("entries_lc"),
        F.array_join(F.transform(described, lambda e: F.lower(e["description"])), " ").alias("career_lc"),
        F.transform(scores, lambda a: F.struct(
            F.lower(a["key"]).alias("name_lc"), a["value"].alias("score"))).alias("assessments"),
        F.transform(career, lambda e: fx.seniority(e["title"])).alias("levels"),
        F.transform(career, lambda e: fx.company_size_level(e["company_size"])).alias("sizes"),
        F.transform(career, lambda e: e["duration_months"]).alias("months"),
    ]


@fx.build_once
def _joined_helpers() -> list[Column]:
    return [
        F.array_distinct(F.transform("skill_facts", lambda s: s["name_lc"])).alias("skill_names_lc"),
        F.array_join(F.transform("skill_facts", lambda s: s["name_lc"]), "\n").alias("skills_text"),
        F.array_join(F.transform("assessments", lambda a: a["name_lc"]), "\n").alias("tests_text"),
        F.array_join("entries_lc", "\n").alias("entries_text"),
    ]


def prepare(candidates: DataFrame) -> DataFrame:
    """Add the helper columns every operator reads."""
    return candidates.select("*", *_helpers()).select("*", *_joined_helpers())


def career_text(career: Column) -> Column:
    """"title at company: description" of the described entries, joined by blanks."""
    described = F.filter(career, lambda e: e["description"] != "")
    return F.array_join(F.transform(described, lambda e: F.concat(
        e["title"], F.lit(" at "), e["company"], F.lit(": "), e["description"])), " ")


def skill_names(skills: Column) -> Column:
    return F.transform(skills, lambda s: s["name"])


# -- skills and assessments ------------------------------------------------------

def _proficiency(level: Column) -> Column:
    known = F.lit(1)
    for name, value in S.PROFICIENCY_LEVELS.items():
        known = F.when(level == name, value).otherwise(known)
    return known


def skill_aggregates(skills: Column, assessments: Column, certifications: Column) -> Column:
    """Counts and means over skills; every field is 0 when there are no skills."""
    n = F.size(skills)
    used = F.filter(F.transform(skills, lambda s: s["duration_months"]), lambda m: m > 0)
    strong = F.filter(skills, lambda s: s["proficiency"].isin(*S.STRONG_PROFICIENCIES))
    has = n > 0

    def guarded(value: Column, empty: Column) -> Column:
        return F.when(has, value).otherwise(empty)

    zero, none = F.lit(0.0), F.lit(0)
    return F.struct(
        n.alias("total_skills"),
        guarded(fx.mean_of(F.transform(skills, lambda s: _proficiency(s["proficiency"]))) / 4.0,
                zero).alias("avg_proficiency"),
        guarded(fx.mean_of(F.transform(skills, lambda s: s["endorsements"])), zero).alias("avg_endorsements"),
        guarded(fx.mean_of(used), zero).alias("avg_skill_duration"),
        guarded(F.size(strong) / n, zero).alias("advanced_expert_ratio"),
        guarded(fx.mean_of(F.transform(assessments, lambda a: a["score"])) / 100.0,
                zero).alias("assessment_score_avg"),
        guarded(F.size(certifications), none).alias("certification_count"),
    )


# -- career and education -----------------------------------------------------------

def career_aggregates(career: Column, months: Column, sizes: Column) -> Column:
    total = F.aggregate(months, F.lit(0).cast("bigint"), lambda acc, m: acc + m)
    current = F.get(F.filter(career, lambda e: e["is_current"]), F.lit(0))
    return F.struct(
        F.size(career).alias("total_companies"),
        total.alias("total_career_months"),
        fx.mean_of(months).alias("avg_tenure_months"),
        F.coalesce(current["duration_months"], F.lit(0)).alias("current_tenure_months"),
        F.exists(sizes, lambda s: s <= 2).alias("startup_experience"),
        F.exists(sizes, lambda s: s >= 6).alias("large_company_experience"),
    )


def _degree_level(degree: Column) -> Column:
    lowered = F.lower(degree)
    keywords = iter(S.DEGREE_LEVELS.items())
    word, level = next(keywords)
    case = F.when(lowered.contains(word), level)
    for word, level in keywords:
        case = case.when(lowered.contains(word), level)
    return case.otherwise(0)


def _tier(tier: Column) -> Column:
    rank = F.lit(S.LOWEST_TIER)
    for name, value in S.INSTITUTION_TIERS.items():
        rank = F.when(tier == name, value).otherwise(rank)
    return rank


def education_aggregates(education: Column) -> Column:
    n = F.size(education)
    return F.struct(
        n.alias("education_count"),
        F.coalesce(F.array_max(F.transform(education, lambda e: _degree_level(e["degree"]))),
                   F.lit(0)).alias("highest_degree_level"),
        F.coalesce(F.array_min(F.transform(education, lambda e: _tier(e["tier"]))),
                   F.lit(S.LOWEST_TIER)).alias("institution_tier"),
    )


# -- platform signals ---------------------------------------------------------------

_BEHAVIOR_FIELDS = (
    ("profile_completeness", "profile_completeness_score"), ("open_to_work", "open_to_work_flag"),
    ("profile_views_30d", "profile_views_received_30d"),
    ("applications_30d", "applications_submitted_30d"),
    ("response_rate", "recruiter_response_rate"), ("avg_response_time", "avg_response_time_hours"),
    ("connection_count", "connection_count"), ("endorsements_received", "endorsements_received"),
    ("notice_period_days", "notice_period_days"), ("github_activity", "github_activity_score"),
    ("search_appearances_30d", "search_appearance_30d"),
    ("saved_by_recruiters_30d", "saved_by_recruiters_30d"),
    ("interview_completion_rate", "interview_completion_rate"),
    ("offer_acceptance_rate", "offer_acceptance_rate"), ("verified_email", "verified_email"),
    ("verified_phone", "verified_phone"), ("linkedin_connected", "linkedin_connected"),
    ("willing_to_relocate", "willing_to_relocate"), ("preferred_work_mode", "preferred_work_mode"),
)


def behavior_fields(signals: Column) -> Column:
    return F.struct(*[signals[source].alias(name) for name, source in _BEHAVIOR_FIELDS])


# -- the numeric vector ---------------------------------------------------------------

#: The vector's places, in order.
VECTOR_NAMES = ("years", "title_relevance", "skills_ratio", "skill_coverage", "assessment_avg", "career_similarity",
                "semantic", "response_rate", "completeness")


def numeric_vector() -> Column:
    """The nine features of a scored pair as an array of single-precision numbers; reads the columns of ``score_rows``."""
    values = (F.col("years"), F.col("title_relevance"), F.col("skills_ratio"), F.col("skill_coverage"),
              F.col("skill.assessment_score_avg"), F.col("sim.career_similarity"), F.col("semantic_score"),
              F.col("response_rate"), F.col("completeness") / 100.0)
    return F.array(*[v.cast("float") for v in values])
