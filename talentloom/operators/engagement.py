"""Platform behaviour and availability: plain CASE arithmetic, so codegen holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx


def _add(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def engagement(s: Column) -> Column:
    applied = s["applications_submitted_30d"]
    return fx.clip(
        F.lit(0.3)
        + F.when(applied > 0, F.least(F.lit(0.2), applied * 0.03)).otherwise(0.0)
        + _add(s["connection_count"] > 100, 0.1) + _add(s["endorsements_received"] > 10, 0.1)
        + _add(s["github_activity_score"] > 30, 0.15) + _add(s["interview_completion_rate"] > 0.7, 0.15))


def responsiveness(s: Column) -> Column:
    rate, hours = s["recruiter_response_rate"], s["avg_response_time_hours"]
    return fx.clip(F.when(hours < 24, F.least(F.lit(1.0), rate + 0.15))
                   .when(hours > 120, F.greatest(F.lit(0.0), rate - 0.1)).otherwise(rate))


def days_inactive(s: Column, as_of: Column) -> Column:
    """Days since the last activity; NULL for a missing or bad date."""
    return F.datediff(as_of, F.call_function(
        "try_to_date", s["last_active_date"], F.lit("yyyy-M-d")))


def activity(s: Column, as_of: Column) -> Column:
    idle = days_inactive(s, as_of)
    return fx.clip(
        F.lit(0.3) + _add(s["profile_views_received_30d"] > 10, 0.15)
        + _add(s["search_appearance_30d"] > 50, 0.15) + _add(s["applications_submitted_30d"] > 0, 0.1)
        + F.when(idle < 30, 0.2).when(idle < 90, 0.1).otherwise(0.0))


def recruiter_interest(s: Column) -> Column:
    saved = s["saved_by_recruiters_30d"]
    return fx.clip(
        F.lit(0.3) + F.when(saved > 5, 0.3).when(saved > 0, 0.15).otherwise(0.0)
        + _add(s["profile_views_received_30d"] > 20, 0.2) + _add(s["search_appearance_30d"] > 100, 0.2))


def verification(s: Column) -> Column:
    return fx.clip(F.lit(0.3) + _add(s["verified_email"], 0.25) + _add(s["verified_phone"], 0.25)
                   + _add(s["linkedin_connected"], 0.2))


def hiring_readiness(s: Column) -> Column:
    notice = s["notice_period_days"]
    return fx.clip(
        F.lit(0.3) + _add(s["open_to_work_flag"], 0.25)
        + F.when(notice <= 30, 0.2).when(notice <= 60, 0.1).otherwise(0.0)
        + _add(s["offer_acceptance_rate"] > 0.5, 0.15) + _add(s["interview_completion_rate"] > 0.8, 0.1))


def behavior_parts(signals: Column, as_of: Column) -> dict[str, Column]:
    return {
        "engagement": engagement(signals), "responsiveness": responsiveness(signals),
        "activity": activity(signals, as_of), "recruiter_interest": recruiter_interest(signals),
        "verification": verification(signals), "hiring_readiness": hiring_readiness(signals),
        "profile_quality": signals["profile_completeness_score"] / 100.0,
    }


def behavioral(parts: list[Column]) -> Column:
    return fx.weighted_average(parts, S.BEHAVIOR_WEIGHTS)


def availability(s: Column) -> Column:
    notice = s["notice_period_days"]
    return fx.clip(
        F.lit(0.4) + _add(s["open_to_work_flag"], 0.25)
        + F.when(notice <= 15, 0.25).when(notice <= 30, 0.2).when(notice <= 60, 0.1)
        .when(notice <= 90, 0.0).otherwise(-0.1))


def hiring_compatibility(years: Column, title_level: Column, experience: Column) -> Column:
    """Stated years against the asked range, and title level against the asked seniority."""
    low, high, wanted = experience["min_years"], experience["max_years"], experience["seniority_level"]
    fits = ((wanted == "senior") & (title_level >= 3)) | ((wanted == "mid") & (title_level >= 2))
    return fx.clip(
        F.lit(0.5)
        + F.when((years >= low) & (years <= high), 0.3).when(years >= low * 0.8, 0.15).otherwise(0.0)
        + _add(fits, 0.2))


def work_mode_compatibility(role_mode: Column, candidate_mode: Column, relocates: Column) -> Column:
    role, mine = F.lower(role_mode), F.lower(candidate_mode)
    match = (F.when((role == "flexible") | (mine == "flexible"), 0.25).when(role == mine, 0.3)
             .when((role == "remote") & (mine == "hybrid"), 0.2)
             .when((role == "hybrid") & (mine == "remote"), 0.15).otherwise(0.0))
    return fx.clip(F.lit(0.5) + match + _add((role == "onsite") & relocates, 0.15))


def recruitability(parts: list[Column]) -> Column:
    """Availability, hiring fit, behaviour and work mode, weighted."""
    return fx.weighted_average(parts, S.RECRUITABILITY_WEIGHTS)
