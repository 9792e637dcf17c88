"""A record is parsed and its sections are found once, whatever reads them; odd leaves and sections keep their meaning."""

import json

from talentloom.functions import scalars as fx
from talentloom.plans import pairs as pp
from talentloom.sources import candidates as cs


def test_sections_are_found_once(spark):
    lines = spark.createDataFrame([('{"candidate_id": "a"}',)], "value string")
    facts = pp.candidate_facts(fx.step(cs.accepted(cs.parse_candidates(lines))), "2024-01-31")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    for section in ("career_history", "skills", "education"):
        assert plan.count(f"$.{section},") == 1, section


def test_odd_leaves_and_sections(spark):
    job = {"company": True, "title": 7, "duration_months": "12", "is_current": "true", "description": None, "end_date": False}
    records = [
        {"candidate_id": "a", "profile": {"headline": {"x": 1}, "years_of_experience": "4.5"}, "career_history": [job, {}]},
        {"candidate_id": "b", "skills": "none", "platform_signals": {"notice_period_days": 12.7, "expected_salary_range_inr_lpa": {"min": "5"}}},
        {"candidate_id": "c", "skills": [None]}, {"candidate_id": "d", "profile": None}, {"candidate_id": "e", "profile": []},
        {"candidate_id": "f", "platform_signals": 1}, {"candidate_id": "g", "platform_signals": {"expected_salary_range_inr_lpa": 3}},
        {"candidate_id": ""}, {"candidate_id": 5}, [], None,
    ]
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    rows = {r["_raw"]: r for r in cs.parse_candidates(lines).collect()}
    got = [rows[json.dumps(r)] for r in records]
    assert [r["_reject"] for r in got] == [None, None, *["invalid"] * 6, None, *["invalid"] * 2]
    first, second = got[0], got[1]
    assert [(e.company, e.title, e.duration_months, e.is_current, e.description, e.end_date) for e in first["career_history"]] == [
        ("True", "7", 12, False, "", "False"), ("", "", 0, False, "", None)]
    assert (first["profile"].headline, first["profile"].years_of_experience, first["profile"].country) == ('{"x":1}', 4.5, "")
    assert second["skills"] == [] and second["platform_signals"].notice_period_days == 12
    assert second["platform_signals"].expected_salary_range.min_lpa == 5.0 and got[8]["candidate_id"] == "5"
