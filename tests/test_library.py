"""Hand-made rows for the quirks, and properties of the ranking."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.functions import scalars as fx
from talentloom.operators import features as fe
from talentloom.operators import jobs as jo
from talentloom.operators import ranking as rk
from talentloom.operators import statistics as st
from talentloom.operators import vectors as ve
from talentloom.plans import pairs as pp
from talentloom.plans import pipeline, storage
from talentloom.sources import candidates as cs
from talentloom.sources import jobs as js
from talentloom.streaming import state as ss
from talentloom.streaming import topk as sk

JOB = """SENIOR SEARCH ENGINEER
We work remote on search. 3-6 years.
REQUIRED SKILLS
Python, Spark and retrieval. You must have production experience.
NICE TO HAVE
Kafka as a bonus. Do not apply twice."""


def person(i, **over):
    base = {
        "candidate_id": f"C{i}",
        "profile": {"anonymized_name": f"N{i}", "headline": "Senior Data Engineer",
                    "summary": "Python and Spark for retrieval at scale, with care and tests.",
                    "years_of_experience": 2.5 + i, "current_title": "Senior Data Engineer",
                    "current_industry": "Data Engineering"},
        "career_history": [
            {"title": "Senior Data Engineer", "company": "A", "duration_months": 30, "is_current": True,
             "industry": "Software", "company_size": "51-200", "description": "Spark pipelines"},
            {"title": "Data Engineer", "company": "B", "duration_months": 20, "industry": "Retail Software",
             "company_size": "11-50", "description": "Python"}],
        "skills": [{"name": "Python", "proficiency": "expert", "endorsements": 12, "duration_months": 36},
                   {"name": "Spark SQL", "proficiency": "advanced"}],
        "platform_signals": {"skill_assessment_scores": {"Python basics": 80}, "last_active_date": "2024-1-5"},
    }
    base.update(over)
    return base


def people(spark, records):
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return cs.accepted(cs.parse_candidates(lines))


def profiles(spark, text=JOB):
    return jo.hiring_profiles(js.jobs_from_text(spark.createDataFrame([("j", text)], "jd_id string, text string")))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_ingest_rejects_and_coercion(spark):
    lines = ['{"candidate_id":"a","profile":{"years_of_experience":"12.5"},'
             '"skills":[{"name":"x","endorsements":12.7,"duration_months":"12.5"}],'
             '"platform_signals":{"open_to_work_flag":"true","skill_assessment_scores":{"z":80,"a":"bad","m":null}}}',
             "", "{bad", '{"candidate_id":"t"} x', '{"candidate_id":"t"}{}', '{"candidate_id":"t"},1', '{"candidate_id":"t"}]', "[1]", '{"candidate_id":""}', '{"candidate_id":"b","profile":null}',
             '{"candidate_id":"c"}', '{"candidate_id":"d","skills":["x"]}']
    parsed = cs.parse_candidates(spark.createDataFrame([(x,) for x in lines], "value string"))
    reasons = {r["_reject"]: r["count"] for r in cs.rejected(parsed).groupBy("_reject").count().collect()}
    assert reasons == {"malformed": 5, "invalid": 4}
    rows = {r["candidate_id"]: r for r in cs.accepted(parsed).collect()}
    assert set(rows) == {"a", "c"}
    a = rows["a"]
    assert a.profile.years_of_experience == 12.5
    assert (a.skills[0].endorsements, a.skills[0].duration_months) == (12, 0)
    assert a.platform_signals.open_to_work_flag is False
    assert a.platform_signals.skill_assessment_scores == {"z": 80.0}
    assert rows["c"].platform_signals.preferred_work_mode == "flexible"


def test_json_array_source(spark, tmp_path):
    path = tmp_path / "all.json"
    path.write_text(json.dumps([person(1), person(2), {"candidate_id": ""}], indent=1))
    assert cs.read_candidates(spark, str(path)).count() == 2


def test_titles_degrees_and_numbers(spark):
    for title, level in (("Director", 8), ("Intern", 2), ("", 2), ("Staff Engineer", 5)):
        assert one(spark, fx.seniority(F.lit(title))) == level
    for degree, level in (("MBA", 1), ("Diploma", 2), ("Master of Science", 2), ("Ph.D", 3)):
        assert one(spark, fe._degree_level(F.lit(degree))) == level
    assert one(spark, fx.fixed(F.lit(2.5), 0)) == "2"
    assert one(spark, fx.percent(F.lit(0.125))) == "12%"
    assert one(spark, fx.fixed(F.lit(0.5135), 3)) == f"{0.5135:.3f}"


def test_job_profile(spark):
    p = profiles(spark).first()
    assert {c.name for c in p.required} >= {"python", "spark", "retrieval"}
    assert [c.name for c in p.preferred] == ["kafka"]
    assert (p.experience.min_years, p.experience.max_years, p.experience.seniority_level) == (3.0, 6.0, "senior")
    assert (p.role.title, p.role.work_mode) == ("SENIOR SEARCH ENGINEER", "remote")
    assert any(d.startswith("kafka as a bonus. do not") or "do not apply" in d for d in p.disqualifiers)
    assert abs(sum(x.priority for x in p.priorities) - 1) < 1e-9


def test_mentions_keep_digits(spark):
    found = jo.competency_mentions(F.lit("x 100 200 300 400"), (r"\d00",))
    assert one(spark, found) == ["100", "200", "300", "400"]


def test_repeated_heading_keeps_last_run(spark):
    text = "intro\nALPHA\none\nBETA\ntwo\nALPHA\nthree"
    rows = js.jobs_from_text(spark.createDataFrame([("j", text)], "jd_id string, text string")).first().sections
    assert [(s.name, s.text) for s in rows] == [("Introduction", "intro"), ("ALPHA", "three"), ("BETA", "two")]


def test_docx_round_trip(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = ("<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Required</w:t></w:r></w:p>"
            "<w:p><w:r><w:t>Python and Spark</w:t></w:r></w:p>"
            '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Nice</w:t></w:r></w:p>'
            "<w:p><w:r><w:t>- Kafka</w:t></w:r></w:p>")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    assert js.jobs_from_docx(spark, str(tmp_path)).count() == 1
    rejects = js.docx_rejects(spark, str(tmp_path)).collect()
    assert [r["jd_id"].endswith("broken.docx") for r in rejects] == [True]
    row = js.jobs_from_docx(spark, str(tmp_path)).first()
    assert [(s.name, s.text) for s in row.sections] == [("Required", "Python and Spark"), ("Nice", "- Kafka")]
    assert row.paragraphs[3].is_bullet


def test_empty_sections_score(spark):
    scored = pp.score_pairs(people(spark, [{"candidate_id": "e"}]), profiles(spark), "2024-01-31").first()
    assert scored.skill_coverage == 0 and abs(scored.career_narrative - 0.3) < 1e-12
    assert scored.direction == "" and scored.evidence_coverage == 0


def test_empty_skill_name_matches_every_term(spark):
    row = pp.score_pairs(people(spark, [person(1, skills=[{"name": ""}])]), profiles(spark), "2024-01-31").first()
    assert row.matched_count == row.n_competencies


def test_ranking_ignores_copies_order_and_partitions(spark):
    base = [person(i, profile={**person(i)["profile"], "years_of_experience": float(i)}) for i in range(12)]
    worse = person(3, skills=[])
    p = profiles(spark)

    def ranks(records, parts, copies):
        c = people(spark, records).repartition(parts)
        scored = pp.score_pairs(c, p, "2024-01-31")
        rows = rk.rank_candidates(scored, 5, copies).orderBy("rank").collect()
        return [(r["candidate_id"], round(r["score"], 9)) for r in rows]

    want = ranks(base, 1, 1)
    assert ranks(base[::-1] + base + [worse], 3, 3) == want
    assert ranks(base + [worse], 2, None) == want
    assert len({c for c, _ in want}) == 5


def test_many_bundles_equal_one(spark):
    texts = spark.createDataFrame(
        [(f"j{i}", JOB.replace("Kafka", k)) for i, k in enumerate(["Kafka", "Docker", "Rust", "SQL"])],
        "jd_id string, text string")
    p = jo.hiring_profiles(js.jobs_from_text(texts))
    c = people(spark, [person(1), person(2, skills=[])])
    key = lambda r: (r["jd_id"], r["candidate_id"], round(r["score"], 12))
    whole = sorted(map(key, pp.score_pairs(c, p, "2024-01-31").collect()))
    cut = sorted(map(key, pp.score_pairs(c, p, "2024-01-31", max_bytes=600).collect()))
    assert whole == cut and len(whole) == 8


def test_encoder_path(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("a") + 1.0, 1.0] for t in texts])
    c = pipeline.with_vectors(people(spark, [person(1)]), make)
    p = pipeline.with_job_vectors(profiles(spark), make)
    row = pp.score_pairs(c, p, "2024-01-31").first()
    assert 0.9 < row.semantic_score <= 1.0
    assert len(ve.encode(ve.job_sentences(p), ["jd_id"], "texts", make).first().vectors) > 3


def test_encoder_keeps_copies_apart(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    records = [person(1), person(1, profile={**person(1)["profile"], "summary": "x"}), person(1, profile={})]
    rows = pipeline.with_vectors(people(spark, records), make).collect()
    assert len(rows) == 3
    want = {r.profile.summary: len(r.profile.summary) for r in rows}
    for r in rows:
        first = r.vectors[0]
        assert (first is None) == (r.profile.summary == "")
        if first is not None:
            assert abs(first[0] - want[r.profile.summary] / np.hypot(want[r.profile.summary], 1)) < 1e-12


def test_ingest_odd_values_and_broken_arrays(spark, tmp_path):
    lines = ['{"candidate_id":"a","candidate_id":"b","skills":[{"endorsements":3000000000}],"profile":{"years_of_experience":NaN}}',
             '{"candidate_id":"c","profile":{"years_of_experience":-Infinity,"headline":": NaN,"}}', "{bad"]
    parsed = cs.parse_candidates(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {r["candidate_id"]: r for r in cs.accepted(parsed).collect()}
    assert set(rows) == {"b", "c"} and rows["b"].skills[0].endorsements == 3_000_000_000
    assert np.isnan(rows["b"].profile.years_of_experience) and rows["c"].profile.headline == ": NaN,"
    (tmp_path / "a.json").write_text('[{"candidate_id":"q"},{"candidate_id":"w"}')
    (tmp_path / "b.json").write_text('{"candidate_id":"q"}')
    (tmp_path / "c.json").write_text('[{"candidate_id":"q"},3]')
    found = cs.parse_candidates(cs.scan_candidates(spark, f"{tmp_path}/*.json", "json")).collect()
    assert sorted(r["_reject"] or "ok" for r in found) == ["invalid", "malformed", "malformed", "ok"]
    with pytest.raises(ValueError):
        cs.scan_candidates(spark, "people.txt")


def test_quantiles_with_infinities_and_groups(spark):
    for values in ([1.0, 2.0, float("inf")], [3.0] * 5, [1.0, 2.0, 3.0, 10.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert st.exact_quantiles(df, "x", [0.5]) == [float(np.median(values))]
    data = [("a", float(i)) for i in range(101)] + [("b", 7.0)]
    got = st.quantiles_by_group(spark.createDataFrame(data, "g string, x double"), ["g"], "x", [0.5]).collect()
    assert {(r["g"], r["value"]) for r in got} == {("a", 50.0), ("b", 7.0)}


def test_run_counts_rejects(spark, tmp_path):
    lines = [json.dumps(person(1)), json.dumps(person(2)), "{bad", '{"candidate_id":""}']
    parsed = cs.parse_candidates(spark.createDataFrame([(x,) for x in lines], "value string"))
    jobs = js.jobs_from_text(spark.createDataFrame([("j", JOB)], "jd_id string, text string"))
    metrics = pipeline.run(spark, jobs, parsed, str(tmp_path / "out"), "2024-01-31", 3, shared=str(tmp_path)).metrics.first()
    assert (metrics.total_candidates, metrics.errors, metrics.candidates_ranked) == (2, 2, 2)


def test_hot_id_needs_no_other_plan(spark):
    rows = [("j", "hot", float(i), i) for i in range(500)] + [("j", f"c{i}", float(i), i) for i in range(20)]
    df = spark.createDataFrame(rows, "jd_id string, candidate_id string, score double, row_hash long").repartition(5)
    for copies in (None, 500):
        got = rk.rank_candidates(df, 3, copies, buckets=4).orderBy("rank").collect()
        assert [(r["candidate_id"], r["score"]) for r in got] == [("hot", 499.0), ("c19", 19.0), ("c18", 18.0)]
    plan = rk.rank_candidates(df, 3, None)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "SinglePartition" not in plan


def test_store_keeps_two_versions(spark, tmp_path):
    store = sk.Versions(spark, str(tmp_path / "s"))
    for i in range(4):
        store.write(spark.range(i + 1), i)
    assert store._finished() == [2, 3] and store.latest().count() == 4


def test_shared_folder(spark, tmp_path):
    assert storage.shared_folder(spark, "x", str(tmp_path)).startswith(f"{tmp_path}/x-")


def test_run_writes_all_outputs(spark, tmp_path):
    jobs = js.jobs_from_text(spark.createDataFrame([("j", JOB)], "jd_id string, text string"))
    result = pipeline.run(spark, jobs, people(spark, [person(i) for i in range(4)]), str(tmp_path), "2024-01-31", 3)
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/submission")
    assert csv.count() == 3 and set(csv.columns) == {"candidate_id", "rank", "score", "reasoning", "jd_id"}
    assert spark.read.json(f"{tmp_path}/explanations").count() == 3
    assert spark.read.json(f"{tmp_path}/ranking_metadata").count() == 3
    assert result.metrics.first().total_candidates == 4


def test_stream_equals_batch(spark, tmp_path):
    records = [person(i) for i in range(9)] + [person(4, skills=[])]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(json.dumps(r) for r in records[i::3]))
    p = profiles(spark)
    ss.use_rocksdb(spark)
    sk.stream_ranking(cs.stream_candidates(spark, f"{tmp_path}/in"), p, "2024-01-31", 4, f"{tmp_path}/cp").awaitTermination()
    got = [(r["candidate_id"], r["rank"]) for r in sk.ranking_now(spark, f"{tmp_path}/cp", 4).orderBy("rank").collect()]
    batch = rk.rank_candidates(pp.score_pairs(people(spark, records), p, "2024-01-31"), 4)
    assert got == [(r["candidate_id"], r["rank"]) for r in batch.orderBy("rank").collect()]


def test_plan_prunes_before_the_shuffle(spark):
    scored = pp.score_pairs(people(spark, [person(1)]), profiles(spark), "2024-01-31")
    plan = rk.rank_candidates(scored, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
