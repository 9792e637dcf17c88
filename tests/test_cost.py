"""Work that must not be repeated inside lambdas."""

import numpy as np
from pyspark.sql import functions as F

from talentloom.operators import evidence as ev
from talentloom.operators import termindex as ti
from talentloom.operators import vectors as ve


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_length_of_a_vector_is_computed_once(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(2)
    units = df.select("id", ve.unit(F.col("v")).alias("u"))
    assert plan_of(units).count("zip_with(") == 1
    assert {r.id: r.u for r in units.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: None, 3: [None, None], 4: []}
    wide = np.random.default_rng(1).normal(size=300)
    out = spark.createDataFrame([([float(x) for x in wide],)], "v array<double>").select(ve.unit(F.col("v")).alias("u")).first().u
    assert np.allclose(out, wide / np.linalg.norm(wide), rtol=0, atol=1e-12)


ODD = [  # summary, headline, title, career descriptions, skill names, tests, certificates
    ("red ring", "gear", "bolt", ["red", "ring", "", " red ring "], ["ring", "red ring", "ring"], ["ring test", "gear"], ["a bolt"]),
    ("", "", "", [], [], [], []),
    ("gear", "", "", None, None, None, None),
    ("", "x", "x", [None, "bolt"], ["x", None], [None, "red"], [None, "x"]),
    ("", "", "", ["red", "ring"], ["in", ""], [], ["red ring", None]),
    ("", "", "", ["blue ringbolt"] * 2, ["r" * 90 + "gear"], [], []),
]


def test_evidence_searches_no_text_and_finds_every_trace(spark):
    terms = ["bolt", "gear", "red", "red ring", "", "ring", "zinc"]
    names = "struct<name_lc string, endorsements int, duration_months int>"
    rows = []
    for i, (summary, headline, title, jobs, skills, tests, certs) in enumerate(ODD):
        career = None if jobs is None else " ".join(j for j in jobs if j)
        rows.append((i, career, summary, headline, title, certs, jobs, jobs, None if skills is None else [(s, 20, 30) for s in skills],
                     None if tests is None else [(t, 70.0) for t in tests]))
    facts = spark.createDataFrame(rows, "id int, career_lc string, summary_lc string, headline_lc string, title_lc string, certs_lc array<string>, "
                                        f"descriptions_lc array<string>, entries_lc array<string>, skill_facts array<{names}>, "
                                        "assessments array<struct<name_lc string, score double>>")
    found = facts.withColumn("f", ti.lookups(terms, ["red", "ring"]))
    shown = found.withColumn("terms", F.lit(terms)).select("id", ev.term_evidence(F.col("terms"), F.col("f.traces")).alias("e"))
    assert "contains(" not in plan_of(shown).lower()
    have = {r.id: r.e for r in shown.collect()}
    for i, career, summary, headline, title, certs, jobs, _, skills, tests in rows:
        any_of = lambda marks: True if True in marks else None if None in marks else False
        want = []
        for n, term in enumerate(terms):
            in_skills = any(s is not None and term in s for s, _, _ in skills or ())
            tested = [p for p, (t, _) in enumerate(tests or ()) if t is not None and term in t]
            in_career = None if career is None else term in career
            in_certs = None if certs is None else any_of([None if c is None else term in c for c in certs])
            within = None if skills is None else any_of([None if s is None else s in term for s, _, _ in skills])
            in_summary, in_title = term in summary or term in headline, term in title
            if not any((in_skills, within, in_summary, in_career, in_certs, in_title, tested)):
                continue
            sources = None if None in (in_career, in_certs) else in_skills + in_summary + in_career + in_certs + bool(tested)
            want.append((term, n, in_skills, in_summary, in_career, in_certs, in_title, True if in_skills or within else within,
                         [p for p, j in enumerate(jobs or ()) if j is not None and term in j] if in_career else [], tested, sources))
        fields = ("term", "id", "in_skills", "in_summary", "in_career", "in_certifications", "in_title", "matched", "jobs", "tested",
                  "source_count")
        assert [tuple(e[f] for f in fields) for e in have[i]] == want, i
