"""One DuckDB query per registered query."""

from __future__ import annotations

import re

from oracle import base as B
from oracle.base import q
from talentloom import settings as S
from talentloom.plans.catalog import DIGITS, FUNNEL, K, TIE_SHIFT
from talentloom.operators.reports import SHORT_LABELS

_DECIMAL = re.compile(r"(?<![\w.\]])(\d+\.\d+)(?![\w.:])")
DIMS = [key for key, _, _ in S.DIMENSIONS]
LABELS = [label for _, label, _ in S.DIMENSIONS]


def doubles(sql: str) -> str:
    """Make decimal literals outside quotes DOUBLE, as Spark reads Python floats."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if i % 2 else _DECIMAL.sub(r"\1::DOUBLE", p) for i, p in enumerate(parts))


def r8(*names: str) -> str:
    out = []
    for n in names:
        expr, _, alias = n.partition(" AS ")
        out.append(f"round(CAST({expr} AS DOUBLE) + {TIE_SHIFT}, {DIGITS}) AS {alias or expr}")
    return ", ".join(out)


def ints(*names: str) -> str:
    out = []
    for n in names:
        expr, _, alias = n.partition(" AS ")
        out.append(f"CAST({expr} AS BIGINT) AS {alias or expr}")
    return ", ".join(out)


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


def pct(x: str) -> str:
    return f"printf('%.0f%%', ({x}) * 100)"


RANKED = f"""ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, candidate_id) AS rank
  FROM scored) WHERE rank <= {K})"""
_STRENGTHS = f"""list_filter([CASE WHEN technical_alignment > 0.5 THEN 'Strong technical alignment (' || {pct('skill_coverage')} || ' skill coverage)' END,
    CASE WHEN evidence_strength > 0.5 THEN 'Well-supported claims with multi-source evidence' END,
    CASE WHEN career_narrative > 0.5 THEN 'Strong career narrative (' || direction || ' trajectory)' END,
    CASE WHEN semantic_relevance > 0.4 THEN 'Good semantic alignment with role (' || {pct('semantic')} || ')' END,
    CASE WHEN authenticity > 0.6 THEN 'High profile authenticity and consistency' END,
    CASE WHEN behavioral > 0.5 THEN 'Strong platform engagement and hiring readiness' END,
    CASE WHEN recruitability > 0.5 THEN 'High recruitability and availability' END], lambda x: x IS NOT NULL)"""
_GAPS = """list_filter([CASE WHEN technical_alignment < 0.3 THEN 'Limited skill coverage for required competencies' END,
    CASE WHEN evidence_strength < 0.3 THEN 'Weak evidence supporting technical claims' END,
    CASE WHEN authenticity < 0.4 THEN 'Profile consistency could be improved' END,
    CASE WHEN behavioral < 0.3 THEN 'Low platform engagement signals' END], lambda x: x IS NOT NULL)"""
_N = len(DIMS)
_MEAN = f"(({' + '.join(DIMS)}) / {_N})"
_STD = f"sqrt(({' + '.join(f'power({d} - {_MEAN}, 2)' for d in DIMS)}) / {_N})"
_LIVE = " + ".join(f"({d} > 0.1)::INT" for d in DIMS)
DIM_ROWS = "dim AS (" + " UNION ALL ".join(
    f"SELECT jd_id, candidate_id, {i} AS o, {q(label)} AS label, {q(short)} AS short, {key} AS value FROM ranked"
    for i, ((key, label, _), short) in enumerate(zip(S.DIMENSIONS, SHORT_LABELS))) + ")"
EXPLAINED = f"""dim_text AS (SELECT jd_id, candidate_id,
    string_agg(label || ': ' || {fixed('value', 3)}, '; ' ORDER BY value DESC, o) AS trace,
    array_to_string(list(label ORDER BY value DESC, o) FILTER (value > 0.5)[1:4], ',') AS dominant
  FROM dim GROUP BY jd_id, candidate_id),
explained AS (SELECT r.*, trace, coalesce(dominant, '') AS dominant, strengths, gaps,
    array_to_string(list_filter([nullif(array_to_string(strengths[1:3], '. '), ''), {fixed('years', 0)} || ' years experience as ' || title,
      'Areas for improvement: ' || gaps[1]], lambda x: x IS NOT NULL), '. ') AS reasoning
  FROM (SELECT *, {_STRENGTHS} AS strengths, {_GAPS} AS gaps,
      CAST({fixed(B.clip(f'(1 - {_STD}) * 0.5 + ({_LIVE}) / {_N}.0 * 0.3 + score * 0.2'), 4)} AS DOUBLE) AS confidence FROM ranked) r
  JOIN dim_text USING (jd_id, candidate_id))"""
SCORE6 = f"CAST({fixed('score', 6)} AS DOUBLE) AS score"


def ranked(*more: str) -> str:
    return B.pairs(RANKED, *more)


def explained() -> str:
    return ranked(DIM_ROWS, EXPLAINED)


def _pair(select: str) -> str:
    return f"{B.pairs()} SELECT jd_id, candidate_id, {select} FROM scored"


def _candidate(select: str, source: str) -> str:
    return f"{B.features()} SELECT candidate_id, {select} FROM people JOIN {source} USING (d)"


def _jobs(select: str, *ctes: str) -> str:
    return f"{B.jobs('documents', 'doc_id', *ctes)} {select}"


def _funnel() -> str:
    ctes, source = [], "scored"
    stages = ("cheap_score", "semantic_relevance", "evidence_strength", "behavioral + recruitability", "score")
    for i, (stage, cut) in enumerate(zip(stages, FUNNEL)):
        ctes.append(f"""cut{i} AS (SELECT * EXCLUDE (rn), rn AS rank{i} FROM (SELECT *, row_number() OVER (
            PARTITION BY jd_id ORDER BY {stage} DESC, candidate_id) AS rn FROM {source}) WHERE rn <= {cut})""")
        source = f"cut{i}"
    return f"{B.pairs(*ctes)} SELECT jd_id, candidate_id, {ints('rank4 AS rank')}, {r8('cheap_score', 'score')} FROM cut4"


def _default_mentions() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, unnest(regexp_extract_all(lower(text), {q('(?i)' + p)})) AS m FROM documents"
        for p in S.COMPETENCY_PATTERNS)
    return f"SELECT DISTINCT doc_id, trim(m) AS skill FROM ({found}) WHERE length(trim(m)) > 1"


def _disqualifiers() -> str:
    parts = []
    for p in S.DISQUALIFIER_PATTERNS:
        parts.append(f"""SELECT jd_id, t, list_sum([length(x) for x in g[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS s, length(m[k]) AS n
          FROM (SELECT jd_id, t, regexp_extract_all(t, {q(p)}) AS m, regexp_split_to_array(t, {q(p)}) AS g FROM raw),
          unnest(range(1, len(m) + 1)) AS u(k)""")
    return _jobs(f"""SELECT jd_id, context, count(*) AS n FROM (
        SELECT jd_id, trim(substr(t, CAST(greatest(s - 20, 0) + 1 AS BIGINT), CAST(s + n + 100 - greatest(s - 20, 0) AS BIGINT)), ' ' || chr(10)) AS context
        FROM ({' UNION ALL '.join(parts)})) GROUP BY jd_id, context""")


def _ingest() -> str:
    return """WITH e AS (SELECT event_id AS i, event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events),
    o AS (SELECT *, CASE WHEN i % 11 = 3 THEN 'malformed' WHEN i % 13 = 4 THEN 'blank' WHEN i % 17 = 5 OR i % 19 = 6 OR i % 23 = 7
      THEN 'invalid' ELSE 'ok' END AS outcome FROM e)"""


def _normalize(shift: str, scale: str) -> str:
    return f"""WITH s AS (SELECT {shift} AS a, {scale} AS b FROM orders) SELECT o_orderkey, {r8('o_totalprice')},
      {r8('CASE WHEN b = 0 THEN 0 ELSE (o_totalprice - a) / b END AS normalized')} FROM orders, s"""


def _z(columns: list[str]) -> str:
    cte = ", ".join(f"avg({c}) AS m_{c}, coalesce(stddev_samp({c}), 0) AS s_{c}" for c in columns)
    out = r8(*[f"CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END AS {c}_z_score" for c in columns])
    return f"""{B.people(B.FEATURES, f'''facts AS (SELECT candidate_id, years AS experience, total_skills AS skills,
      avg_endorsements AS endorsements, response_rate, completeness FROM people JOIN skill_f USING (d)),
      st AS (SELECT {cte} FROM facts)''')} SELECT candidate_id, {out} FROM facts, st"""


def _sentences() -> str:
    return r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, s AS sentence FROM (
      SELECT doc_id, k, trim(p[k], ' ' || chr(10)) AS s FROM (
        SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
        unnest(range(1, len(p) + 1)) AS u(k)) WHERE s <> ''"""


def _a_count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, 'a', '')) + 1.0)"


def _encoded() -> str:
    """Cosines of (length, count of a + 1, 1) of four passages and the job text; an empty passage has no vector."""
    def vector(text: str) -> str:
        return f"[length({text})::DOUBLE, {_a_count(text)}::DOUBLE, 1.0::DOUBLE]"

    names = ("summary", "career", "skills", "headline")
    sims = ", ".join(f"CASE WHEN {n} = '' THEN 0 ELSE coalesce(list_cosine_similarity({vector(n)}, jv), 0) END AS {n}" for n in names)
    mean = (f"({' + '.join(f'greatest({n}, 0)' for n in names)}) / greatest(1, {' + '.join(f'({n} > 0)::INT' for n in names)})")
    return f"""{B.people(B.jobs_cte('benchmark', 'item_id'),
        "ct AS (SELECT d, string_agg(title || ' at ' || company || ': ' || description, ' ' ORDER BY pos) FILTER (description <> '') AS txt FROM career GROUP BY d)",
        "sn AS (SELECT d, string_agg(name, ', ' ORDER BY pos) FILTER (pos <= 30) AS names FROM (SELECT d, name, row_number() OVER (PARTITION BY d ORDER BY pos) AS pos FROM skills) GROUP BY d)",
        "one AS (SELECT p.d, candidate_id, name, substr(summary, 1, 500) AS summary, substr(coalesce(txt, ''), 1, 500) AS career, coalesce(names, '') AS skills, headline FROM people p LEFT JOIN ct USING (d) LEFT JOIN sn USING (d))",
        "two AS (SELECT * FROM one UNION ALL SELECT d, candidate_id, 'copy', 'a second record', career, skills, headline FROM one WHERE d % 1000 % 3 = 0)",
        f"jv AS (SELECT jd_id, {vector('substr(raw_text, 1, 1000)')} AS jv FROM raw)",
        f"sim AS (SELECT jd_id, candidate_id, name, {sims} FROM two CROSS JOIN jv)")}
      SELECT jd_id, candidate_id, name, {r8(*names, mean + ' AS semantic_score')} FROM sim"""


def _text_functions() -> str:
    norm = rf"trim(regexp_replace({B.nfkd('text')}, '\s+', ' ', 'g'))"
    short = """CASE WHEN length(text) <= 120 THEN text WHEN sp > 96 THEN substr(text, 1, sp) || '...'
      ELSE substr(text, 1, 120) || '...' END"""
    return rf"""SELECT doc_id, {norm} AS normalized, md5(trim(regexp_replace({norm}, '\p{{C}}', '', 'g'))) AS clean_md5,
      (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n_the,
      (length(text) - length(replace(text, 'The', ''))) // 3 AS n_the_exact,
      contains(lower(text), 'thor') OR contains(lower(text), 'blees') AS has_any, {short} AS short,
      {r8("least(1.0, 0.15 * (contains(lower(text), 'thor')::INT + contains(lower(text), 'blees')::INT + contains(lower(text), 'zzz')::INT)) AS relevance",
          'squashed', 'divided')}
      FROM (SELECT *, 1 / (1 + exp(-(length(text) / 1000.0 - 1))) AS squashed,
        CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text)::DOUBLE / (doc_id % 3) END AS divided,
        CASE WHEN contains(substr(text, 1, 120), ' ') THEN 120 - strpos(reverse(substr(text, 1, 120)), ' ') ELSE -1 END AS sp FROM documents)"""


def oracle() -> dict[str, str]:
    texts = {
        "rank_topk": f"""{explained()} SELECT jd_id, candidate_id, rank, {SCORE6}, reasoning,
            'Ranking confidence: ' || {pct('confidence')} AS confidence FROM explained""",
        "fused_dims": _pair(r8(*DIMS, "cheap_score", "score")),
        "skill_match": _pair(ints("matched AS matched_count", "relevant_months") + ", " + r8(
            "skills_ratio", "skill_coverage", "title_relevance", "industry_relevance", "relevant_assessment")),
        "evidence_rollup": _pair(r8("evidence_score", "evidence_coverage", "evidence_density") + ", "
                                 + ints("strong_count", "weak_count") + ", unsupported"),
        "evidence_detail": f"""{ranked()} SELECT jd_id, r.candidate_id,
            term, in_skills, in_summary, in_career, in_cert AS in_certifications,
            {r8('e.score AS assessment_score', 'confidence')}, {ints('e.months AS skill_months', 'endorsements', 'mentions AS career_mentions', 'sources AS source_count')}
            FROM ranked r JOIN competency c USING (jd_id) JOIN evidence e ON e.term = c.name AND e.d = r.d""",
        "narrative": _pair(r8("progression", "specialization", "growth", "domain", "career_narrative") + ", direction"),
        "recruitability": _pair(r8("availability", "hiring AS hiring_compatibility", "mode_fit AS mode_compatibility",
                                   "recruitability")),
        "semantic_scores": _pair(r8(*[f"{n}_sim AS {n}_similarity" for n in ("summary", "career", "skills", "headline")],
                                    "semantic AS semantic_score")),
        "ranking_metadata": f"""{explained()} SELECT jd_id, candidate_id, rank, {SCORE6}, name, title,
            {r8('years AS experience_years', 'confidence')}, dominant AS strengths FROM explained""",
        "explanations": f"""{explained()} SELECT jd_id, candidate_id, rank, {SCORE6}, array_to_string(strengths, '; ') AS strengths,
            array_to_string(gaps, '; ') AS improvement_areas, trace AS decision_trace, reasoning,
            'Ranking confidence: ' || {pct('confidence')} AS confidence FROM explained""",
        "reasoning_lookup": f"""{explained()} SELECT jd_id, candidate_id, rank, CASE WHEN rank <= 5 THEN reasoning ELSE '' END AS reasoning
            FROM explained""",
        "top_report": f"""{ranked()} SELECT jd_id, rank, CAST({fixed('score', 4)} AS DOUBLE) AS score, substr(name, 1, 24) AS name,
            substr(title, 1, 34) AS title, CAST({fixed('years', 1)} AS DOUBLE) AS years FROM ranked WHERE rank <= 3""",
        "cheap_funnel": _funnel(),
        "feature_vector": f"""{B.pairs()} SELECT jd_id, candidate_id, {r8(*[f'({a})::FLOAT AS {b}' for a, b in (
            ('p.years', 'years'), ('title_relevance', 'title_relevance'), ('skills_ratio', 'skills_ratio'),
            ('skill_coverage', 'skill_coverage'), ('assessment_avg', 'assessment_avg'), ('semantic', 'semantic'),
            ('response_rate', 'response_rate'), ('p.completeness / 100.0', 'completeness'), ('career_sim', 'career_similarity'))])} FROM scored s JOIN people p USING (d, candidate_id)""",
        "dedup_best": f"""SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, {r8('max(value) AS value')}
            FROM events GROUP BY user_id""",
        "topk_per_group": f"""SELECT p_brand, p_partkey, {r8('p_retailprice')}, rank FROM (SELECT *, row_number() OVER (
            PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 5""",
        "topk_global": f"""SELECT o_orderkey, {r8('o_totalprice')}, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
            FROM orders QUALIFY rank <= 100""",
        "skill_stats": _candidate(ints("total_skills", "coalesce(certs, 0) AS certification_count") + ", " + r8(
            "avg_proficiency", "avg_endorsements", "avg_skill_duration", "strong_ratio AS advanced_expert_ratio",
            "coalesce(assessment_avg, 0) AS assessment_score_avg"),
            "skill_f USING (d) LEFT JOIN test_f USING (d) LEFT JOIN cert_f"),
        "career_features": _candidate(ints("n_jobs AS total_companies", "total_months AS total_career_months",
                                           "current_months AS current_tenure_months") + ", "
                                      + r8("avg_tenure AS avg_tenure_months")
                                      + ", startup AS startup_experience, large AS large_company_experience", "career_f"),
        "education_features": _candidate(ints("n_edu AS education_count", "degree_level AS highest_degree_level",
                                              "tier AS institution_tier"), "edu_f"),
        "behavior_fields": f"""{B.people()} SELECT candidate_id, {r8('completeness AS profile_completeness', 'response_rate',
            'response_hours AS avg_response_time', 'github AS github_activity', 'interview_rate AS interview_completion_rate',
            'offer_rate AS offer_acceptance_rate')}, {ints('views AS profile_views_30d', 'applications AS applications_30d',
            'connections AS connection_count', 'endorsed AS endorsements_received', 'notice AS notice_period_days',
            'searches AS search_appearances_30d', 'saved AS saved_by_recruiters_30d')}, open_to_work, email AS verified_email,
            phone AS verified_phone, linked AS linkedin_connected, relocates AS willing_to_relocate,
            work_mode AS preferred_work_mode FROM people""",
        "seniority_and_size": f"""{B.people()} SELECT candidate_id, pos, lvl AS level, sz AS size_level
            FROM career JOIN people USING (d)""",
        "career_transitions": f"""{B.features()} SELECT candidate_id, pos, from_title, to_title, from_industry, to_industry,
            up AS is_advancement, flat AS is_lateral, from_industry = to_industry AND (up OR flat) AS is_specialization,
            CASE WHEN from_industry = to_industry THEN 0.8 ELSE 0.5 END AS transition_quality FROM moves JOIN people USING (d)""",
        "career_trajectory": _candidate(r8("progression", "growth") + """, CASE WHEN n_jobs = 0 THEN '' WHEN progression > 0.7
            THEN 'ascending' WHEN progression > 0.5 THEN 'lateral' WHEN progression > 0.3 THEN 'mixed' ELSE 'declining' END AS direction""",
            "auth_f USING (d) JOIN career_f"),
        "authenticity_parts": _candidate(r8("semantic_coherence", "career_coherence", "timeline AS timeline_consistency",
                                            "edu_align AS education_alignment", "support AS profile_support"), "auth_f"),
        "timeline_check": _candidate(r8("timeline AS timeline_consistency") + f""", CASE WHEN mismatch THEN 'Experience mismatch: stated '
            || {fixed('years', 1)} || 'y vs computed ' || {fixed('total_months / 12.0', 1)} || 'y' ELSE '' END AS message""",
            "auth_f USING (d) JOIN career_f"),
        "overlapping_jobs": f"""{B.people()} SELECT candidate_id, count(b.pos) AS overlaps FROM people p LEFT JOIN career a ON a.d = p.d
            AND NOT a.is_current LEFT JOIN career b ON b.d = a.d AND b.pos > a.pos AND a.start_date < b.end_date GROUP BY candidate_id""",
        "behavioral": _candidate(r8("engagement", "responsiveness", "activity", "interest AS recruiter_interest", "verification",
                                    "readiness AS hiring_readiness", "quality AS profile_quality",
                                    "behavioral AS behavioral_score", "availability"), "behave_f"),
        "candidate_texts": f"""{B.people()}, ct AS (SELECT d, string_agg(title || ' at ' || company || ': ' || description, ' ' ORDER BY pos)
            FILTER (description <> '') AS txt FROM career GROUP BY d), sn AS (SELECT d, string_agg(name, ', ' ORDER BY pos) AS names FROM skills GROUP BY d)
            SELECT candidate_id, length(coalesce(txt, '')) AS career_chars, md5(coalesce(txt, '')) AS career_md5,
            coalesce(names, '') AS skill_names, concat_ws(' / ', nullif(trim(headline), ''), source) AS label
            FROM people LEFT JOIN ct USING (d) LEFT JOIN sn USING (d) JOIN documents ON doc_id = d""",
        "jd_sections": _jobs("SELECT jd_id, pos, section, text FROM sect"),
        "jd_paragraphs": _jobs("SELECT jd_id, pos, text, is_heading, NOT is_heading AND starts_with(text, '-') AS is_bullet FROM para"),
        "jd_competencies": _jobs(f"SELECT jd_id, ord, name, category, {r8('importance')}, section_source FROM competency",
                                 B.competencies_cte()),
        "jd_default_mentions": _default_mentions(),
        "jd_priorities": _jobs(f"""SELECT jd_id, name, {r8('p / sum(p) OVER (PARTITION BY jd_id) AS priority')} FROM (SELECT jd_id, name,
            greatest(0.1, least(1.0, freq * 0.1 * CASE WHEN category = 'mandatory' THEN 1.5 ELSE 1.0 END)) AS p FROM competency)""",
            B.competencies_cte()),
        "jd_concepts": _jobs("SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY found / total DESC, o) AS ord, primary_term, "
                             + r8("found / total AS importance") + ", related FROM (SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT jd_id, {i} AS o, {q(label)} AS primary_term, array_to_string(list_filter({B.items(terms)}, lambda w: contains(t, lower(w))), ',') AS related, "
            f"len(list_filter({B.items(terms)}, lambda w: contains(t, lower(w))))::DOUBLE AS found, {len(terms)} AS total FROM raw"
            for i, (label, terms) in enumerate(S.CONCEPT_CLUSTERS.items())) + ") WHERE found > 0)"),
        "jd_philosophy": _jobs(f"""SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY strength DESC, ord) AS ord,
            dimension, {r8('strength')} FROM philosophy""", B.JOB_FACTS),
        "jd_constraints": _jobs(" UNION ALL ".join(
            [f"SELECT jd_id, 'experience_years' AS name, regexp_extract(t, {q(S.YEARS_CONSTRAINT_PATTERN)}) AS value, 'requirement' AS constraint_type FROM raw WHERE regexp_matches(t, {q(S.YEARS_CONSTRAINT_PATTERN)})"]
            + [f"SELECT jd_id, 'work_mode', {q(w)}, 'preference' FROM raw WHERE contains(t, {q(w)})" for w in S.WORK_MODE_TERMS]
            + ["SELECT jd_id, 'production_experience', 'required', 'requirement' FROM raw WHERE contains(t, 'production')"])),
        "jd_experience": _jobs(f"""SELECT jd_id, {r8('coalesce(low, 0) AS min_years', 'max_years',
            'CASE WHEN has_span THEN (low + max_years) / 2 ELSE coalesce(low + 2, 0) END AS preferred_years')}, seniority_level FROM experience""",
            B.JOB_FACTS),
        "jd_role": _jobs("SELECT jd_id, title, role_mode AS work_mode FROM raw JOIN experience USING (jd_id)", B.JOB_FACTS),
        "jd_behavior": _jobs(" UNION ALL ".join(
            f"SELECT jd_id, {q(label)} AS label FROM raw WHERE {B.any_contains('t', words)}"
            for label, words in S.BEHAVIOR_TERMS.items())),
        "jd_disqualifiers": _disqualifiers(),
        "jd_weights": _jobs(" UNION ALL ".join(
            f"SELECT jd_id, {q(label)} AS dimension, {r8(f'w{i + 1} AS share')} FROM weights" for i, label in enumerate(LABELS)),
            B.JOB_FACTS),
        "jd_top_competencies": _jobs(f"""SELECT jd_id, CASE category WHEN 'mandatory' THEN 'required' ELSE 'preferred' END AS kind, ord, name,
            {r8('importance')}, CASE WHEN importance >= 0.7 THEN 'high' WHEN importance >= 0.4 THEN 'medium' ELSE 'low' END AS band
            FROM competency WHERE ord <= 3""", B.competencies_cte()),
        "sentences": _sentences(),
        "text_functions": _text_functions(),
        "number_formats": f"""SELECT o_orderkey, {fixed('x', 0)} AS f0, {fixed('x', 1)} AS f1, {fixed('x', 3)} AS f3, {fixed('x', 6)} AS f6,
            {pct('o_orderkey / 800.0')} AS pct, CASE WHEN b >= 0.7 THEN 'high' WHEN b >= 0.4 THEN 'medium' ELSE 'low' END AS band
            FROM (SELECT o_orderkey, o_totalprice / 1000.0 AS x, o_orderkey % 100 / 100.0 AS b FROM orders)""",
        "ingest_jsonl": f"""{_ingest()} SELECT 'E' || i AS candidate_id, event_type AS headline, {r8('value AS years', 'k')},
            CASE WHEN i % 5 = 0 THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS endorsements, 'beginner' AS proficiency,
            i % 2 = 0 AS verified FROM o WHERE outcome = 'ok'""",
        "ingest_rejects": f"{_ingest()} SELECT outcome, count(*) AS n FROM o WHERE outcome <> 'blank' GROUP BY outcome",
        "normalize_robust": _normalize("quantile_cont(o_totalprice, 0.5)",
                                       "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"),
        "normalize_minmax": _normalize("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"),
        "normalize_standard": _normalize("avg(o_totalprice)", "stddev_pop(o_totalprice)"),
        "percentile_rank": f"SELECT o_orderkey, {r8('o_totalprice')}, {r8('cume_dist() OVER (ORDER BY o_totalprice) AS percentile_rank')} FROM orders",
        "running_stats": f"""SELECT event_type, count(value) AS n, {r8('avg(value) AS mean', 'var_samp(value) AS variance',
            'stddev_samp(value) AS std', 'min(value) AS min_val', 'max(value) AS max_val')} FROM events GROUP BY event_type""",
        "corpus_z_scores": _z(["experience", "skills", "endorsements", "response_rate", "completeness"]),
        "quantiles": f"SELECT p, {r8('v AS value')} FROM (" + " UNION ALL ".join(
            f"SELECT {p} AS p, quantile_cont(value, {p}) AS v FROM events" for p in (0.05, 0.25, 0.5, 0.75, 0.99)) + ")",
        "cosine_to_label": f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            h AS (SELECT label, arg_min(v, vec_id) AS v FROM e GROUP BY label)
            SELECT vec_id, {r8('list_cosine_similarity(e.v, h.v) AS cosine')} FROM e JOIN h USING (label)""",
        "score_histogram": f"""{ranked()} SELECT CAST(CASE WHEN lo = hi THEN 0 ELSE least(floor((score - lo) / (hi - lo) * 20), 19) END AS BIGINT) AS bin,
            count(*) AS n FROM ranked, (SELECT min(score) AS lo, max(score) AS hi FROM ranked) GROUP BY bin""",
        "score_bands": f"""{B.pairs()} SELECT CASE WHEN technical_alignment >= 0.7 THEN 'high' WHEN technical_alignment >= 0.4
            THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM scored GROUP BY band""",
        "ranking_table": f"{explained()} SELECT {_TABLE} FROM explained",
        "search_filter": f"""{explained()} SELECT * FROM (SELECT {_TABLE} FROM explained) WHERE score >= 0.4
            AND (regexp_matches(lower(candidate), 'lead|12$') OR regexp_matches(lower(title), 'lead|12$'))""",
        "dims_long": f"""{ranked(DIM_ROWS)} SELECT jd_id, candidate_id, rank, short AS dimension, {r8('value')}
            FROM dim JOIN ranked USING (jd_id, candidate_id) WHERE rank <= 5""",
        "contrib_matrix": f"{ranked()} SELECT jd_id, candidate_id, rank, {r8(*DIMS)} FROM ranked WHERE rank <= 20",
        "candidate_card": f"""{ranked()} SELECT jd_id, rank, candidate_id, name, title, {r8('years')}, {ints('total_skills AS skills',
            'matched AS relevant_skills', 'n_jobs AS companies')}, {pct('skill_coverage')} AS skill_coverage, {pct('assessment_avg')} AS assessment_avg,
            CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM ranked""",
        "headline_metrics": f"""{ranked()} SELECT (SELECT count(*) FROM people) AS total_candidates, count(*) AS candidates_ranked,
            2.0 AS runtime_seconds, {r8('(SELECT count(*) FROM people) / 2.0 AS throughput')},
            CAST({fixed('max(score)', 4)} AS DOUBLE) AS top_score FROM ranked""",
        "stream_topk": f"""SELECT event_type, user_id, event_id, {r8('value')}, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS rank FROM (
              SELECT event_type, user_id, max(value) AS value, arg_min(event_id, (-value, event_id)) AS event_id FROM events
              GROUP BY event_type, user_id)) WHERE rank <= {K}""",
        "stream_ranking": "",
        "quantiles_by_group": f"""SELECT event_type, p, {r8('min(value) AS value')} FROM (SELECT event_type, value,
            row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events
            WHERE value IS NOT NULL), (SELECT unnest([0.1, 0.5, 0.9]) AS p) WHERE rn >= p * n GROUP BY event_type, p""",
        "reject_counts": f"""{_ingest()} SELECT count(*) FILTER (outcome = 'ok') AS parsed, count(*) FILTER (outcome <> 'ok') AS errors,
            count(*) FILTER (outcome = 'malformed') AS malformed FROM o WHERE outcome <> 'blank'""",
        "ingest_array": """SELECT outcome, count(*) AS n FROM (
            SELECT CASE WHEN event_id % 17 = 5 OR event_id % 23 = 7 THEN 'invalid' ELSE 'ok' END AS outcome FROM events
            WHERE event_id // 1000 % 7 <> 3
            UNION ALL SELECT 'malformed' FROM (SELECT DISTINCT event_id // 1000 AS f FROM events) WHERE f % 7 = 3) GROUP BY outcome""",
        "ingest_kinds": """SELECT CASE WHEN event_id % 4 = 0 THEN 'D' ELSE 'K' END || event_id AS candidate_id,
            CAST(event_id % 4 = 2 AS BIGINT) AS n_skills, CASE WHEN event_id % 4 = 2 THEN event_id + 3000000000 ELSE 0 END AS endorsements,
            event_id % 4 = 3 AS odd, CASE WHEN event_id % 4 = 3 THEN ': NaN,' ELSE '' END AS headline FROM events""",
        "encoded_scores": _encoded(),
        "sentence_vectors": f"""WITH s AS ({_sentences()}) SELECT doc_id AS jd_id, pos, {r8('length(sentence) AS v0', _a_count('sentence') + ' AS v1', '1 AS v2')}
            FROM s""",
        "rank_with_copies": f"""{B.pairs()} SELECT jd_id, candidate_id, rank, {r8('score')} FROM (SELECT *, row_number() OVER (
            PARTITION BY jd_id ORDER BY score DESC, candidate_id) AS rank FROM (SELECT jd_id, CASE WHEN d % 1000 % 3 = 0 THEN 'CAND_HOT'
            ELSE candidate_id END AS candidate_id, max(score) AS score FROM scored GROUP BY ALL)) WHERE rank <= {K}""",
        "csv_sink": f"""{explained()} SELECT jd_id, candidate_id, rank, {fixed('score', 6)} AS score, reasoning FROM explained""",
        "explanations_sink": f"""{explained()} SELECT jd_id, candidate_id, rank, {SCORE6}, reasoning, trace AS decision_trace FROM explained""",
        "metadata_sink": f"""{explained()} SELECT jd_id, candidate_id, rank, {SCORE6}, {r8('confidence')} FROM explained""",
        "metrics_sink": f"""SELECT (SELECT count(*) FROM documents) AS total_candidates, CAST((SELECT count(*) FROM benchmark)
            * least({K}, (SELECT count(*) FROM documents)) AS BIGINT) AS candidates_ranked, CAST(0 AS BIGINT) AS errors,
            CAST(5 AS BIGINT) AS n_stages, true AS timed""",
    }
    texts |= {
        "docx_jobs": f"{B.jobs('benchmark', 'item_id')} SELECT jd_id, pos, section, text FROM sect WHERE jd_id % 7 <> 3",
        "docx_rejects": "SELECT item_id AS jd_id, true AS explained FROM benchmark WHERE item_id % 7 = 3",
        "percentile_of": f"SELECT {r8('avg((o_totalprice <= 150000.0)::INT) AS percentile_rank')} FROM orders",
        "format_dispatch": "SELECT unnest(['records.jsonl', 'records.json']) AS source, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events",
        "stream_quantiles": """SELECT event_type, p, count(*) AS n, true AS within FROM events, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS p)
            WHERE value IS NOT NULL GROUP BY event_type, p""",
        "stream_progress": "SELECT CAST(4 AS BIGINT) AS batches, count(*) AS n_rows, count(*) AS observed FROM events",
    }
    texts["normalize_unknown"] = texts["normalize_robust"]
    texts["stream_stats"] = texts["running_stats"]
    texts["stream_keep_best"] = texts["dedup_best"]
    # The stream carries no embeddings, so its semantic dimension is 0.
    texts["stream_ranking"] = f"""{explained()} SELECT jd_id, candidate_id, rank, {SCORE6}, reasoning FROM explained""".replace(
        "LEFT JOIN vec a ON a.vec_id = p.d", "LEFT JOIN vec a ON a.vec_id = -1")
    return {name: doubles(sql) for name, sql in texts.items()}


_TABLE = f"""jd_id, rank, name AS candidate, title, {r8('years AS experience')}, CAST({fixed(f"CAST({fixed('score', 6)} AS DOUBLE)", 4)} AS DOUBLE) AS score,
  {', '.join(f"CAST({fixed(key, 3)} AS DOUBLE) AS {short.lower()}" for key, short in zip(DIMS, SHORT_LABELS))},
  CAST({fixed('confidence', 3)} AS DOUBLE) AS confidence"""
