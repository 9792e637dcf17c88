"""Shared CTEs of the oracle: candidates, jobs, features and scores as flat relations.

The library works on nested rows; the oracle is written with joins, unnest and
group by over flat relations, so the two share no logic.
"""

from __future__ import annotations

import unicodedata

from talentloom import settings as S
from talentloom.plans import derived as D


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_contains(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def any_match(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


def seniority(title: str) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower({title}), {q(w)}) THEN {v} ELSE 0 END"
                      for w, v in S.SENIORITY_LEVELS.items())
    return f"CAST(greatest({S.SENIORITY_FLOOR}, {cases}) AS BIGINT)"


def size_level(size: str) -> str:
    return f"CAST(coalesce(list_position({items(S.COMPANY_SIZES)}, {size}), 0) AS BIGINT)"


def nfkd(text: str) -> str:
    """Decompose the Latin letters with marks (the only foreign ones in the tables)."""
    for code in range(0xA0, 0x180):
        folded = unicodedata.normalize("NFKD", chr(code))
        if folded != chr(code):
            text = f"replace({text}, {q(chr(code))}, {q(folded)})"
    return text


def clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def wavg(pairs) -> str:
    top = " + ".join(f"{v} * {w}::DOUBLE" for v, w in pairs)
    return f"(({top}) / ({' + '.join(f'{w}::DOUBLE' for _, w in pairs)}))"


def add(*rules: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END" for c, v in rules)


def pick(options, index: str) -> str:
    return f"{items(options)}[CAST(1 + ({index}) % {len(options)} AS BIGINT)]"


LINES = """
lines AS (SELECT d, i AS pos, l[i] AS line FROM (
    SELECT doc_id AS d, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents
  ), unnest(range(1, len(l) + 1)) AS t(i))"""

CAREER = f"""
career AS (SELECT d, pos, 'Company ' || (n % 97) AS company, title, start_date,
    CASE WHEN pos > 1 THEN CAST(CAST(start_date AS DATE) + CAST(months * 30 AS INTEGER) AS VARCHAR) END AS end_date,
    months, pos = 1 AS is_current, industry, company_size, description,
    {seniority('title')} AS lvl, {size_level('company_size')} AS sz
  FROM (SELECT d, pos, n, {pick(D.TITLES, 'n')} AS title, 1 + n % 36 AS months,
      CAST(DATE '2023-12-01' - CAST(pos * 180 + n % 90 AS INTEGER) AS VARCHAR) AS start_date,
      {pick(D.INDUSTRIES, 'b')} AS industry, {pick(S.COMPANY_SIZES + ('',), 'b')} AS company_size,
      CASE WHEN n % 7 = 0 THEN '' ELSE line END AS description
    FROM (SELECT d, pos, line, length(line) AS n, length(line) - length(replace(line, ' ', '')) AS b FROM lines)))"""

SKILLS = f"""
skills AS (SELECT d, i AS pos, lower(regexp_extract(p[i], '[A-Za-z]+')) AS name,
    {pick(D.PROFICIENCIES, 'length(p[i])')} AS proficiency, length(p[i]) % 17 AS endorsements,
    length(p[i]) % 60 AS months
  FROM (SELECT doc_id AS d, list_filter(string_split(text, '. '), lambda x: regexp_matches(x, '[A-Za-z]')) AS p
        FROM documents), unnest(range(1, len(p) + 1)) AS t(i)),
tests AS (SELECT d, pos, name || ' test ' || pos AS name, CAST((months * 7 + endorsements) % 101 AS DOUBLE) AS score
  FROM skills WHERE endorsements % 3 = 0)"""

PEOPLE = f"""
sig AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views,
    count(*) FILTER (event_type = 'signup') AS applications, count(*) FILTER (event_type = 'click') AS searches,
    count(*) FILTER (event_type = 'purchase') AS saved, count(*) AS n_events, CAST(max(ts) AS DATE) AS last_seen
  FROM events GROUP BY user_id),
people AS (SELECT doc_id AS d, 'CAND_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS candidate_id,
    'Candidate ' || doc_id AS name, coalesce(c.title, '') AS title, coalesce(c.company_size, '') AS company_size,
    CASE WHEN doc_id % 10 = 9 THEN '' ELSE concat_ws(' | ', c.title, source) END AS headline,
    coalesce(f.line, '') AS summary, (n_chars % 210) / 10.0::DOUBLE AS years,
    CASE lang {' '.join(f"WHEN '{k}' THEN {q(v)}" for k, v in D.SECTORS.items())} ELSE '' END AS industry,
    coalesce(views, 0) AS views, coalesce(applications, 0) AS applications, coalesce(searches, 0) AS searches,
    coalesce(saved, 0) AS saved, coalesce(saved::DOUBLE / n_events, 0) AS response_rate,
    last_seen - CAST(doc_id % 120 AS INTEGER) AS last_active,
    CAST(40 + doc_id % 61 AS DOUBLE) AS completeness, doc_id % 2 = 0 AS open_to_work,
    CAST((doc_id % 9) * 20 AS DOUBLE) AS response_hours, doc_id % 300 AS connections,
    doc_id % 25 AS endorsed, (doc_id % 7) * 15 AS notice, {pick(D.MODES, 'doc_id')} AS work_mode,
    doc_id % 3 = 0 AS relocates, CAST(doc_id % 80 - 1 AS DOUBLE) AS github,
    (doc_id % 11) / 10.0::DOUBLE AS interview_rate, (doc_id % 13) / 12.0::DOUBLE AS offer_rate,
    doc_id % 3 <> 0 AS email, doc_id % 5 <> 0 AS phone, doc_id % 2 = 1 AS linked
  FROM documents LEFT JOIN sig ON user_id = doc_id
  LEFT JOIN career c ON c.d = doc_id AND c.pos = 1 LEFT JOIN lines f ON f.d = doc_id AND f.pos = 1),
education AS (SELECT doc_id AS d, j, {pick(D.DEGREES, 'doc_id + j')} AS degree, {pick(D.FIELDS, 'doc_id + j')} AS field,
    'tier_' || (1 + (doc_id + j) % 5) AS tier
  FROM documents, unnest(range(0, doc_id % 3)) AS t(j)),
certs AS (SELECT d, 'certified ' || name AS name FROM skills WHERE pos = 1 AND d % 4 = 1)"""

_DEGREE_CASE = " ".join(f"WHEN contains(lower(degree), {q(w)}) THEN {v}" for w, v in S.DEGREE_LEVELS.items())
_PROF_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.PROFICIENCY_LEVELS.items())

FEATURES = f"""
skill_f AS (SELECT p.d, count(s.pos) AS total_skills,
    coalesce(avg(CASE proficiency {_PROF_CASE} WHEN NULL THEN NULL ELSE 1 END) FILTER (s.pos IS NOT NULL) / 4.0::DOUBLE, 0) AS avg_proficiency,
    coalesce(avg(endorsements), 0) AS avg_endorsements,
    coalesce(avg(s.months) FILTER (s.months > 0), 0) AS avg_skill_duration,
    coalesce(count(*) FILTER (proficiency IN ('advanced', 'expert'))::DOUBLE / nullif(count(s.pos), 0), 0) AS strong_ratio
  FROM people p LEFT JOIN skills s ON s.d = p.d GROUP BY p.d),
test_f AS (SELECT d, avg(score) / 100.0::DOUBLE AS assessment_avg FROM tests GROUP BY d),
cert_f AS (SELECT d, count(*) AS certs FROM certs GROUP BY d),
career_f AS (SELECT p.d, count(c.pos) AS n_jobs, coalesce(sum(months), 0) AS total_months,
    coalesce(avg(months), 0) AS avg_tenure, coalesce(max(months) FILTER (is_current), 0) AS current_months,
    coalesce(bool_or(sz <= 2), false) AS startup, coalesce(bool_or(sz >= 6), false) AS large
  FROM people p LEFT JOIN career c ON c.d = p.d GROUP BY p.d),
edu_f AS (SELECT p.d, count(e.j) AS n_edu, coalesce(max(CASE {_DEGREE_CASE} ELSE 0 END), 0) AS degree_level,
    coalesce(min(CASE tier WHEN 'tier_1' THEN 1 WHEN 'tier_2' THEN 2 WHEN 'tier_3' THEN 3 ELSE 4 END) FILTER (e.j IS NOT NULL), 4) AS tier,
    coalesce(bool_or({any_contains('lower(field)', S.TECH_FIELDS)}), false) AS tech_field
  FROM people p LEFT JOIN education e ON e.d = p.d GROUP BY p.d),
moves AS (SELECT a.d, a.pos, b.title AS from_title, a.title AS to_title, b.industry AS from_industry,
    a.industry AS to_industry, a.lvl > b.lvl AS up, a.lvl = b.lvl AS flat, a.sz AS sz_now, b.sz AS sz_before,
    CASE WHEN a.industry = '' OR b.industry = '' THEN 0.0 WHEN a.industry = b.industry THEN 1.0
      WHEN len(list_filter(string_split(lower(b.industry), ' '), lambda w: length(w) > 3 AND contains(lower(a.industry), w))) > 0
      THEN 0.5 ELSE 0.0 END AS related
  FROM career a JOIN career b ON b.d = a.d AND b.pos = a.pos + 1),
move_f AS (SELECT d, {clip('0.4 + sum(related)::DOUBLE / count(*) * 0.6')} AS coherence,
    {clip('0.3 + avg(up::INT) * 0.4 + avg((up OR flat)::INT) * 0.3')} AS progression,
    {clip('''0.3 + avg(CASE WHEN sz_now > sz_before THEN 1.0 WHEN sz_now = sz_before THEN 0.5 ELSE 0 END) * 0.3
       + avg((up OR flat)::INT) * 0.4''')} AS growth
  FROM moves GROUP BY d),
title_words AS (SELECT d, unnest(list_filter(string_split(lower(title), ' '), lambda w: w <> '')) AS w FROM people),
head_f AS (SELECT t.d, count(*) FILTER (contains(lower(headline), w))::DOUBLE / count(*) * 0.3 AS part
  FROM title_words t JOIN people USING (d) GROUP BY t.d),
recent_words AS (SELECT DISTINCT d, w FROM (
  SELECT d, unnest(string_split(lower(title), ' ')) AS w FROM career WHERE pos <= 3) WHERE length(w) > 3),
recent_f AS (SELECT r.d, least(0.2, count(*) FILTER (contains(lower(summary), w)) * 0.05::DOUBLE) AS part
  FROM recent_words r JOIN people USING (d) GROUP BY r.d),
flags AS (SELECT *, n_jobs >= 2 AND years > 0 AND (total_months / 12.0::DOUBLE / nullif(years, 0) < 0.5
    OR total_months / 12.0::DOUBLE / nullif(years, 0) > 2.0) AS mismatch FROM people JOIN career_f USING (d)),
auth_f AS (SELECT p.d, CASE WHEN headline = '' OR summary = '' THEN 0.5
      ELSE {clip('0.5 + coalesce(h.part, 0) + coalesce(r.part, 0)')} END AS semantic_coherence,
    CASE WHEN n_jobs < 2 THEN 0.7 ELSE m.coherence END AS career_coherence,
    coalesce(mismatch, false) AS mismatch,
    CASE WHEN n_jobs < 2 THEN 0.9 WHEN mismatch THEN 0.8 ELSE 1.0 END AS timeline,
    CASE WHEN n_edu = 0 THEN 0.5 WHEN NOT {any_contains('lower(title)', S.TECH_TITLE_TERMS)} THEN 0.6
      WHEN tech_field THEN 0.8 ELSE 0.5 END AS edu_align,
    {clip('0.5 + ' + add(('length(summary) > 50', 0.15), ('n_jobs > 0', 0.15), ('total_skills > 0', 0.1), ('n_edu > 0', 0.05), ('certs > 0', 0.05)))} AS support,
    CASE WHEN n_jobs = 0 THEN 0.0 WHEN n_jobs < 2 THEN 0.6 ELSE m.progression END AS progression,
    CASE WHEN n_jobs = 0 THEN 0.0 WHEN n_jobs < 2 THEN 0.5 ELSE m.growth END AS growth
  FROM flags p JOIN edu_f USING (d) JOIN skill_f USING (d) LEFT JOIN cert_f USING (d) LEFT JOIN move_f m USING (d)
  LEFT JOIN head_f h USING (d) LEFT JOIN recent_f r USING (d)),
behave_p AS (SELECT *, DATE '{D.AS_OF}' - last_active AS idle FROM people),
behave AS (SELECT d,
    {clip("0.3 + CASE WHEN applications > 0 THEN least(0.2, applications * 0.03::DOUBLE) ELSE 0 END + " + add(('connections > 100', 0.1), ('endorsed > 10', 0.1), ('github > 30', 0.15), ('interview_rate > 0.7::DOUBLE', 0.15)))} AS engagement,
    {clip('CASE WHEN response_hours < 24 THEN least(1.0, response_rate + 0.15) WHEN response_hours > 120 THEN greatest(0.0, response_rate - 0.1) ELSE response_rate END')} AS responsiveness,
    {clip('0.3 + ' + add(('views > 10', 0.15), ('searches > 50', 0.15), ('applications > 0', 0.1)) + ' + CASE WHEN idle < 30 THEN 0.2 WHEN idle < 90 THEN 0.1 ELSE 0 END')} AS activity,
    {clip('0.3 + CASE WHEN saved > 5 THEN 0.3 WHEN saved > 0 THEN 0.15 ELSE 0 END + ' + add(('views > 20', 0.2), ('searches > 100', 0.2)))} AS interest,
    {clip('0.3 + ' + add(('email', 0.25), ('phone', 0.25), ('linked', 0.2)))} AS verification,
    {clip('0.3 + ' + add(('open_to_work', 0.25)) + ' + CASE WHEN notice <= 30 THEN 0.2 WHEN notice <= 60 THEN 0.1 ELSE 0 END + ' + add(('offer_rate > 0.5', 0.15), ('interview_rate > 0.8::DOUBLE', 0.1)))} AS readiness,
    completeness / 100.0::DOUBLE AS quality,
    {clip('0.4 + ' + add(('open_to_work', 0.25)) + ' + CASE WHEN notice <= 15 THEN 0.25 WHEN notice <= 30 THEN 0.2 WHEN notice <= 60 THEN 0.1 WHEN notice <= 90 THEN 0.0 ELSE -0.1 END')} AS availability
  FROM behave_p),
behave_f AS (SELECT *, {wavg(list(zip(('engagement', 'responsiveness', 'activity', 'interest', 'verification', 'readiness', 'quality'), S.BEHAVIOR_WEIGHTS)))} AS behavioral FROM behave)"""


def jobs_cte(table: str, id_col: str) -> str:
    """Advert lines, headings, sections and raw text of the derived jobs."""
    i = id_col
    years = f"""CASE {i} % 5 WHEN 0 THEN lo || '+ years' WHEN 1 THEN 'at least ' || lo || ' years'
      WHEN 2 THEN lo || ' to ' || hi || ' years' ELSE lo || '-' || hi || ' years' END"""
    return f"""
src AS (SELECT {i} AS jd_id, CAST(2 + {i} % 4 AS VARCHAR) AS lo, CAST(8 + {i} % 5 AS VARCHAR) AS hi, {i},
    string_split(replace(text, chr(10), ' '), '. ') AS p FROM {table}),
advert AS (SELECT jd_id, [
    {pick(D.HEADINGS, i)},
    'We work ' || {pick(D.PLACES, i)} || ' and run production systems in production. You deploy and monitor them.',
    CASE WHEN {i} % 2 = 0 THEN 'We expect curiosity and ownership.' ELSE 'A fast startup team.' END,
    'REQUIRED SKILLS',
    'You must have ' || {years} || ' with: ' || array_to_string(p[1:(len(p) + 1) // 2], '. '),
    'NICE TO HAVE',
    '- Bonus: ' || array_to_string(p[(len(p) + 1) // 2 + 1:], '. '),
    'We are not looking for shortcuts. Do not apply twice; avoid agencies.',
    CASE WHEN {i} % 3 = 0 THEN 'ABOUT US' ELSE 'NICE TO HAVE' END,
    'Ideally you like ' || p[-1]] AS l FROM src),
para AS (SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY k) AS pos, t AS text,
    upper(t) = t AND lower(t) <> t AND length(t) BETWEEN 3 AND 99 AS is_heading
  FROM (SELECT jd_id, k, trim(regexp_replace({nfkd('l[k]')}, '\\s+', ' ', 'g')) AS t
        FROM advert, unnest(range(1, 11)) AS u(k)) WHERE t <> ''),
runs AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY jd_id ORDER BY pos) AS run FROM para),
run_text AS (SELECT jd_id, run, coalesce(max(text) FILTER (is_heading), 'Introduction') AS section,
    string_agg(text, chr(10) ORDER BY pos) FILTER (NOT is_heading) AS text FROM runs GROUP BY jd_id, run),
sect AS (SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY first_run) AS pos, section, text
  FROM (SELECT jd_id, section, min(run) AS first_run, arg_max(text, run) AS text FROM run_text
        WHERE text IS NOT NULL GROUP BY jd_id, section)),
raw AS (SELECT jd_id, string_agg(text, chr(10) ORDER BY pos) AS raw_text,
    lower(string_agg(text, chr(10) ORDER BY pos)) AS t, min_by(text, pos) FILTER (is_heading) AS title
  FROM para GROUP BY jd_id)"""


def competencies_cte(patterns=D.PATTERNS) -> str:
    found = " UNION ALL ".join(
        f"SELECT jd_id, unnest(regexp_extract_all(t, {q('(?i)' + p)})) AS m FROM raw" for p in patterns)
    return f"""
mention AS (SELECT DISTINCT jd_id, trim(m) AS name FROM ({found}) WHERE length(trim(m)) > 1),
hint AS (SELECT *, nr OR (NOT nr AND NOT np AND rp) AS required, (NOT nr AND np) OR (NOT nr AND NOT np AND pp) AS preferred
  FROM (SELECT jd_id, pos, section, lower(text) AS t, {any_contains('lower(section)', S.REQUIRED_SECTION_WORDS)} AS nr,
      {any_contains('lower(section)', S.PREFERRED_SECTION_WORDS)} AS np, {any_match('lower(text)', S.REQUIREMENT_PATTERNS)} AS rp,
      {any_match('lower(text)', S.PREFERRED_PATTERNS)} AS pp FROM sect)),
comp AS (SELECT m.jd_id, m.name, CASE WHEN bool_or(required) IS TRUE OR bool_or(preferred) IS NOT TRUE
      THEN 'mandatory' ELSE 'preferred' END AS category, coalesce(arg_max(h.section, h.pos), '') AS section_source
  FROM mention m LEFT JOIN hint h ON h.jd_id = m.jd_id AND contains(h.t, m.name) GROUP BY m.jd_id, m.name),
competency AS (SELECT *, least(1.0, freq * 0.15::DOUBLE) AS importance,
    row_number() OVER (PARTITION BY jd_id, category ORDER BY least(1.0, freq * 0.15::DOUBLE) DESC, name) AS ord
  FROM (SELECT c.*, (length(t) - length(replace(t, name, ''))) // length(name) AS freq FROM comp c JOIN raw USING (jd_id)))"""


_SPAN, _PLUS, _LEAST, _MIN = (q("(?i)" + p) for p in S.YEARS_PATTERNS)
_PHILOSOPHY = " UNION ALL ".join(
    f"SELECT jd_id, {i} AS ord, '{name}' AS dimension, "
    + " + ".join(f"len(regexp_extract_all(t, {q('(?i)' + p)}))" for p in patterns) + " AS n FROM raw"
    for i, (name, patterns) in enumerate(S.PHILOSOPHY_PATTERNS.items()))

JOB_FACTS = f"""
experience AS (SELECT jd_id, has_span, CASE WHEN has_span THEN CAST(regexp_extract(raw_text, {_SPAN}, 1) AS DOUBLE)
      WHEN regexp_matches(raw_text, {_PLUS}) THEN CAST(regexp_extract(raw_text, {_PLUS}, 1) AS DOUBLE)
      WHEN regexp_matches(raw_text, {_LEAST}) THEN CAST(regexp_extract(raw_text, {_LEAST}, 1) AS DOUBLE)
      WHEN regexp_matches(raw_text, {_MIN}) THEN CAST(regexp_extract(raw_text, {_MIN}, 1) AS DOUBLE) END AS low,
    CASE WHEN has_span THEN CAST(regexp_extract(raw_text, {_SPAN}, 2) AS DOUBLE) ELSE 50 END AS max_years,
    CASE WHEN contains(t, 'senior') OR contains(t, 'sr.') THEN 'senior' WHEN contains(t, 'lead') OR contains(t, 'principal')
      THEN 'lead' WHEN contains(t, 'junior') OR contains(t, 'entry') THEN 'junior' ELSE 'mid' END AS seniority_level,
    CASE WHEN contains(t, 'remote') THEN 'remote' WHEN contains(t, 'hybrid') THEN 'hybrid'
      WHEN contains(t, 'onsite') OR contains(t, 'on-site') THEN 'onsite' ELSE 'flexible' END AS role_mode
  FROM (SELECT *, regexp_matches(raw_text, {_SPAN}) AS has_span FROM raw)),
philosophy AS (SELECT *, least(1.0, n * 0.15::DOUBLE) AS strength FROM ({_PHILOSOPHY}) WHERE n > 0),
culture AS (SELECT r.jd_id, coalesce(max(strength) FILTER (dimension = 'production_experience'), 0) > 0.5 AS prod,
    coalesce(max(strength) FILTER (dimension = 'startup_adaptability'), 0) > 0.5 AS startup_like
  FROM raw r LEFT JOIN philosophy p ON p.jd_id = r.jd_id GROUP BY r.jd_id),
weight0 AS (SELECT jd_id, 0.25::DOUBLE + {add(('prod', 0.03))} AS w1, 0.20::DOUBLE AS w2, 0.20::DOUBLE + {add(('prod', 0.05))} AS w3,
    0.10::DOUBLE AS w4, 0.10::DOUBLE + {add(('startup_like', 0.03))} AS w5, 0.08::DOUBLE + {add(('startup_like', 0.02))} AS w6, 0.07::DOUBLE AS w7 FROM culture),
weights AS (SELECT jd_id, w1 / s AS w1, w2 / s AS w2, w3 / s AS w3, w4 / s AS w4, w5 / s AS w5, w6 / s AS w6, w7 / s AS w7
  FROM (SELECT *, w1 + w2 + w3 + w4 + w5 + w6 + w7 AS s FROM weight0))"""

EVIDENCE = """
texts AS (SELECT p.d, lower(p.summary) AS summary, lower(p.headline) AS headline, lower(p.title) AS title,
    coalesce(c.txt, '') AS career_text FROM people p LEFT JOIN (
      SELECT d, string_agg(lower(description), ' ' ORDER BY pos) FILTER (description <> '') AS txt FROM career GROUP BY d) c USING (d)),
term AS (SELECT DISTINCT name AS term FROM competency),
t_skill AS (SELECT d, term, bool_or(contains(name, term)) AS in_skills, bool_or(contains(name, term) OR contains(term, name)) AS matched,
    arg_min(months, pos) FILTER (contains(name, term)) AS months, arg_min(endorsements, pos) FILTER (contains(name, term)) AS endorsements
  FROM (SELECT d, name, pos, months, endorsements FROM skills), term WHERE contains(name, term) OR contains(term, name) GROUP BY d, term),
t_career AS (SELECT d, term, count(*) AS mentions FROM career, term WHERE contains(lower(description), term) GROUP BY d, term),
t_test AS (SELECT d, term, arg_min(score, pos) AS score FROM tests, term WHERE contains(lower(name), term) GROUP BY d, term),
t_cert AS (SELECT DISTINCT d, term FROM certs, term WHERE contains(name, term)),
ev0 AS (SELECT t.d, term, coalesce(in_skills, false) AS in_skills, contains(summary, term) OR contains(headline, term) AS in_summary,
    contains(career_text, term) AS in_career, c.d IS NOT NULL AS in_cert, contains(title, term) AS in_title,
    coalesce(matched, false) AS matched, coalesce(e.score, 0) AS score, coalesce(s.months, 0) AS months,
    coalesce(s.endorsements, 0) AS endorsements, coalesce(mentions, 0) AS mentions
  FROM texts t CROSS JOIN term LEFT JOIN t_skill s USING (d, term) LEFT JOIN t_career k USING (d, term)
  LEFT JOIN t_test e USING (d, term) LEFT JOIN t_cert c USING (d, term)),
ev1 AS (SELECT *, in_skills::INT + in_summary::INT + in_career::INT + in_cert::INT + (score > 0)::INT AS sources FROM ev0),
evidence AS MATERIALIZED (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0, sources * 0.25::DOUBLE) + CASE WHEN score > 60 THEN 0.15 ELSE 0 END
    + CASE WHEN months > 24 THEN 0.10 ELSE 0 END + CASE WHEN endorsements > 10 THEN 0.05 ELSE 0 END
    + CASE WHEN mentions > 1 THEN 0.10 ELSE 0 END)) AS confidence FROM ev1)"""

PAIRS = f"""
job_n AS (SELECT r.jd_id, count(c.name) AS n, count(c.name) FILTER (category = 'mandatory') AS n_req
  FROM raw r LEFT JOIN competency c USING (jd_id) GROUP BY r.jd_id),
roll AS (SELECT jd_id, d, sum(round(confidence * 20)) / 20.0::DOUBLE AS conf, count(*) FILTER (sources > 0) AS covered, sum(sources) AS sources,
    count(*) FILTER (confidence > 0.6) AS strong, count(*) FILTER (confidence < 0.3) AS weak, count(*) FILTER (matched) AS matched,
    string_agg(term, ',' ORDER BY category, ord) FILTER (sources = 0) AS unsupported,
    count(*) FILTER (in_title AND category = 'mandatory' AND ord <= 10) AS title_hits
  FROM competency c JOIN evidence e ON e.term = c.name GROUP BY jd_id, d),
rel_test AS (SELECT jd_id, d, avg(score) / 100.0::DOUBLE AS relevant_assessment FROM (
    SELECT DISTINCT jd_id, t.d, t.pos, t.score FROM tests t JOIN competency c ON category = 'mandatory' AND contains(lower(t.name), c.name))
  GROUP BY jd_id, d),
rel_months AS (SELECT jd_id, d, sum(months) AS relevant_months FROM (
    SELECT DISTINCT jd_id, k.d, k.pos, k.months FROM career k JOIN competency c ON category = 'mandatory' AND ord <= 10
      AND contains(lower(k.description), c.name)) GROUP BY jd_id, d),
word AS (SELECT jd_id, w, bool_or(ord <= 10) AS early FROM (
    SELECT jd_id, ord, unnest(regexp_split_to_array(name, '\\s+')) AS w FROM competency WHERE category = 'mandatory')
  WHERE w <> '' GROUP BY jd_id, w),
entry AS (SELECT d, pos, lower(title || ' ' || description) AS txt FROM career),
entry_hit AS (SELECT r.jd_id, e.d, e.pos, count(w) FILTER (early AND contains(txt, w)) AS early_hits,
    count(w) FILTER (length(w) > 2 AND contains(txt, w)) AS domain_hits
  FROM entry e CROSS JOIN raw r LEFT JOIN word USING (jd_id) GROUP BY r.jd_id, e.d, e.pos),
entry_avg AS (SELECT jd_id, d, coalesce(list_reduce(list(least(1.0, early_hits * 0.15::DOUBLE) ORDER BY pos) FILTER (pos <= 2), lambda a, b: a + b)
      / count(*) FILTER (pos <= 2), 0) AS recent,
    coalesce(list_reduce(list(least(1.0, early_hits * 0.15::DOUBLE) ORDER BY pos) FILTER (pos > 2), lambda a, b: a + b)
      / count(*) FILTER (pos > 2), 0) AS older,
    avg(least(1.0, domain_hits * 0.12::DOUBLE)) AS domain FROM entry_hit GROUP BY jd_id, d),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sims AS (SELECT r.jd_id, p.d, coalesce(list_cosine_similarity(a.v, j.v), 0) AS summary_sim,
    coalesce(list_cosine_similarity(list_reverse(a.v), j.v), 0) AS skills_sim,
    CASE WHEN a.v IS NULL THEN 0 ELSE coalesce(list_cosine_similarity(list_concat(a.v[2:], a.v[1:1]), j.v), 0) END AS career_sim,
    coalesce(-list_cosine_similarity(a.v, j.v), 0) AS headline_sim
  FROM raw r CROSS JOIN people p LEFT JOIN vec a ON a.vec_id = p.d LEFT JOIN vec j ON j.vec_id = r.jd_id),
pair0 AS (SELECT r.jd_id, p.d, p.candidate_id, p.name, p.title, p.years, n, n_req, coalesce(matched, 0) AS matched,
    CASE WHEN n = 0 THEN 0 ELSE coalesce(matched, 0)::DOUBLE / n END AS skills_ratio,
    coalesce(matched, 0)::DOUBLE / greatest(1, n_req) AS skill_coverage,
    CASE WHEN n = 0 THEN 0.5 ELSE {clip('coalesce(conf, 0) / n')} END AS evidence_score,
    CASE WHEN n = 0 THEN 0 ELSE coalesce(covered, 0)::DOUBLE / n END AS evidence_coverage,
    CASE WHEN n = 0 THEN 0 ELSE coalesce(sources, 0)::DOUBLE / n END AS evidence_density,
    coalesce(strong, 0) AS strong_count, coalesce(weak, 0) AS weak_count, coalesce(unsupported, '') AS unsupported,
    {clip('coalesce(title_hits, 0) * 0.15')} AS title_relevance,
    {clip(f"(SELECT count(*) FROM concept k WHERE k.jd_id = r.jd_id AND contains(lower(p.industry), lower(k.primary_term))) * 0.15")} AS industry_relevance,
    coalesce(relevant_assessment, 0) AS relevant_assessment, coalesce(relevant_months, 0) AS relevant_months,
    CASE WHEN n_jobs = 0 THEN 0.0 WHEN recent > older THEN {clip('0.5 + recent * 0.5')} ELSE {clip('0.3 + recent * 0.4')} END AS specialization,
    CASE WHEN n_jobs = 0 THEN 0.0 ELSE {clip('domain')} END AS domain,
    summary_sim, skills_sim, career_sim, headline_sim,
    (greatest(summary_sim, 0) + greatest(career_sim, 0) + greatest(skills_sim, 0) + greatest(headline_sim, 0))
      / greatest(1, (summary_sim > 0)::INT + (career_sim > 0)::INT + (skills_sim > 0)::INT + (headline_sim > 0)::INT) AS semantic,
    {clip("0.5 + CASE WHEN years BETWEEN coalesce(low, 0) AND max_years THEN 0.3 WHEN years >= coalesce(low, 0) * 0.8::DOUBLE THEN 0.15 ELSE 0 END + CASE WHEN (seniority_level = 'senior' AND " + seniority('p.title') + " >= 3) OR (seniority_level = 'mid' AND " + seniority('p.title') + " >= 2) THEN 0.2 ELSE 0 END")} AS hiring,
    {clip("0.5 + CASE WHEN role_mode = 'flexible' OR work_mode = 'flexible' THEN 0.25 WHEN role_mode = work_mode THEN 0.3 WHEN role_mode = 'remote' AND work_mode = 'hybrid' THEN 0.2 WHEN role_mode = 'hybrid' AND work_mode = 'remote' THEN 0.15 ELSE 0 END + CASE WHEN role_mode = 'onsite' AND relocates THEN 0.15 ELSE 0 END")} AS mode_fit,
    CASE WHEN years BETWEEN coalesce(low, 0) AND max_years THEN 0.15 WHEN years >= coalesce(low, 0) * 0.7::DOUBLE THEN 0.08 ELSE 0 END AS cheap_years,
    avg_proficiency, coalesce(assessment_avg, 0) AS assessment_avg, completeness, n_jobs, total_skills
  FROM raw r CROSS JOIN people p JOIN job_n USING (jd_id) JOIN experience USING (jd_id) JOIN career_f USING (d) JOIN skill_f USING (d)
  LEFT JOIN test_f USING (d) LEFT JOIN roll USING (jd_id, d) LEFT JOIN rel_test USING (jd_id, d)
  LEFT JOIN rel_months USING (jd_id, d) LEFT JOIN entry_avg USING (jd_id, d) JOIN sims USING (jd_id, d)),
pair1 AS (SELECT q.*, a.*, b.behavioral AS behave_score, b.availability,
    CASE WHEN n = 0 THEN 0.5 ELSE {clip('evidence_coverage * 0.5 + evidence_score * 0.5')} END AS evidence_alignment
  FROM pair0 q JOIN auth_f a USING (d) JOIN behave_f b USING (d)),
pair2 AS (SELECT *,
    {clip('skill_coverage * 0.25 + skills_ratio * 0.15 + cheap_years + title_relevance * 0.15 + assessment_avg * 0.10 + relevant_assessment * 0.10 + (completeness / 100.0::DOUBLE) * 0.05 + avg_proficiency * 0.05')} AS cheap_score,
    {clip('skill_coverage * 0.35 + skills_ratio * 0.25 + avg_proficiency * 0.15 + assessment_avg * 0.15 + title_relevance * 0.10')} AS technical_alignment,
    {clip('semantic')} AS semantic_relevance,
    {clip('evidence_score * 0.5 + evidence_coverage * 0.3 + evidence_density * 0.2::DOUBLE * 0.25')} AS evidence_strength,
    {clip(wavg(list(zip(('semantic_coherence', 'career_coherence', 'evidence_alignment', 'timeline', 'edu_align', 'support'), S.AUTHENTICITY_WEIGHTS))))} AS authenticity,
    CASE WHEN n_jobs = 0 THEN 0.3 ELSE {clip(wavg(list(zip(('progression', 'specialization', 'growth', 'domain'), S.NARRATIVE_WEIGHTS))))} END AS career_narrative,
    {clip('behave_score')} AS behavioral,
    {clip(wavg(list(zip(('availability', 'hiring', 'behave_score', 'mode_fit'), S.RECRUITABILITY_WEIGHTS))))} AS recruitability,
    CASE WHEN n_jobs = 0 THEN '' WHEN progression > 0.7 THEN 'ascending' WHEN progression > 0.5 THEN 'lateral'
      WHEN progression > 0.3 THEN 'mixed' ELSE 'declining' END AS direction
  FROM pair1),
scored AS (SELECT p.*, {clip('''(technical_alignment * w1 + semantic_relevance * w2 + evidence_strength * w3 + authenticity * w4
      + career_narrative * w5 + behavioral * w6 + recruitability * w7) / (w1 + w2 + w3 + w4 + w5 + w6 + w7)
    + CASE WHEN technical_alignment > 0.6 AND evidence_strength > 0.6 THEN 0.03 ELSE 0 END
    + CASE WHEN semantic_relevance > 0.5 AND career_narrative > 0.5 THEN 0.02 ELSE 0 END
    + CASE WHEN authenticity > 0.7 AND evidence_strength > 0.5 THEN 0.02 ELSE 0 END
    - CASE WHEN authenticity < 0.3 THEN 0.05 ELSE 0 END''')} AS score
  FROM pair2 p JOIN weights USING (jd_id))"""

CONCEPTS = "concept AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT jd_id, {i} AS o, {q(label)} AS primary_term, len(list_filter({items([t.lower() for t in terms])}, lambda w: contains(t, w))) AS found, {len(terms)} AS total FROM raw"
    for i, (label, terms) in enumerate(S.CONCEPT_CLUSTERS.items())) + ") WHERE found > 0)"


def people(*more: str) -> str:
    return "WITH " + ",".join([LINES, CAREER, SKILLS, PEOPLE, *more])


def features() -> str:
    return people(FEATURES)


def jobs(table: str, id_col: str, *more: str) -> str:
    return "WITH " + ",".join([jobs_cte(table, id_col), *more])


def pairs(*more: str) -> str:
    return people(FEATURES, jobs_cte("benchmark", "item_id"), competencies_cte(), JOB_FACTS, CONCEPTS,
                  EVIDENCE, PAIRS, *more)
