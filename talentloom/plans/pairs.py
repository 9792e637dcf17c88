"""Score every candidate against every job of a batch.

Layers, from cheap to dear:
1. ``candidate_facts``   once per candidate, job-free;
2. ``match_terms``       once per candidate, against the vocabulary of all jobs;
3. ``score_pairs``       per (job, candidate): sums over term ids and arithmetic.

The job side is broadcast: one row with the vocabulary for matching, and one row per
job for scoring. Its size is measured first; larger job sets are cut into bundles.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom import settings as S
from talentloom.functions import scalars as fx
from talentloom.operators import authenticity as au
from talentloom.operators import blocks as bl
from talentloom.operators import engagement as en
from talentloom.operators import evidence as ev
from talentloom.operators import features as fe
from talentloom.operators import fusion as fu
from talentloom.operators import narrative as na
from talentloom.operators import termindex as ti
from talentloom.operators import vectors as ve
from talentloom.plans.storage import shared_folder

MAX_BUNDLE_BYTES = 16 * 1024 * 1024
MAX_BUNDLE_TERMS = 8192
MAX_BUNDLE_JOBS = 1000  # a task holds a batch of candidates with a number a job
_FIRST_TERMS = 10

DIMENSION_COLUMNS = tuple(key for key, _, _ in S.DIMENSIONS)


_BEHAVIOR = ("engagement", "responsiveness", "activity", "recruiter_interest", "verification",
             "hiring_readiness", "profile_quality")


@fx.build_once
def _fact_columns(as_of: str) -> list:
    career, signals = F.col("career_history"), F.col("platform_signals")
    n_jobs = F.size("career_history")
    behavior = en.behavior_parts(signals, F.to_date(F.lit(as_of)))

    return [
        "candidate_id",
        F.col("profile.anonymized_name").alias("name"),
        F.col("profile.current_title").alias("title"),
        F.col("profile.years_of_experience").alias("years"),
        fx.seniority(F.col("profile.current_title")).alias("title_level"),
        (fx.company_size_level(F.col("profile.current_company_size")) / 8.0).alias("company_size"),
        signals["preferred_work_mode"].alias("work_mode"),
        signals["willing_to_relocate"].alias("relocates"),
        signals["profile_completeness_score"].alias("completeness"),
        signals["recruiter_response_rate"].alias("response_rate"),
        fe.skill_aggregates(F.col("skills"), F.col("assessments"), F.col("certifications")).alias("skill"),
        fe.career_aggregates(career, F.col("months"), F.col("sizes")).alias("career"),
        fe.education_aggregates(F.col("education")).alias("edu"),
        n_jobs.alias("n_jobs"),
        au.semantic_coherence(F.col("title_lc"), F.col("headline_lc"), F.col("summary_lc"), career)
        .alias("semantic_coherence"),
        au.career_coherence(career).alias("career_coherence"),
        au.education_alignment(F.col("education"), F.col("title_lc")).alias("education_alignment"),
        au.profile_support(F.col("profile.summary"), career, F.col("skills"), F.col("education"),
                           F.col("certifications")).alias("profile_support"),
        F.when(n_jobs > 0, na.progression(F.col("levels"))).otherwise(0.0).alias("progression"),
        F.when(n_jobs > 0, na.growth(F.col("sizes"), F.col("levels"))).otherwise(0.0).alias("growth"),
        *[value.alias(name) for name, value in behavior.items()],
        en.availability(signals).alias("availability"),
        F.xxhash64("profile", "career_history", "education", "skills", "certifications", "languages",
                   F.to_json("platform_signals")).alias("row_hash"),
        "industry_lc", "title_lc", "headline_lc", "summary_lc", "skill_facts", "certs_lc",
        "descriptions_lc", "entries_lc", "career_lc", "skill_names_lc", "skills_text", "tests_text",
        "entries_text", "assessments", "months", "vectors",
    ]


@fx.build_once
def _derived_facts() -> list[Column]:
    mismatch = au.timeline_mismatch(F.col("years"), F.col("career.total_career_months"), F.col("n_jobs"))
    return [
        en.behavioral([F.col(name) for name in _BEHAVIOR]).alias("behavioral_score"),
        mismatch.alias("timeline_mismatch"),
        au.timeline_consistency(F.col("n_jobs"), mismatch).alias("timeline_consistency"),
        na.direction(F.col("progression"), F.col("n_jobs")).alias("direction"),
    ]


def candidate_facts(candidates: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Job-free features and scores of every candidate, plus the matching helpers.

    An optional ``vectors`` column (unit vectors of summary, career, skills and
    headline, NULL where absent) feeds the semantic score.
    """
    if "vectors" not in candidates.columns:
        candidates = candidates.withColumn("vectors", F.lit(None).cast("array<array<double>>"))
    facts = fe.prepare(candidates).select(*_fact_columns(str(as_of)))
    return facts.select("*", *_derived_facts())


# -- job side ---------------------------------------------------------------------

def job_views(profiles: DataFrame) -> DataFrame:
    """What scoring needs of each hiring profile. Optional column: ``vector`` (unit)."""
    if "vector" not in profiles.columns:
        profiles = profiles.withColumn("vector", F.lit(None).cast("array<double>"))
    return profiles.select(*_view_columns())


@fx.build_once
def _view_columns() -> list:
    names = lambda column: F.transform(column, lambda c: F.lower(c["name"]))
    return [
        "jd_id",
        names("required").alias("required"),
        names("preferred").alias("preferred"),
        F.transform("concepts", lambda c: F.lower(c["primary_term"])).alias("concepts"),
        F.col("experience"), F.col("role.work_mode").alias("role_mode"), F.col("weights"), "vector",
    ]


def _words_of(names: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(names, fx.words)))


@fx.build_once
def _bundle_parts(view_columns: tuple[str, ...]) -> list[Column]:
    return [
        F.collect_list(F.struct(*view_columns)).alias("jobs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("required", "preferred")))))
        .alias("terms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(_words_of(F.col("required"))))))
        .alias("words"),
    ]


@fx.build_once
def _indexed_jobs() -> Column:
    def ids(names: Column, vocabulary: str) -> Column:
        return F.transform(names, lambda n: (F.array_position(F.col(vocabulary), n) - 1).cast("int"))

    def words_mask(names: Column) -> Column:
        return fx.let(ids(names, "words"), lambda found: ev.mask(found, F.col("word_chunks")))

    def indexed(j: Column) -> Column:
        first = F.slice(j["required"], 1, _FIRST_TERMS)
        everything = F.concat(j["required"], j["preferred"])
        long_words = F.filter(_words_of(j["required"]), lambda w: F.length(w) > 2)
        term_mask = lambda names: fx.let(
            ids(names, "terms"), lambda found: ev.mask(found, F.col("term_chunks")))
        return F.struct(
            j["jd_id"].alias("jd_id"),
            F.size(j["required"]).alias("n_required"), F.size(everything).alias("n_competencies"),
            ids(everything, "terms").alias("term_ids"), ids(j["required"], "terms").alias("required_ids"),
            ids(first, "terms").alias("first_ids"),
            term_mask(everything).alias("all_mask"), term_mask(first).alias("first_mask"),
            words_mask(_words_of(first)).alias("first_words"), words_mask(long_words).alias("domain_words"),
            *[j[c].alias(c) for c in ("concepts", "experience", "role_mode", "weights", "vector")],
        )

    return F.transform("jobs", indexed).alias("jobs")


def job_bundle(views: DataFrame) -> DataFrame:
    """All jobs of a bounded batch as one row: vocabulary, target words, jobs with masks."""
    merged = views.agg(*_bundle_parts(tuple(views.columns))).select(
        "*", ev.chunks(F.size("terms")).alias("term_chunks"), ev.chunks(F.size("words")).alias("word_chunks"))
    return merged.select("terms", "words", "term_chunks", "word_chunks", _indexed_jobs())


@dataclass(frozen=True)
class Bundle:
    """A vocabulary row, the jobs as rows, and the mask widths their expressions unroll to."""

    row: DataFrame
    jobs: DataFrame
    term_chunks: int
    word_chunks: int
    matrix: bl.JobMatrix
    terms: list[str]
    words: list[str]


def job_bundles(profiles: DataFrame, max_bytes: int = MAX_BUNDLE_BYTES,
                max_terms: int = MAX_BUNDLE_TERMS) -> list[Bundle]:
    """Bundles of jobs within ``max_bytes`` and ``max_terms`` each.

    The jobs are analysed once, into a table below the shared folder, and measured
    there; as many bundles as needed are cut by a hash of the job id. Each is then
    small enough to fetch and re-attach as a local row.
    """
    path = shared_folder(profiles.sparkSession, "job-views")
    made = job_views(profiles)
    made.write.parquet(path)
    views = profiles.sparkSession.read.schema(made.schema).parquet(path)
    size = F.octet_length(F.to_json(F.struct(*views.columns)))
    measured = views.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("jobs"),
        F.coalesce(F.sum(F.size("required") + F.size("preferred")), F.lit(0)).alias("terms")).first()
    parts = max(1, math.ceil(measured["bytes"] / max_bytes), math.ceil(measured["terms"] / max_terms),
                math.ceil(measured["jobs"] / MAX_BUNDLE_JOBS))
    slot = F.pmod(F.xxhash64("jd_id"), F.lit(parts))
    bundles = []
    for i in range(parts):
        bundle = job_bundle(views if parts == 1 else views.where(slot == i))
        row = bundle.first()
        session, kinds = profiles.sparkSession, {f.name: f.dataType for f in bundle.schema}
        words = ["terms", "words", "term_chunks", "word_chunks"]
        local = session.createDataFrame([tuple(row[c] for c in words)],
                                        T.StructType([T.StructField(c, kinds[c]) for c in words]))
        jobs = session.createDataFrame(list(enumerate(row["jobs"])), T.StructType([
            T.StructField("pos", T.IntegerType()), T.StructField("job", kinds["jobs"].elementType)]))
        bundles.append(Bundle(local, jobs, row["term_chunks"], row["word_chunks"], bl.job_matrix(row["jobs"]),
                              row["terms"], row["words"]))
    return bundles


# -- candidate x job -------------------------------------------------------------------

_MATCH_HELPERS = (
    "title_lc", "headline_lc", "summary_lc", "skill_facts", "certs_lc", "descriptions_lc", "entries_lc",
    "career_lc", "skill_names_lc", "skills_text", "tests_text", "entries_text", "words",
    "term_chunks", "word_chunks",
)
_PAIR_HELPERS = ("evidence", "masks", "entry_masks", "vectors", "industry_lc", "assessments",
                 "months", "terms")


def match_terms(facts: DataFrame, bundle: Bundle) -> DataFrame:
    """Add evidence per vocabulary term and target-word masks per career entry.

    The bundle is one row of measured size, so attaching it moves no candidate.
    """
    joined = facts.withColumn("_found", ti.lookups(bundle.terms, bundle.words)).join(F.broadcast(bundle.row), F.lit(True))
    kept = [c for c in joined.columns if c not in (*_MATCH_HELPERS, "_found")]
    matched = joined.select(*kept, "term_chunks", _evidence_column(), F.col("_found.entries").alias("entry_masks"))
    return matched.select(*kept, "evidence", "entry_masks", _mask_column())


@fx.build_once
def _evidence_column() -> Column:
    return ev.term_evidence(F.col("terms"), F.col("_found.traces")).alias("evidence")


@fx.build_once
def _mask_column() -> Column:
    return ev.term_masks(F.col("evidence"), F.col("term_chunks")).alias("masks")


@fx.build_once
def _pair_columns(term_chunks: int, word_chunks: int, measured: bool) -> list[Column]:
    job, masks, n = F.col("job"), F.col("masks"), F.col("job.n_competencies")
    picked = lambda ids: ev.pick(F.col("evidence"), job[ids])
    if measured:
        at = lambda name: F.get(F.col(name), F.col("pos"))
        title_hits, rollup = at("_sums.in_title"), ev.rolled({s: at(f"_sums.{s}") for s in (
            "confidence", "sources", "covered", "strong", "firm", "matched")}, n)
        months, assessment = at("_marks.months"), at("_marks.assessment")
        unsupported = F.transform(at("_open"), lambda i: F.get(F.col("terms"), i))
        first_hits, domain_hits = at("_hits.first"), at("_hits.domain")
        first_means = F.struct(*[at(f"_means.{s}").alias(s) for s in ("recent", "older")])
        domain_mean = at("_means.domain")
        sim = F.struct(*[at(f"_sims.{name}").alias(f"{name}_similarity") for name in ve.PASSAGES])
    else:
        title_hits = ev.common(masks["in_title"], job["first_mask"], term_chunks)
        rollup = ev.rollup(masks, job["all_mask"], n, term_chunks)
        months = ev.relevant_months(F.col("months"), picked("first_ids"))
        assessment = ev.relevant_assessment(F.col("assessments"), picked("required_ids"))
        unsupported = ev.unsupported(F.col("terms"), picked("term_ids"), job["term_ids"])
        first_hits = ev.hits_per_entry(F.col("entry_masks"), job["first_words"], word_chunks)
        domain_hits = ev.hits_per_entry(F.col("entry_masks"), job["domain_words"], word_chunks)
        first_means, domain_mean = na.recent_and_older(first_hits), na.domain_mean(domain_hits)
        sim = ve.semantic_scores(F.col("vectors"), job["vector"])
    concept_hits = F.size(F.filter(job["concepts"], lambda c: F.contains(F.col("industry_lc"), c)))
    columns = {
        "jd_id": job["jd_id"], "n_required": job["n_required"], "n_competencies": n,
        **rollup,
        "title_relevance": fx.clip(title_hits * 0.15),
        "industry_relevance": fx.clip(concept_hits * 0.15),
        "relevant_months": months,
        "relevant_assessment": F.when(F.col("skill.total_skills") > 0, assessment).otherwise(0.0),
        "evidence_rows": picked("term_ids"), "term_names": ev.named(F.col("terms"), job["term_ids"]),
        "unsupported_terms": unsupported, "first_hits": first_hits, "domain_hits": domain_hits,
        "first_means": first_means, "domain_mean": domain_mean, "sim": sim,
        "experience": job["experience"], "role_mode": job["role_mode"], "weights": job["weights"],
    }
    return [value.alias(name) for name, value in columns.items()]


def pair_rows(matched: DataFrame, bundle: Bundle) -> DataFrame:
    """One row per (job, candidate) with the job-dependent features; of rows that name a job's position, only that job's.

    Every feature is a column of its own: what a caller does not select is pruned.
    """
    kept = [c for c in matched.columns if c not in (*_PAIR_HELPERS, *bl.MEASURES, "pos")]
    pairs = matched.join(F.broadcast(bundle.jobs), "pos" if "pos" in matched.columns else F.lit(True))
    return pairs.select(*kept, *_pair_columns(bundle.term_chunks, bundle.word_chunks, "_sums" in matched.columns))


@fx.build_once
def _sub_scores() -> list[Column]:
    n_jobs, n = F.col("n_jobs"), F.col("n_competencies")
    return [
        fx.safe_divide(F.col("matched_count"), n).alias("skills_ratio"),
        (F.col("matched_count") / F.greatest(F.lit(1), F.col("n_required"))).alias("skill_coverage"),
        F.when(n_jobs > 0, na.specialization(F.col("first_means.recent"), F.col("first_means.older"))).otherwise(0.0).alias("specialization"),
        F.when(n_jobs > 0, na.domain_alignment(F.col("domain_mean"))).otherwise(0.0).alias("domain"),
        au.evidence_alignment(n, F.col("evidence_coverage"), F.col("evidence_score"))
        .alias("evidence_alignment"),
        en.hiring_compatibility(F.col("years"), F.col("title_level"), F.col("experience"))
        .alias("hiring_compatibility"),
        en.work_mode_compatibility(F.col("role_mode"), F.col("work_mode"), F.col("relocates"))
        .alias("mode_compatibility"),
        ve.mean_positive([F.col(f"sim.{n}_similarity") for n in ve.PASSAGES]).alias("semantic_score"),
    ]


@fx.build_once
def _fused_scores() -> list[Column]:
    n_jobs = F.col("n_jobs")
    return [
        fu.cheap_score({
            "years": F.col("years"), "min_years": F.col("experience.min_years"),
            "max_years": F.col("experience.max_years"), "skill_coverage": F.col("skill_coverage"),
            "skills_ratio": F.col("skills_ratio"), "title_relevance": F.col("title_relevance"),
            "assessment_avg": F.col("skill.assessment_score_avg"),
            "relevant_assessment": F.col("relevant_assessment"),
            "completeness": F.col("completeness"), "proficiency": F.col("skill.avg_proficiency"),
        }).alias("cheap_score"),
        fu.fused_technical(F.col("skill_coverage"), F.col("skills_ratio"), F.col("skill.avg_proficiency"),
                           F.col("skill.assessment_score_avg"), F.col("title_relevance"))
        .alias("technical_alignment"),
        fx.clip(F.col("semantic_score")).alias("semantic_relevance"),
        fu.fused_evidence(F.col("evidence_score"), F.col("evidence_coverage"), F.col("evidence_density"))
        .alias("evidence_strength"),
        fx.clip(au.authenticity([F.col(c) for c in (
            "semantic_coherence", "career_coherence", "evidence_alignment", "timeline_consistency",
            "education_alignment", "profile_support")])).alias("authenticity"),
        fx.clip(na.narrative(n_jobs, [F.col(c) for c in (
            "progression", "specialization", "growth", "domain")])).alias("career_narrative"),
        fx.clip(F.col("behavioral_score")).alias("behavioral"),
        fx.clip(en.recruitability([F.col(c) for c in (
            "availability", "hiring_compatibility", "behavioral_score", "mode_compatibility")]))
        .alias("recruitability"),
    ]


@fx.build_once
def _final_score() -> Column:
    dims = {key: F.col(key) for key in DIMENSION_COLUMNS}
    return fu.final_score(dims, F.col("weights")).alias("score")


def score_rows(pairs: DataFrame, apart: bool = False) -> DataFrame:
    """Sub-scores, the seven dimensions, the cheap score and the final score; with ``apart`` each step as code of its own, for many pairs."""
    end = fx.step if apart else lambda rows: rows
    for columns in ([], _sub_scores(), _fused_scores(), [_final_score()]):
        pairs = end(pairs.select("*", *columns))
    return pairs


def score_bundle(facts: DataFrame, bundle: Bundle, k: int | None = None) -> DataFrame:
    """All pairs of the bundle, or with ``k`` those that may be among the k best candidates of their job."""
    matched = match_terms(facts, bundle)
    rows = bl.measured(matched, bundle.matrix) if k is None else bl.open_pairs(matched, bundle.matrix, k)
    return score_rows(pair_rows(rows, bundle), apart=k is None)


def score_pairs(candidates: DataFrame, profiles: DataFrame, as_of: dt.date | str,
                max_bytes: int = MAX_BUNDLE_BYTES, k: int | None = None) -> DataFrame:
    """Every candidate against every job, with all features and scores; with ``k`` only pairs that may be among a job's k best
    candidates, which is enough for the top k and leaves the rest unscored."""
    facts = candidate_facts(candidates, as_of)
    scored = None
    for bundle in job_bundles(profiles, max_bytes):
        part = score_bundle(facts, bundle, k)
        scored = part if scored is None else scored.unionByName(part)
    return scored
