"""Term matching: which job terms a candidate's record supports, and how well.

Evidence depends on (candidate, term), not on the job. The terms of all jobs
form one vocabulary, every candidate is matched against it once, and a job
only sums over its term ids. An index of the vocabulary finds the terms to
test, so a candidate costs as much as its texts and hits, not as the vocabulary.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions import scalars as fx
from talentloom.operators import termindex as ti


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def term_evidence(terms: Column, traces: Column) -> Column:
    """Evidence structs of the terms with any trace in the record, in term order.

    ``traces`` (``termindex.lookups``) tell the 0-based positions, ascending, of these terms and the places of
    their traces; no text is searched here. Terms without a trace have source count 0 and confidence 0 and are
    left out, so the array stays short whatever the size of the vocabulary. Reads the helper columns of
    ``features.prepare``.
    """
    skills, assessments = F.col("skill_facts"), F.col("assessments")

    def raw(t: Column) -> Column:
        def marked(bit: int) -> Column:  # NULL where the place is missing
            known = t["marks"].bitwiseAND(F.lit(bit << ti.UNKNOWN)) == 0
            return F.when(known, t["marks"].bitwiseAND(F.lit(bit)) != 0)

        return F.struct(
            F.get(terms, t["id"]).alias("term"), t["id"].alias("id"), F.get(skills, t["skill"]).alias("skill"),
            t["tested"].alias("tested"), marked(ti.WITHIN).alias("within"),
            (marked(ti.IN_SUMMARY) | marked(ti.IN_HEADLINE)).alias("in_summary"),
            marked(ti.IN_CAREER).alias("in_career"), marked(ti.IN_CERTIFICATIONS).alias("in_certifications"),
            marked(ti.IN_TITLE).alias("in_title"), t["jobs"].alias("jobs"),
        )

    def measured(r: Column) -> Column:
        first = F.get(assessments, F.get(r["tested"], F.lit(0)))
        score = F.coalesce(first["score"], F.lit(0.0))
        in_skills = r["skill"].isNotNull()
        return F.struct(
            r["term"].alias("term"), r["id"].alias("id"), in_skills.alias("in_skills"),
            r["in_summary"].alias("in_summary"), r["in_career"].alias("in_career"),
            r["in_certifications"].alias("in_certifications"), r["in_title"].alias("in_title"),
            (in_skills | r["within"]).alias("matched"), r["jobs"].alias("jobs"), r["tested"].alias("tested"),
            score.alias("assessment_score"),
            F.coalesce(r["skill"]["duration_months"], F.lit(0)).alias("skill_months"),
            F.coalesce(r["skill"]["endorsements"], F.lit(0)).alias("endorsements"),
            F.size(r["jobs"]).alias("career_mentions"),
            (_flag(in_skills) + _flag(r["in_summary"]) + _flag(r["in_career"])
             + _flag(r["in_certifications"]) + _flag(score > 0)).alias("source_count"),
        )

    def judged(m: Column) -> Column:
        confidence = fx.clip(
            F.least(F.lit(1.0), m["source_count"] * 0.25)
            + F.when(m["assessment_score"] > 60, 0.15).otherwise(0.0)
            + F.when(m["skill_months"] > 24, 0.10).otherwise(0.0)
            + F.when(m["endorsements"] > 10, 0.05).otherwise(0.0)
            + F.when(m["career_mentions"] > 1, 0.10).otherwise(0.0))
        return F.struct(*[m[f].alias(f) for f in _FIELDS], confidence.alias("confidence"))

    return F.transform(F.transform(F.transform(traces, raw), measured), judged)


_FIELDS = ("term", "id", "in_skills", "in_summary", "in_career", "in_certifications", "in_title",
           "matched", "jobs", "tested", "assessment_score", "skill_months", "endorsements",
           "career_mentions", "source_count")


# -- bit masks: sets of term or word ids as arrays of 64-bit words -----------------------
# A job's sums over its terms become popcounts of (candidate mask AND job mask),
# which whole-stage codegen compiles, instead of interpreted array loops per pair.

BITS = 64


def chunks(count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / BITS).cast("int"))


def mask(ids: Column, n_chunks: Column) -> Column:
    """Ids (0-based ints) as an array of n_chunks longs."""
    def chunk(found: Column, c: Column) -> Column:
        mine = F.filter(found, lambda i: F.call_function("shiftright", i, F.lit(6)) == c)
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % BITS).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(i)))
    return fx.let(ids, lambda found: F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda c: chunk(found, c)))


def common(a: Column, b: Column, n_chunks: int) -> Column:
    """Number of ids in both masks."""
    total = F.lit(0)
    for c in range(n_chunks):
        total = total + F.bit_count(F.get(a, F.lit(c)).bitwiseAND(F.get(b, F.lit(c))))
    return total


def term_masks(evidence: Column, n_chunks: Column) -> Column:
    """Masks of the terms by property.

    Source counts (0-5) and confidences (multiples of 0.05, so 0-20 steps) are
    kept as bit planes: a sum over terms is the weighted sum of plane popcounts.
    """
    def where(test) -> Column:
        return mask(F.transform(F.filter(evidence, test), lambda e: e["id"]), n_chunks)

    def planes(value, bits: int) -> Column:
        return F.array(*[where(_bit_test(value, k)) for k in range(bits)])

    return F.struct(
        where(lambda e: e["matched"]).alias("matched"),
        where(lambda e: e["in_title"]).alias("in_title"),
        where(lambda e: e["source_count"] > 0).alias("covered"),
        where(lambda e: e["confidence"] > 0.6).alias("strong"),
        where(lambda e: e["confidence"] >= 0.3).alias("firm"),
        planes(lambda e: e["source_count"], 3).alias("sources"),
        planes(lambda e: F.round(e["confidence"] * 20).cast("int"), 5).alias("confidence"),
    )


def _bit_test(value, k: int):
    return lambda e: F.call_function("shiftright", value(e), F.lit(k)) % 2 == 1


# -- per job --------------------------------------------------------------------------

def rollup(masks: Column, wanted: Column, n: Column, n_chunks: int) -> dict[str, Column]:
    """Evidence over the n terms of one job; 0.5 and zeros when it has none."""
    def count(name: str) -> Column:
        return common(masks[name], wanted, n_chunks)

    def weighted(name: str, bits: int) -> Column:
        total = F.lit(0)
        for k in range(bits):
            total = total + common(F.get(masks[name], F.lit(k)), wanted, n_chunks) * (1 << k)
        return total

    return rolled({"confidence": weighted("confidence", 5), "sources": weighted("sources", 3),
                   **{name: count(name) for name in ("covered", "strong", "firm", "matched")}}, n)


def rolled(sums: Mapping[str, Column], n: Column) -> dict[str, Column]:
    """The rollup from a job's sums by property."""
    has = n > 0
    return {
        "evidence_score": F.when(has, fx.clip(sums["confidence"] / 20.0 / n)).otherwise(0.5),
        "evidence_coverage": F.when(has, sums["covered"] / n).otherwise(0.0),
        "evidence_density": F.when(has, sums["sources"] / n).otherwise(0.0),
        "strong_count": sums["strong"],
        "weak_count": n - sums["firm"],
        "matched_count": sums["matched"],
    }


def hits_per_entry(entries: Column, wanted: Column, n_chunks: int) -> Column:
    """Per career entry, how many of a job's target words it contains."""
    return F.transform(entries, lambda e: common(e, wanted, n_chunks))


def pick(evidence: Column, ids: Column) -> Column:
    """The traced terms of one job."""
    return F.filter(evidence, lambda e: F.array_contains(ids, e["id"]))


def named(terms: Column, ids: Column) -> Column:
    """Names of the terms with the given ids."""
    return F.transform(ids, lambda i: F.get(terms, i))


def detail_rows(pairs: DataFrame) -> DataFrame:
    """One row per (job, candidate, competency) of ``pairs`` with ``term_names`` and ``evidence_rows``.

    A competency without a trace in the record gets a row of zeros.
    """
    both = F.transform("term_names", lambda t: F.struct(
        t.alias("term"), F.get(F.filter("evidence_rows", lambda e: e["term"] == t), F.lit(0)).alias("e")))
    rows = fx.element_rows(pairs.withColumn("_all", both), "_all", "jd_id", "candidate_id")
    e = F.col("element.e")
    flags = [F.coalesce(e[f], F.lit(False)).alias(f) for f in ("in_skills", "in_summary", "in_career", "in_certifications")]
    counts = [F.coalesce(e[f], F.lit(0)).alias(f) for f in ("skill_months", "endorsements", "career_mentions", "source_count")]
    scores = [F.coalesce(e[f], F.lit(0.0)).alias(f) for f in ("assessment_score", "confidence")]
    return rows.select("jd_id", "candidate_id", F.col("element.term").alias("term"), *flags, *scores, *counts)


def unsupported(terms: Column, picked: Column, ids: Column) -> Column:
    """Names of a job's terms without any source, in the job's order."""
    backed = F.transform(F.filter(picked, lambda e: e["source_count"] > 0), lambda e: e["id"])
    return F.transform(F.array_except(ids, backed), lambda i: F.get(terms, i))


def relevant_months(months: Column, picked_top: Column) -> Column:
    """Months of the entries whose description mentions any of the given terms."""
    entries = F.array_distinct(F.flatten(F.transform(picked_top, lambda e: e["jobs"])))
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(months, i))


def relevant_assessment(assessments: Column, picked_required: Column) -> Column:
    """Mean of the assessments whose name contains any required term, over 100."""
    tests = F.array_distinct(F.flatten(F.transform(picked_required, lambda e: e["tested"])))
    return fx.mean_of(F.transform(F.array_sort(tests), lambda i: F.get(assessments, i)["score"])) / 100.0
