"""Job-description operators: text of one job row to its hiring profile.

Each function is a Column builder over ``raw_text`` (lower-cased once as
``text_lc``) and ``sections``. A job is one row, so nothing here shuffles:
mentions, classification and ranking are array work inside the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx


def _any_match(text: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(pattern)
    return hit


def _any_word(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def competency_mentions(text_lc: Column, patterns: Sequence[str] = S.COMPETENCY_PATTERNS) -> Column:
    """Distinct trimmed matches of every pattern, longer than one character."""
    found = F.flatten(F.array(*[
        F.regexp_extract_all(text_lc, F.lit(f"(?i){p}"), F.lit(0)) for p in patterns]))
    trimmed = F.transform(found, lambda s: F.trim(s))
    return F.array_distinct(F.filter(trimmed, lambda s: F.length(s) > 1))


def section_hints(sections: Column) -> Column:
    """Per section: does it make a skill in it required, or preferred?"""
    def hints(section: Column) -> Column:
        name, text = F.lower(section["name"]), F.lower(section["text"])
        named_required = _any_word(name, S.REQUIRED_SECTION_WORDS)
        named_preferred = ~named_required & _any_word(name, S.PREFERRED_SECTION_WORDS)
        unnamed = ~named_required & ~named_preferred
        return F.struct(
            section["name"].alias("name"), text.alias("text_lc"),
            (named_required | (unnamed & _any_match(text, S.REQUIREMENT_PATTERNS))).alias("required"),
            (named_preferred | (unnamed & _any_match(text, S.PREFERRED_PATTERNS))).alias("preferred"),
        )
    return F.transform(sections, hints)


def classify_competencies(text_lc: Column, mentions: Column, hints: Column) -> Column:
    """Competency structs, most important first, ties by name.

    Required beats preferred; a skill in no section, or without any hint, is required.
    """
    def describe(skill: Column) -> Column:
        found = F.struct(F.filter(hints, lambda s: F.contains(s["text_lc"], skill)).alias("hits"),
                         fx.count_occurrences(text_lc, skill, ignore_case=False).alias("freq"))
        return fx.let(found, lambda f: judge(skill, f["hits"], f["freq"]))

    def judge(skill: Column, hits: Column, freq: Column) -> Column:
        required = F.exists(hits, lambda s: s["required"]) | ~F.exists(hits, lambda s: s["preferred"])
        return F.struct(
            (-F.least(F.lit(1.0), freq * 0.15)).alias("order"),
            skill.alias("name"),
            F.when(required, "mandatory").otherwise("preferred").alias("category"),
            F.least(F.lit(1.0), freq * 0.15).alias("importance"),
            freq.alias("freq"),
            F.coalesce(F.try_element_at(hits, F.lit(-1))["name"], F.lit("")).alias("section_source"),
        )
    return F.array_sort(F.transform(mentions, describe))


def competency_priorities(competencies: Column) -> Column:
    """Shares that sum to 1; mandatory skills weigh half as much again."""
    def raw(c: Column) -> Column:
        weight = F.when(c["category"] == "mandatory", 1.5).otherwise(1.0)
        return F.greatest(F.lit(0.1), F.least(F.lit(1.0), c["freq"] * 0.1 * weight))

    def shares(all_: Column) -> Column:
        weighed = F.transform(all_, lambda c: F.struct(c["name"].alias("name"), raw(c).alias("raw")))
        return fx.let(weighed, lambda w: fx.let(fx.sum_of(F.transform(w, lambda c: c["raw"])), lambda total: F.transform(
            w, lambda c: F.struct(c["name"].alias("name"), (c["raw"] / total).alias("priority")))))

    return fx.let(competencies, shares)


def concepts(text_lc: Column, clusters: Mapping[str, Sequence[str]] = S.CONCEPT_CLUSTERS) -> Column:
    """Concept clusters with at least one term in the text, largest share first."""
    rows = []
    for order, (label, terms) in enumerate(clusters.items()):
        found = F.array_compact(F.array(*[
            F.when(text_lc.contains(t.lower()), F.lit(t)) for t in terms]))
        share = F.least(F.lit(1.0), F.size(found) / len(terms))
        rows.append(F.struct((-share).alias("order"), F.lit(order).alias("ord"),
                             F.lit(label).alias("primary_term"), found.alias("related_terms"),
                             share.alias("importance")))
    kept = F.array_sort(F.filter(F.array(*rows), lambda c: c["importance"] > 0))
    return F.transform(kept, lambda c: F.struct(c["primary_term"], c["related_terms"], c["importance"]))


def philosophy(text_lc: Column, dimensions: Mapping[str, Sequence[str]] = S.PHILOSOPHY_PATTERNS) -> Column:
    """Dimensions with any pattern match; 0.15 per match, at most 1; strongest first."""
    rows = []
    for order, (label, patterns) in enumerate(dimensions.items()):
        hits = F.lit(0)
        for pattern in patterns:
            hits = hits + F.regexp_count(text_lc, F.lit(f"(?i){pattern}"))
        strength = F.least(F.lit(1.0), hits * 0.15)
        rows.append(F.struct((-strength).alias("order"), F.lit(order).alias("ord"),
                             F.lit(label).alias("dimension"), strength.alias("strength")))
    kept = F.array_sort(F.filter(F.array(*rows), lambda d: d["strength"] > 0))
    return F.transform(kept, lambda d: F.struct(d["dimension"], d["strength"]))


def strength_of(dimensions: Column, label: str) -> Column:
    hit = F.get(F.filter(dimensions, lambda d: d["dimension"] == label), F.lit(0))
    return F.coalesce(hit["strength"], F.lit(0.0))


def constraints(text_lc: Column) -> Column:
    """First years phrase, one row per work-mode word, and the production flag."""
    def row(name: str, value: Column, kind: str) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(kind).alias("constraint_type"))
    years = F.regexp_extract(text_lc, S.YEARS_CONSTRAINT_PATTERN, 0)
    rows = [F.when(years != "", row("experience_years", years, "requirement"))]
    rows += [F.when(text_lc.contains(term), row("work_mode", F.lit(term), "preference"))
             for term in S.WORK_MODE_TERMS]
    rows.append(F.when(text_lc.contains("production"),
                       row("production_experience", F.lit("required"), "requirement")))
    return F.array_compact(F.array(*rows))


def experience(raw_text: Column) -> Column:
    """Years range from the first pattern that occurs, and the seniority word."""
    low = high = None
    span, *singles = [f"(?i){p}" for p in S.YEARS_PATTERNS]
    has_span = raw_text.rlike(span)
    low = F.when(has_span, F.regexp_extract(raw_text, span, 1).try_cast("double"))
    high = F.when(has_span, F.regexp_extract(raw_text, span, 2).try_cast("double"))
    for pattern in singles:
        low = low.when(raw_text.rlike(pattern), F.regexp_extract(raw_text, pattern, 1).try_cast("double"))
    text_lc = F.lower(raw_text)
    level = (F.when(raw_text == "", "")
             .when(_any_word(text_lc, ("senior", "sr.")), "senior")
             .when(_any_word(text_lc, ("lead", "principal")), "lead")
             .when(_any_word(text_lc, ("junior", "entry")), "junior")
             .otherwise("mid"))
    return F.struct(
        F.coalesce(low, F.lit(0.0)).alias("min_years"),
        F.coalesce(high, F.lit(S.MAX_YEARS)).alias("max_years"),
        F.coalesce(F.when(has_span, (low + high) / 2), low + 2, F.lit(0.0)).alias("preferred_years"),
        level.alias("seniority_level"),
    )


def role(paragraphs: Column, text_lc: Column) -> Column:
    """Title from the first heading; work mode by first word found."""
    heading = F.get(F.filter(paragraphs, lambda p: p["is_heading"]), F.lit(0))
    mode = (F.when(text_lc.contains("remote"), "remote")
            .when(text_lc.contains("hybrid"), "hybrid")
            .when(_any_word(text_lc, ("onsite", "on-site")), "onsite")
            .otherwise("flexible"))
    return F.struct(F.coalesce(heading["text"], F.lit("")).alias("title"), mode.alias("work_mode"))


def behavior_expectations(text_lc: Column, terms: Mapping[str, Sequence[str]] = S.BEHAVIOR_TERMS) -> Column:
    return F.array_compact(F.array(*[
        F.when(_any_word(text_lc, words), F.lit(label)) for label, words in terms.items()]))


def disqualifiers(text_lc: Column, patterns: Sequence[str] = S.DISQUALIFIER_PATTERNS,
                  before: int = 20, after: int = 100) -> Column:
    """Text around every match, pattern by pattern.

    split() gives the gaps between the matches; running lengths give the offsets.
    """
    windows = []
    for pattern in patterns:
        matches = F.regexp_extract_all(text_lc, F.lit(pattern), F.lit(0))
        gaps = F.split(text_lc, pattern, -1)
        pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("match")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["pos"] + pair["gap"]
            end = begin + pair["match"]
            span = F.struct(begin.alias("s"), end.alias("e"))
            return F.struct(end.alias("pos"), F.array_append(acc["spans"], span).alias("spans"))

        spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
        windows.append(F.transform(spans, lambda w: F.trim(F.regexp_replace(
            text_lc.substr(F.greatest(w["s"] - before, F.lit(0)) + 1,
                           w["e"] + after - F.greatest(w["s"] - before, F.lit(0))),
            r"^\s+|\s+$", ""))))
    return F.concat(*windows)


def dimension_weights(dimensions: Column) -> Column:
    """Base weights, shifted by strong production or startup culture, normalised to 1."""
    production = strength_of(dimensions, "production_experience") > 0.5
    startup = strength_of(dimensions, "startup_adaptability") > 0.5
    extra = {
        "evidence_strength": F.when(production, 0.05).otherwise(0.0),
        "technical_alignment": F.when(production, 0.03).otherwise(0.0),
        "career_narrative": F.when(startup, 0.03).otherwise(0.0),
        "behavioral": F.when(startup, 0.02).otherwise(0.0),
    }
    raw = {key: (F.lit(base) + extra[key]) if key in extra else F.lit(base)
           for key, _, base in S.DIMENSIONS}
    total = None
    for value in raw.values():
        total = value if total is None else total + value
    return F.struct(*[(value / total).alias(key) for key, value in raw.items()])


@fx.build_once
def _found_columns(patterns: tuple[str, ...]) -> list[Column]:
    text_lc = F.col("text_lc")
    return [competency_mentions(text_lc, patterns).alias("mentions"),
            section_hints(F.col("sections")).alias("hints"), philosophy(text_lc).alias("philosophy")]


@fx.build_once
def _ranked_competencies() -> Column:
    return classify_competencies(F.col("text_lc"), F.col("mentions"), F.col("hints")).alias("competencies")


@fx.build_once
def _profile_columns() -> list:
    text_lc = F.col("text_lc")

    def of_category(category: str) -> Column:
        chosen = F.filter("competencies", lambda c: c["category"] == category)
        return F.transform(chosen, lambda c: F.struct(
            c["name"], c["category"], c["importance"], c["section_source"]))

    # Required first, then preferred, as the priority shares list them.
    ordered = F.concat(F.filter("competencies", lambda c: c["category"] == "mandatory"),
                       F.filter("competencies", lambda c: c["category"] == "preferred"))
    return [
        "jd_id", "raw_text", "sections",
        of_category("mandatory").alias("required"),
        of_category("preferred").alias("preferred"),
        concepts(text_lc).alias("concepts"),
        competency_priorities(ordered).alias("priorities"),
        constraints(text_lc).alias("constraints"),
        "philosophy",
        experience(F.col("raw_text")).alias("experience"),
        role(F.col("paragraphs"), text_lc).alias("role"),
        behavior_expectations(text_lc).alias("behavior_expectations"),
        disqualifiers(text_lc).alias("disqualifiers"),
        dimension_weights(F.col("philosophy")).alias("weights"),
    ]


def hiring_profiles(jobs: DataFrame, patterns: Sequence[str] = S.COMPETENCY_PATTERNS) -> DataFrame:
    """Structured job rows to hiring profiles, one row per job."""
    base = jobs.select("jd_id", "paragraphs", "sections", "raw_text",
                       F.lower("raw_text").alias("text_lc"))
    found = base.select("*", *_found_columns(tuple(patterns)))
    return found.select("*", _ranked_competencies()).select(*_profile_columns())


def competency_rows(profiles: DataFrame) -> DataFrame:
    """One row per (job, competency); ``ord`` counts within the category. One explode reads the profile once."""
    def numbered(column: str) -> Column:
        return F.transform(column, lambda c, i: F.struct((i + 1).alias("ord"), c.alias("c")))
    both = profiles.select("jd_id", F.concat(numbered("required"), numbered("preferred")).alias("all"))
    return fx.element_rows(both, "all", "jd_id").select("jd_id", "element.ord", "element.c.*")
