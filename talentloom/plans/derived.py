"""Candidates and job texts derived from the driver's tables.

A candidate is one document: its lines are jobs, its sentences are skills. A job
is one benchmark item put into a job-advert template. Both are row-local, so the
only shuffle is the aggregation of events per user and the join to documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx

AS_OF = "2024-01-31"
TITLES = ("Principal Engineer", "Senior Data Engineer", "Data Engineer", "Associate Analyst",
          "Intern", "Staff Engineer", "Director of Data", "Maintenance Lead")
INDUSTRIES = ("Software", "Retail Software", "Finance", "")
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert", "native")
DEGREES = ("B.Tech", "MBA", "M.Sc", "PhD", "Diploma")
FIELDS = ("Data Science", "History", "Mechanical Engineering", "Law")
SECTORS = {"en": "Software Engineering", "fr": "Data Engineering", "de": "Finance"}
MODES = ("remote", "hybrid", "onsite", "flexible")
HEADINGS = ("SENIOR DATA ENGINEER", "LEAD PLATFORM ENGINEER", "DATA ENGINEER")
PLACES = ("remote", "hybrid", "on-site", "anywhere")
PATTERNS = (r"thor", r"ering", r"er\s+th", r"an\w{2}e", r"blees", r"on\w?th", r"heed",
            r"production", r"that", r"st\s+\w\w\w")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Rebalance a scan with fewer splits than cores, as one small file gives.

    A scan of many files already has enough tasks and is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _choose(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options) + 1).cast("int"))


def signals_by_user(events: DataFrame) -> DataFrame:
    """Per user: event counts by type and the last active date (partial aggregation)."""
    def count(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind).cast("int")
    return events.groupBy("user_id").agg(
        count("view").alias("views"), count("signup").alias("applications"),
        count("click").alias("searches"), count("purchase").alias("saved"),
        F.count(F.lit(1)).cast("int").alias("n_events"), F.to_date(F.max("ts")).alias("last_seen"))


def _career(lines: Column) -> Column:
    def entry(line: Column, i: Column) -> Column:
        n = F.length(line)
        blanks = n - F.length(F.replace(line, F.lit(" "), F.lit("")))
        months = F.lit(1) + n % 36
        start = F.date_sub(F.lit("2023-12-01").cast("date"), (i + 1) * 180 + n % 90)
        return F.struct(
            F.concat(F.lit("Company "), (n % 97).cast("string")).alias("company"),
            _choose(TITLES, n).alias("title"),
            start.cast("string").alias("start_date"),
            F.when(i > 0, F.date_add(start, months * 30).cast("string")).alias("end_date"),
            months.alias("duration_months"), (i == 0).alias("is_current"),
            _choose(INDUSTRIES, blanks).alias("industry"),
            _choose(S.COMPANY_SIZES + ("",), blanks).alias("company_size"),
            F.when(n % 7 == 0, "").otherwise(line).alias("description"),
        )
    return F.transform(lines, entry)


def _skills(pieces: Column) -> Column:
    def skill(piece: Column) -> Column:
        n = F.length(piece)
        return F.struct(
            F.lower(F.regexp_extract(piece, "[A-Za-z]+", 0)).alias("name"),
            _choose(PROFICIENCIES, n).alias("proficiency"),
            (n % 17).alias("endorsements"), (n % 60).alias("duration_months"))
    return F.filter(F.transform(pieces, skill), lambda s: s["name"] != "")


@fx.build_once
def _document_columns() -> list:
    lines = F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")
    pieces = F.filter(F.split("text", r"\. "), lambda t: F.trim(t) != "")
    return ["doc_id", "lang", "source", "n_chars", "views", "applications", "searches", "saved",
            "n_events", "last_seen", lines.alias("lines"), _career(lines).alias("career_history"),
            _skills(pieces).alias("skills")]


@fx.build_once
def _candidate_columns() -> list:
    d = F.col("doc_id")
    first = F.get("career_history", F.lit(0))
    entries = F.when(d % 3 > 0, F.sequence(F.lit(0), (d % 3 - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    sector = F.lit("")
    for lang, name in SECTORS.items():
        sector = F.when(F.col("lang") == lang, name).otherwise(sector)
    tested = F.filter(F.transform("skills", lambda s, i: F.struct(
        F.concat(s["name"], F.lit(" test "), (i + 1).cast("string")).alias("name"),
        ((s["duration_months"] * 7 + s["endorsements"]) % 101).cast("double").alias("score"),
        s["endorsements"].alias("e"))), lambda t: t["e"] % 3 == 0)
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).alias
    return [
        F.concat(F.lit("CAND_"), F.format_string("%012d", d)).alias("candidate_id"),
        F.struct(
            F.concat(F.lit("Candidate "), d.cast("string")).alias("anonymized_name"),
            F.when(d % 10 == 9, "").otherwise(F.concat_ws(
                " | ", first["title"], F.col("source"))).alias("headline"),
            F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("summary"),
            F.col("source").alias("location"), F.col("lang").alias("country"),
            ((F.col("n_chars") % 210) / 10.0).alias("years_of_experience"),
            F.coalesce(first["title"], F.lit("")).alias("current_title"),
            F.coalesce(first["company"], F.lit("")).alias("current_company"),
            F.coalesce(first["company_size"], F.lit("")).alias("current_company_size"),
            sector.alias("current_industry"),
        ).alias("profile"),
        "career_history",
        F.transform(entries, lambda j: F.struct(
            F.lit("").alias("institution"), _choose(DEGREES, d + j).alias("degree"),
            _choose(FIELDS, d + j).alias("field_of_study"),
            F.lit(2000).alias("start_year"), F.lit(2004).alias("end_year"),
            F.lit(None).cast("string").alias("grade"),
            F.concat(F.lit("tier_"), (F.lit(1) + (d + j) % 5).cast("string")).alias("tier"),
        )).alias("education"),
        "skills",
        F.when((d % 4 == 1) & (F.size("skills") > 0), F.array(F.struct(
            F.concat(F.lit("Certified "), F.get("skills", F.lit(0))["name"]).alias("name"),
            F.lit("Board").alias("issuer"), (F.lit(2000) + d % 20).cast("int").alias("year"))))
        .otherwise(F.array().cast("array<struct<name:string,issuer:string,year:int>>")).alias("certifications"),
        F.array(F.struct(F.col("lang").alias("language"), F.lit("basic").alias("proficiency")))
        .alias("languages"),
        F.struct(
            (F.lit(40.0) + d % 61).alias("profile_completeness_score"),
            F.lit("2020-01-01").alias("signup_date"),
            F.coalesce(F.date_sub("last_seen", (d % 120).cast("int")).cast("string"), F.lit(""))
            .alias("last_active_date"),
            (d % 2 == 0).alias("open_to_work_flag"),
            count("views")("profile_views_received_30d"),
            count("applications")("applications_submitted_30d"),
            F.coalesce(F.col("saved") / F.col("n_events"), F.lit(0.0)).alias("recruiter_response_rate"),
            ((d % 9) * 20).cast("double").alias("avg_response_time_hours"),
            F.map_from_arrays(F.transform(tested, lambda t: t["name"]),
                              F.transform(tested, lambda t: t["score"])).alias("skill_assessment_scores"),
            (d % 300).cast("int").alias("connection_count"), (d % 25).cast("int").alias("endorsements_received"),
            ((d % 7) * 15).cast("int").alias("notice_period_days"),
            F.when(d % 2 == 0, F.struct((F.lit(10.0) + d % 20).alias("min_lpa"),
                                        (F.lit(30.0) + d % 20).alias("max_lpa")))
            .alias("expected_salary_range"),
            _choose(MODES, d).alias("preferred_work_mode"), (d % 3 == 0).alias("willing_to_relocate"),
            (d % 80 - 1).cast("double").alias("github_activity_score"),
            count("searches")("search_appearance_30d"), count("saved")("saved_by_recruiters_30d"),
            ((d % 11) / 10.0).alias("interview_completion_rate"),
            ((d % 13) / 12.0).alias("offer_acceptance_rate"),
            (d % 3 != 0).alias("verified_email"), (d % 5 != 0).alias("verified_phone"),
            (d % 2 == 1).alias("linkedin_connected"),
        ).alias("platform_signals"),
    ]


def candidates(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    """Nested candidates, one per document, with the signals of the user of the same id.

    ``vectors`` (vec_id, vectors) adds passages by document id. Both meet the documents before these are nested, on keys of one
    form, so that a document is shuffled once at most and a nested candidate never.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    signals = signals_by_user(table(spark, sf_dir, "events").where("user_id IS NOT NULL"))
    joined = docs.join(signals, docs["doc_id"].eqNullSafe(signals["user_id"]), "left")
    if vectors is None:
        return joined.select(*_document_columns()).select(*_candidate_columns())
    joined = joined.join(vectors, docs["doc_id"].eqNullSafe(vectors["vec_id"]), "left")
    return joined.select(*_document_columns(), "vectors").select(*_candidate_columns(), "vectors")


def job_texts(items: DataFrame, id_col: str) -> DataFrame:
    """Job adverts around a text: first half of its sentences required, the rest preferred."""
    i = F.col(id_col)
    pieces = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), r"\. ")
    half = F.ceil(F.size(pieces) / 2).cast("int")
    low, high = (F.lit(2) + i % 4).cast("string"), (F.lit(8) + i % 5).cast("string")
    years = (F.when(i % 5 == 0, F.concat(low, F.lit("+ years")))
             .when(i % 5 == 1, F.concat(F.lit("at least "), low, F.lit(" years")))
             .when(i % 5 == 2, F.concat(low, F.lit(" to "), high, F.lit(" years")))
             .otherwise(F.concat(low, F.lit("-"), high, F.lit(" years"))))
    lines = F.array(
        _choose(HEADINGS, i),
        F.concat(F.lit("We work "), _choose(PLACES, i),
                 F.lit(" and run production systems in production. You deploy and monitor them.")),
        F.when(i % 2 == 0, "We expect curiosity and ownership.").otherwise("A fast startup team."),
        F.lit("REQUIRED SKILLS"),
        F.concat(F.lit("You must have "), years, F.lit(" with: "),
                 F.array_join(F.slice(pieces, 1, half), ". ")),
        F.lit("NICE TO HAVE"),
        F.concat(F.lit("- Bonus: "), F.array_join(F.slice(pieces, half + 1, F.size(pieces)), ". ")),
        F.lit("We are not looking for shortcuts. Do not apply twice; avoid agencies."),
        F.when(i % 3 == 0, "ABOUT US").otherwise("NICE TO HAVE"),
        F.concat(F.lit("Ideally you like "), F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit(""))),
    )
    return items.select(i.alias("jd_id"), F.array_join(lines, "\n").alias("text"))
