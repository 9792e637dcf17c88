"""Registered queries: every operator over the driver's tables.

Each takes (spark, sf_dir) and returns flat columns: integers as bigint, doubles
rounded to eight digits, so that results compare exactly with the SQL oracle.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.functions import scalars as fx
from talentloom.operators import authenticity as au
from talentloom.operators import evidence as ev
from talentloom.operators import features as fe
from talentloom.operators import jobs as jo
from talentloom.operators import narrative as na
from talentloom.operators import ranking as rk
from talentloom.operators import reports as rp
from talentloom.operators import statistics as st
from talentloom.operators import vectors as ve
from talentloom.plans import derived as D
from talentloom.plans import pairs as pp
from talentloom.plans import pipeline
from talentloom.plans.storage import shared_folder
from talentloom.sources import candidates as cs
from talentloom.sources import jobs as js
from talentloom.sources import sinks
from talentloom.streaming import state as ss
from talentloom.streaming import topk as sk

Query = Callable[[SparkSession, str], DataFrame]
K = 10
DIGITS = 8
TIE_SHIFT = 1e-11  # lifts exact decimal ties, which two engines may round either way
FUNNEL = (300, 200, 100, 50, 10)


def _rounded(x: Column) -> Column:
    """``F.round`` to eight digits by arithmetic. Large numbers, those that are none, and those close to a tie go through decimals."""
    scaled = x * 10.0 ** DIGITS
    whole = F.floor(scaled + 0.5)
    return F.when((F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.4999), whole / 10.0 ** DIGITS).otherwise(F.round(x, DIGITS))


def tidy(df: DataFrame, many: bool = False) -> DataFrame:
    """Integers to bigint, doubles to eight digits. ``many`` rows are rounded by more code and less work."""
    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double") + TIE_SHIFT
            c = _rounded(c) if many else F.round(c, DIGITS)
        return c.alias(field.name)
    return df.select(*[plain(f) for f in df.schema])


# -- shared inputs -------------------------------------------------------------------

def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with four embedded passages made of the vector of their id: as it is, turned by one place,
    reversed, and negated."""
    vectors = D.table(spark, sf, "embeddings").select("vec_id", "embedding")
    u = F.col("_u")
    turned = F.concat(F.slice(u, 2, F.size(u)), F.slice(u, 1, 1))
    passages = vectors.select("vec_id", ve.unit(F.col("embedding")).alias("_u")).select(
        "vec_id", F.array(u, turned, F.reverse(u), F.transform(u, lambda x: -x)).alias("vectors"))
    return D.candidates(spark, sf, passages)


def _job_rows(spark: SparkSession, sf: str, table: str, id_col: str) -> DataFrame:
    return js.jobs_from_text(D.job_texts(D.spread(D.table(spark, sf, table)), id_col))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("jd_id"), "embedding")
    profiles = jo.hiring_profiles(_job_rows(spark, sf, "benchmark", "item_id"), D.PATTERNS)
    found = profiles.join(vectors, "jd_id", "left")
    return found.withColumn("vector", ve.unit(F.col("embedding"))).drop("embedding")


def _text_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Hiring profiles of one advert per document: job analysis at volume."""
    return jo.hiring_profiles(_sections(spark, sf), D.PATTERNS)


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return pp.candidate_facts(D.candidates(spark, sf), D.AS_OF)


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return fe.prepare(D.candidates(spark, sf))


def _scored(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    return pp.score_pairs(_candidates(spark, sf), _profiles(spark, sf), D.AS_OF, k=k)


def _copies(spark: SparkSession, sf: str) -> int:
    return rk.max_copies(D.table(spark, sf, "documents").select("doc_id"), "doc_id")


def _ranked(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return rk.rank_candidates(_scored(spark, sf, k), k)


def _kept(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows from a table written once, for queries that read them more than once."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _pair(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return tidy(_scored(spark, sf).select("jd_id", "candidate_id", *columns), many=True)


# -- ranking ---------------------------------------------------------------------------

def rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked(spark, sf)
    texts = rk.explain(ranked).select("jd_id", "candidate_id", "rank", "score", "reasoning", "confidence")
    return tidy(texts)


def fused_dims(spark, sf):
    return _pair(spark, sf, *pp.DIMENSION_COLUMNS, "cheap_score", "score")


def skill_match(spark, sf):
    return _pair(spark, sf, "matched_count", "skills_ratio", "skill_coverage", "title_relevance",
                 "industry_relevance", "relevant_assessment", "relevant_months")


def evidence_rollup(spark, sf):
    return _pair(spark, sf, "evidence_score", "evidence_coverage", "evidence_density", "strong_count",
                 "weak_count", F.array_join("unsupported_terms", ",").alias("unsupported"))


def evidence_detail(spark, sf):
    """Evidence of every competency for the ranked candidates, also where there is none."""
    rows = _scored(spark, sf, K).select("jd_id", "candidate_id", "row_hash", "score", "evidence_rows", "term_names")
    return tidy(ev.detail_rows(rk.rank_candidates(rows, K, _copies(spark, sf))))


def narrative(spark, sf):
    return _pair(spark, sf, "progression", "specialization", "growth", "domain", "direction",
                 "career_narrative")


def recruitability(spark, sf):
    return _pair(spark, sf, "availability", "hiring_compatibility", "mode_compatibility", "recruitability")


def semantic_scores(spark, sf):
    return _pair(spark, sf, *[F.col(f"sim.{n}_similarity").alias(f"{n}_similarity") for n in
                              ("summary", "career", "skills", "headline")], "semantic_score")


def ranking_metadata(spark, sf):
    meta = rk.ranking_metadata(_ranked(spark, sf))
    return tidy(meta.withColumn("strengths", F.array_join("strengths", ",")))


def explanations(spark, sf):
    e = rk.explain(_ranked(spark, sf))
    return tidy(e.select(
        "jd_id", "candidate_id", "rank", "score", F.array_join("strengths", "; ").alias("strengths"),
        F.array_join("improvement_areas", "; ").alias("improvement_areas"),
        F.array_join("decision_trace", "; ").alias("decision_trace"), "reasoning", "confidence"))


def reasoning_lookup(spark, sf):
    ranked = _kept(_ranked(spark, sf), "ranked")
    return tidy(rk.reasoning_for(ranked, rk.explain(ranked).where("rank <= 5")).select(
        "jd_id", "candidate_id", "rank", "reasoning"))


def top_report(spark, sf):
    return tidy(rk.top_report(_ranked(spark, sf), 3))


def cheap_funnel(spark, sf):
    return tidy(pipeline.funnel(_candidates(spark, sf), _profiles(spark, sf), D.AS_OF, FUNNEL).select(
        "jd_id", "candidate_id", "rank", "cheap_score", "score"))


def feature_vector(spark, sf):
    """The nine-wide numeric vector as single-precision columns."""
    vector = fe.numeric_vector()
    return _pair(spark, sf, *[F.get(vector, F.lit(i)).cast("double").alias(name) for i, name in enumerate(fe.VECTOR_NAMES)])


def dedup_best(spark, sf):
    events = D.table(spark, sf, "events").select("user_id", "event_id", "value")
    return tidy(rk.keep_best(events, ["user_id"], "value", [F.asc("event_id")]))


def topk_per_group(spark, sf):
    part = D.table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return tidy(rk.top_k(part, 5, "p_retailprice", [F.asc("p_partkey")], ["p_brand"]))


def topk_global(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tidy(rk.top_k(orders, 100, "o_totalprice", [F.asc("o_orderkey")]))


# -- candidate features -------------------------------------------------------------------

def skill_stats(spark, sf):
    return tidy(_facts(spark, sf).select("candidate_id", "skill.*"))


def career_features(spark, sf):
    return tidy(_facts(spark, sf).select("candidate_id", "career.*"))


def education_features(spark, sf):
    return tidy(_facts(spark, sf).select("candidate_id", "edu.*"))


def behavior_fields(spark, sf):
    fields = fe.behavior_fields(F.col("platform_signals")).alias("b")
    return tidy(D.candidates(spark, sf).select("candidate_id", fields).select("candidate_id", "b.*"))


def seniority_and_size(spark, sf):
    zipped = _prepared(spark, sf).select("candidate_id", F.arrays_zip("levels", "sizes").alias("z"))
    return tidy(fx.element_rows(zipped, "z", "candidate_id").select(
        "candidate_id", "pos", F.col("element.levels").alias("level"),
        F.col("element.sizes").alias("size_level")))


def career_transitions(spark, sf):
    return tidy(na.transition_rows(_prepared(spark, sf)))


def career_trajectory(spark, sf):
    return tidy(_facts(spark, sf).select("candidate_id", "progression", "growth", "direction"))


def authenticity_parts(spark, sf):
    return tidy(_facts(spark, sf).select(
        "candidate_id", "semantic_coherence", "career_coherence", "timeline_consistency",
        "education_alignment", "profile_support"))


def timeline_check(spark, sf):
    facts = _facts(spark, sf)
    text = au.timeline_messages(F.col("years"), F.col("career.total_career_months"), F.col("timeline_mismatch"))
    return tidy(facts.select("candidate_id", "timeline_consistency",
                             F.coalesce(F.get(text, F.lit(0)), F.lit("")).alias("message")))


def overlapping_jobs(spark, sf):
    return tidy(D.candidates(spark, sf).select(
        "candidate_id", au.overlapping_jobs(F.col("career_history")).alias("overlaps")))


def behavioral(spark, sf):
    return tidy(_facts(spark, sf).select(
        "candidate_id", "engagement", "responsiveness", "activity", "recruiter_interest", "verification",
        "hiring_readiness", "profile_quality", "behavioral_score", "availability"))


def candidate_texts(spark, sf):
    c = D.candidates(spark, sf)
    return tidy(c.select(
        "candidate_id", F.length(fe.career_text(F.col("career_history"))).alias("career_chars"),
        F.md5(fe.career_text(F.col("career_history"))).alias("career_md5"),
        F.array_join(fe.skill_names(F.col("skills")), ", ").alias("skill_names"),
        fx.join_fields(F.col("profile.headline"), F.col("profile.location"), separator=" / ").alias("label")))


# -- job analysis ----------------------------------------------------------------------

def _sections(spark, sf):
    texts = D.job_texts(D.spread(D.table(spark, sf, "documents")), "doc_id")
    return js.jobs_from_text(texts)


def jd_sections(spark, sf):
    return tidy(js.job_sections(_sections(spark, sf)))


def jd_paragraphs(spark, sf):
    return tidy(js.job_paragraphs(_sections(spark, sf)))


def jd_competencies(spark, sf):
    return tidy(jo.competency_rows(_text_profiles(spark, sf)))


def jd_default_mentions(spark, sf):
    """The default pattern list over the raw documents."""
    docs = D.spread(D.table(spark, sf, "documents"))
    found = docs.select("doc_id", jo.competency_mentions(F.lower("text")).alias("found"))
    return tidy(fx.element_rows(found, "found", "doc_id", element="skill").drop("pos"))


def jd_priorities(spark, sf):
    return tidy(fx.element_rows(
        _text_profiles(spark, sf), "priorities", "jd_id").select("jd_id", "element.*"))


def jd_concepts(spark, sf):
    rows = fx.element_rows(_text_profiles(spark, sf), "concepts", "jd_id", pos="ord", element="c")
    return tidy(rows.select("jd_id", "ord", "c.primary_term", "c.importance",
                            F.array_join("c.related_terms", ",").alias("related")))


def jd_philosophy(spark, sf):
    return tidy(rp.top_philosophy(_text_profiles(spark, sf)))


def jd_constraints(spark, sf):
    return tidy(fx.element_rows(
        _text_profiles(spark, sf), "constraints", "jd_id").select("jd_id", "element.*"))


def jd_experience(spark, sf):
    return tidy(_text_profiles(spark, sf).select("jd_id", "experience.*"))


def jd_role(spark, sf):
    return tidy(_text_profiles(spark, sf).select("jd_id", "role.*"))


def jd_behavior(spark, sf):
    return tidy(fx.element_rows(
        _text_profiles(spark, sf), "behavior_expectations", "jd_id", element="label").drop("pos"))


def jd_disqualifiers(spark, sf):
    rows = fx.element_rows(_text_profiles(spark, sf), "disqualifiers", "jd_id", element="context")
    return tidy(rows.groupBy("jd_id", "context").agg(F.count(F.lit(1)).alias("n")))


def jd_weights(spark, sf):
    return tidy(rp.weight_shares(_text_profiles(spark, sf)))


def jd_top_competencies(spark, sf):
    return tidy(rp.top_competencies(_text_profiles(spark, sf), 3))


# -- text functions over whole documents ---------------------------------------------------

def _docs(spark, sf):
    return D.spread(D.table(spark, sf, "documents")).select("doc_id", "text", "source")


def sentences(spark, sf):
    found = _docs(spark, sf).select("doc_id", fx.sentences(F.col("text")).alias("found"))
    return tidy(fx.element_rows(found, "found", "doc_id", element="sentence"))


def text_functions(spark, sf):
    text = F.col("text")
    return tidy(_docs(spark, sf).select(
        "doc_id", fx.normalize_text(text).alias("normalized"), F.md5(fx.clean_text(text)).alias("clean_md5"),
        fx.count_occurrences(text, F.lit("the")).alias("n_the"),
        fx.count_occurrences(text, F.lit("The"), ignore_case=False).alias("n_the_exact"),
        fx.contains_any(text, ("thor", "Blees")).alias("has_any"),
        fx.truncate_words(text, 120).alias("short"),
        fx.text_relevance(fx.lower_or_empty(text), F.array(*[F.lit(w) for w in ("thor", "blees", "zzz")]))
        .alias("relevance"),
        fx.sigmoid(F.length(text) / 1000.0 - 1).alias("squashed"),
        fx.safe_divide(F.length(text).cast("double"), F.col("doc_id") % 3, -1.0).alias("divided")))


def number_formats(spark, sf):
    o = D.table(spark, sf, "orders")
    x = F.col("o_totalprice") / 1000.0
    return tidy(o.select("o_orderkey", fx.fixed(x, 0).alias("f0"), fx.fixed(x, 1).alias("f1"),
                         fx.fixed(x, 3).alias("f3"), fx.fixed(x, 6).alias("f6"),
                         fx.percent(F.col("o_orderkey") / 800.0).alias("pct"),
                         fx.score_band(F.col("o_orderkey") % 100 / 100.0).alias("band")))


# -- sources ---------------------------------------------------------------------------

def _event_lines(spark, sf) -> DataFrame:
    """JSON lines written from events; some are broken, blank, or of the wrong kind."""
    e = D.spread(D.table(spark, sf, "events"))
    i, v = F.col("event_id"), F.col("value").cast("string")
    good = F.concat(
        F.lit('{"candidate_id":"E'), i.cast("string"), F.lit('","profile":{"headline":"'), F.col("event_type"),
        F.lit('","years_of_experience":'), F.when(i % 7 == 0, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v),
        F.lit('},"skills":[{"name":"'), F.col("event_type"), F.lit('","endorsements":'),
        F.when(i % 5 == 0, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v),
        F.lit('}],"platform_signals":{"verified_email":'), F.when(i % 2 == 0, "true").otherwise('"true"'),
        F.lit(',"skill_assessment_scores":'), F.col("props"), F.lit("}}"))
    line = (F.when(i % 11 == 3, F.substring(good, 1, 30)).when(i % 13 == 4, F.lit("   "))
            .when(i % 17 == 5, F.lit('{"candidate_id":""}'))
            .when(i % 19 == 6, F.lit('{"candidate_id":"x","profile":null}'))
            .when(i % 23 == 7, F.lit("[1]")).otherwise(good))
    return e.select(line.alias("value"))


def ingest_jsonl(spark, sf):
    good = cs.accepted(cs.parse_candidates(_event_lines(spark, sf)))
    first = F.get("skills", F.lit(0))
    return tidy(good.select(
        "candidate_id", F.col("profile.headline").alias("headline"),
        F.col("profile.years_of_experience").alias("years"), first["endorsements"].alias("endorsements"),
        first["proficiency"].alias("proficiency"),
        F.col("platform_signals.verified_email").alias("verified"),
        F.try_element_at("platform_signals.skill_assessment_scores", F.lit("k")).alias("k")))


def ingest_rejects(spark, sf):
    parsed = cs.parse_candidates(_event_lines(spark, sf))
    return tidy(parsed.groupBy(F.coalesce("_reject", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")))


def reject_counts(spark, sf):
    """Parsed and error counts, observed on the scan while it is written."""
    counts = Observation("ingest")
    parsed = cs.observe_ingest(cs.parse_candidates(_event_lines(spark, sf)), counts)
    parsed.select("candidate_id").write.format("noop").mode("overwrite").save()
    found = counts.get
    return tidy(spark.createDataFrame([(found["parsed"], found["errors"], found["malformed"])],
                                      "parsed long, errors long, malformed long"))


def ingest_array(spark, sf):
    """JSON arrays of up to 1000 events; every seventh file lacks its closing bracket."""
    e = D.table(spark, sf, "events")
    i = F.col("event_id")
    record = (F.when(i % 17 == 5, F.lit('{"candidate_id":""}')).when(i % 23 == 7, F.lit("7"))
              .otherwise(F.concat(F.lit('{"candidate_id":"E'), i.cast("string"), F.lit('"}'))))
    file = F.floor(i / 1000)
    texts = e.groupBy(file.alias("file")).agg(F.array_join(F.collect_list(record), ",").alias("all")).select(
        F.concat(F.lit("["), F.col("all"), F.when(F.col("file") % 7 == 3, "").otherwise("]")).alias("value"), "file")
    folder = shared_folder(spark, "ingest-array")
    texts.write.partitionBy("file").text(folder)
    parsed = cs.parse_candidates(cs.scan_candidates(spark, f"{folder}/*", "json"))
    return tidy(parsed.groupBy(F.coalesce("_reject", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


def ingest_kinds(spark, sf):
    """Equal keys, lists of the wrong kind, integers beyond 32 bits, and NaN."""
    e = D.spread(D.table(spark, sf, "events"))
    i = F.col("event_id")
    rest = (F.when(i % 4 == 0, F.concat(F.lit(',"candidate_id":"D'), i.cast("string"), F.lit('"')))
            .when(i % 4 == 1, F.lit(',"skills":"x"'))
            .when(i % 4 == 2, F.concat(F.lit(',"skills":[{"endorsements":'), (i + 3_000_000_000).cast("string"), F.lit("}]")))
            .otherwise(F.lit(',"profile":{"years_of_experience": NaN, "headline":": NaN,"}')))
    lines = e.select(F.concat(F.lit('{"candidate_id":"K'), i.cast("string"), F.lit('"'), rest, F.lit("}")).alias("value"))
    good = cs.accepted(cs.parse_candidates(lines))
    return tidy(good.select("candidate_id", F.size("skills").alias("n_skills"),
                            F.coalesce(F.get("skills", F.lit(0))["endorsements"], F.lit(0)).alias("endorsements"),
                            F.isnan("profile.years_of_experience").alias("odd"),
                            F.col("profile.headline").alias("headline")))


def _array_lines(batches):
    """The records of a task as the lines of one JSON array; a task without records has none."""
    before = "["
    for batch in batches:
        if batch.num_rows:
            values = batch.column("value")
            signs = pa.array([before] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(signs, values, "")], names=["value"])
            before = ","
    if before == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])


def format_dispatch(spark, sf):
    """The same records as JSON lines and as arrays, one array a task; the suffix of the path decides how they are read."""
    e = D.table(spark, sf, "events")
    record = F.concat(F.lit('{"candidate_id":"E'), F.col("event_id").cast("string"), F.lit('"}'))
    base = shared_folder(spark, "formats")
    records = e.select(record.alias("value"))
    records.write.text(f"{base}/records.jsonl")
    records.where("value IS NOT NULL").mapInArrow(_array_lines, "value string").write.text(f"{base}/records.json")
    found = None
    for name in ("records.jsonl", "records.json"):
        good = cs.accepted(cs.parse_candidates(cs.scan_candidates(spark, f"{base}/{name}")))
        part = good.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_id").alias("n_ids")).withColumn("source", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return tidy(found)


# -- .docx files ---------------------------------------------------------------------------------

_DOCX_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _write_docx(folder: str):
    """Writes one .docx per row to a folder that all executors share; every seventh is cut in half."""
    def run(batches):
        for batch in batches:
            names = []
            for jd_id, lines in zip(batch["jd_id"], batch["lines"], strict=True):
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in lines)
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("word/document.xml", f"<w:document {_DOCX_SPACE}><w:body>{body}</w:body></w:document>")
                content = held.getvalue()
                names.append(f"{jd_id}.docx")
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{names[-1]}", "wb") as out:
                    out.write(content[:len(content) // 2] if jd_id % 7 == 3 else content)
            yield pd.DataFrame({"name": names})
    return run


def _docx_folder(spark, sf) -> str:
    """The job texts of the benchmark as .docx files. The folder is a mounted path, as for any office files."""
    folder = shared_folder(spark, "docx").removeprefix("file:")
    texts = D.job_texts(D.spread(D.table(spark, sf, "benchmark")), "item_id")
    rows = texts.select("jd_id", F.split("text", "\n").alias("lines"))
    rows.mapInPandas(_write_docx(folder), "name string").write.format("noop").mode("overwrite").save()
    return folder


def _docx_id() -> Column:
    return F.regexp_extract("jd_id", r"([0-9]+)\.docx$", 1).cast("long").alias("jd_id")


def docx_jobs(spark, sf):
    """Sections of job texts that were read from .docx files."""
    jobs = js.jobs_from_docx(spark, _docx_folder(spark, sf))
    return tidy(js.job_sections(jobs).select(_docx_id(), "pos", "section", "text"))


def docx_rejects(spark, sf):
    """The files that cannot be read, and that each has a reason."""
    found = js.docx_rejects(spark, _docx_folder(spark, sf))
    return tidy(found.select(_docx_id(), (F.length("error") > 0).alias("explained")))


# -- encoders, copies and sinks --------------------------------------------------------------

def _arithmetic_encoder():
    return lambda texts: np.array([[len(t), t.count("a") + 1.0, 1.0] for t in texts])


def encoded_scores(spark, sf):
    """Semantic scores from an encoder that SQL can repeat; every third id has a second record with its own passages."""
    c = D.candidates(spark, sf)
    copy = c.where(F.substring("candidate_id", -3, 3).cast("int") % 3 == 0).withColumn("profile", F.col("profile").withField(
        "summary", F.lit("a second record")).withField("anonymized_name", F.lit("copy")))
    people = pipeline.with_vectors(c.unionByName(copy), _arithmetic_encoder)
    jobs = jo.hiring_profiles(_job_rows(spark, sf, "benchmark", "item_id"), D.PATTERNS)
    scored = pp.score_pairs(people, pipeline.with_job_vectors(jobs, _arithmetic_encoder), D.AS_OF)
    return tidy(scored.select("jd_id", "candidate_id", "name", *[F.col(f"sim.{n}_similarity").alias(n) for n in
                              ("summary", "career", "skills", "headline")], "semantic_score"))


def sentence_vectors(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("jd_id"), F.col("text").alias("raw_text"))
    vectors = ve.encode(ve.job_sentences(docs), ["jd_id"], "texts", _arithmetic_encoder)
    rows = fx.element_rows(vectors, "vectors", "jd_id", element="v")
    return tidy(rows.select("jd_id", "pos", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)]))


def rank_with_copies(spark, sf):
    """A third of all records share one id; their best record stands for it."""
    hot = F.when(F.substring("candidate_id", -3, 3).cast("int") % 3 == 0, F.lit("CAND_HOT")).otherwise(F.col("candidate_id"))
    ranked = pipeline.rank(_candidates(spark, sf).withColumn("candidate_id", hot), _profiles(spark, sf), D.AS_OF, K)
    return tidy(ranked.select("jd_id", "candidate_id", "rank", "score"))


def csv_sink(spark, sf):
    path = shared_folder(spark, "csv-sink")
    sinks.write_ranked_csv(rk.explain(_ranked(spark, sf)), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return tidy(rows.select(F.col("jd_id").cast("long"), "candidate_id", F.col("rank").cast("long"), "score", "reasoning"))


def explanations_sink(spark, sf):
    path = shared_folder(spark, "explanations-sink")
    sinks.write_explanations(rk.explain(_ranked(spark, sf)), path)
    return tidy(spark.read.json(path).select(
        F.col("jd_id").cast("long"), "candidate_id", "rank", "score", "reasoning",
        F.array_join("decision_trace", "; ").alias("decision_trace")))


def metadata_sink(spark, sf):
    path = shared_folder(spark, "metadata-sink")
    sinks.write_ranking_metadata(rk.ranking_metadata(_ranked(spark, sf)), path)
    return tidy(spark.read.json(path).select(F.col("jd_id").cast("long"), "candidate_id", "rank", "score", "confidence"))


def metrics_sink(spark, sf):
    path = shared_folder(spark, "metrics-sink")
    result = pipeline.run(spark, _job_rows(spark, sf, "benchmark", "item_id"), cs.parse_candidates(_candidates_json(spark, sf)),
                          path, D.AS_OF, K)
    read = spark.read.json(f"{path}/run_metrics")
    return tidy(read.select("total_candidates", "candidates_ranked", "errors",
                            F.size("stages").alias("n_stages")).crossJoin(result.metrics.select(
                                (F.col("runtime_seconds") > 0).alias("timed"))))


# -- statistics --------------------------------------------------------------------------

def _prices(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


def normalize_robust(spark, sf):
    return tidy(st.normalize(_prices(spark, sf), "o_totalprice", "robust"))


def normalize_minmax(spark, sf):
    return tidy(st.normalize(_prices(spark, sf), "o_totalprice", "minmax"))


def normalize_standard(spark, sf):
    return tidy(st.normalize(_prices(spark, sf), "o_totalprice", "standard"))


def percentile_rank(spark, sf):
    return tidy(st.percentile_rank(_prices(spark, sf), "o_totalprice"))


def percentile_of(spark, sf):
    """The share of prices not above one price."""
    return tidy(st.percentile_of(_prices(spark, sf), "o_totalprice", 150_000.0))


def normalize_unknown(spark, sf):
    """An unknown strategy counts as robust."""
    return tidy(st.normalize(_prices(spark, sf), "o_totalprice", "no such strategy"))


def running_stats(spark, sf):
    return tidy(D.table(spark, sf, "events").groupBy("event_type").agg(*st.running_statistics("value")))


def corpus_z_scores(spark, sf):
    return tidy(st.corpus_z_scores(_facts(spark, sf)))


def quantiles_by_group(spark, sf):
    return tidy(st.quantiles_by_group(D.table(spark, sf, "events"), ["event_type"], "value", (0.1, 0.5, 0.9)))


def quantiles(spark, sf):
    events = D.table(spark, sf, "events")
    probs = (0.05, 0.25, 0.5, 0.75, 0.99)
    values = st.exact_quantiles(events, "value", probs)
    return tidy(spark.createDataFrame(list(zip(probs, values)), "p double, value double"))


# -- vectors ------------------------------------------------------------------------------

def cosine_to_label(spark, sf):
    """Cosine of every vector with the first vector of its label."""
    e = D.table(spark, sf, "embeddings")
    heads = rk.keep_best(e.withColumn("_k", -F.col("vec_id")), ["label"], "_k", []).select(
        "label", F.col("embedding").alias("head"))
    return tidy(e.join(heads, "label").select(
        "vec_id", ve.cosine(F.col("embedding"), F.col("head")).alias("cosine")))


# -- reports --------------------------------------------------------------------------------

def score_histogram(spark, sf):
    return tidy(rp.score_histogram(_kept(_ranked(spark, sf), "ranked")))


def score_bands(spark, sf):
    return tidy(rp.band_counts(_scored(spark, sf), "technical_alignment"))


def ranking_table(spark, sf):
    return tidy(rp.ranking_table(rk.with_metadata(_ranked(spark, sf))))


def search_filter(spark, sf):
    return tidy(rp.search(rp.ranking_table(rk.with_metadata(_ranked(spark, sf))), 0.4, "lead|12$"))


def dims_long(spark, sf):
    return tidy(rp.dimensions_long(_ranked(spark, sf)))


def contrib_matrix(spark, sf):
    return tidy(rp.contribution_matrix(rk.explain(_ranked(spark, sf))))


def candidate_card(spark, sf):
    return tidy(rp.candidate_card(_ranked(spark, sf)))


def headline_metrics(spark, sf):
    return tidy(rp.headline_metrics(D.candidates(spark, sf), _kept(_ranked(spark, sf), "ranked"), 2.0))


# -- streams ----------------------------------------------------------------------------------

def _event_stream(spark, sf, base: str) -> DataFrame:
    """Events from several files, one per micro-batch."""
    events = D.table(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")


def stream_topk(spark, sf):
    base = shared_folder(spark, "stream-topk")
    ss.use_rocksdb(spark)
    rows = _event_stream(spark, sf, base).select("event_type", "user_id", "event_id", "value")
    best = ss.best_rows(rows, ["event_type"], "user_id", "value", ["event_id"], K)
    ss.run(best, f"{base}/checkpoint").awaitTermination()
    return tidy(ss.best_now(spark, f"{base}/checkpoint", ["event_type"], "user_id", "value", K))


def stream_stats(spark, sf):
    base = shared_folder(spark, "stream-stats")
    totals = sk.running_statistics(_event_stream(spark, sf, base), ["event_type"], "value")
    sk.write_versions(totals, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return tidy(sk.Versions(spark, f"{base}/out").latest())


def stream_keep_best(spark, sf):
    base = shared_folder(spark, "stream-best")
    best = sk.keep_best(_event_stream(spark, sf, base), "user_id", "value", ["event_id"])
    ss.run(best, f"{base}/checkpoint").awaitTermination()
    return tidy(sk.keep_best_now(spark, f"{base}/checkpoint", "user_id", "value", ["event_id"]))


def stream_quantiles(spark, sf):
    """Quantiles of a stream from stored sketches, and how far the share of values not above each is from what was asked."""
    base, probs = shared_folder(spark, "stream-quantiles"), (0.1, 0.5, 0.9)
    events = _event_stream(spark, sf, base).withColumn("day", F.to_date("ts"))
    sk.sketch_batches(events, ["event_type", "day"], "value", f"{base}/sketches", f"{base}/checkpoint").awaitTermination()
    found = st.sketched_quantiles(spark.read.parquet(f"{base}/sketches"), ["event_type"], probs)
    below = D.table(spark, sf, "events").select("event_type", F.col("value").alias("_x")).join(F.broadcast(found), "event_type")
    share = below.groupBy("event_type", "p", "n").agg(
        F.avg((F.col("_x") <= F.col("value")).cast("double")).alias("above"),
        F.avg((F.col("_x") < F.col("value")).cast("double")).alias("under"))
    near = (F.col("under") <= F.col("p") + 0.02) & (F.col("above") >= F.col("p") - 0.02)
    return tidy(share.select("event_type", "p", "n", near.alias("within")))


def stream_progress(spark, sf):
    """Batches and rows of a stream as its listener saw them, and the rows that the stream itself observed."""
    base = shared_folder(spark, "stream-progress")
    events = _event_stream(spark, sf, base).observe("seen", F.count(F.lit(1)).alias("n"))
    log = sk.logged(spark, lambda: ss.run(events.select("event_id"), f"{base}/checkpoint"), f"{base}/progress")
    batches = log.where("event = 'batch'").where("rows > 0")
    counted = F.get_json_object("observed", "$.seen.n").cast("long")
    return tidy(batches.agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("n_rows"), F.sum(counted).alias("observed")))


def stream_ranking(spark, sf):
    """The flagship as a stream: candidates arrive as JSON lines."""
    base = shared_folder(spark, "stream-ranking")
    ss.use_rocksdb(spark)
    _candidates_json(spark, sf).write.text(f"{base}/in")
    arriving = cs.stream_candidates(spark, f"{base}/in", files_per_batch=3)
    sk.stream_ranking(arriving, _profiles(spark, sf), D.AS_OF, K, f"{base}/checkpoint").awaitTermination()
    ranked = sk.ranking_now(spark, f"{base}/checkpoint", K)
    return tidy(rk.explain(ranked).select("jd_id", "candidate_id", "rank", "score", "reasoning"))


def _candidates_json(spark, sf) -> DataFrame:
    c = D.candidates(spark, sf)
    signals = F.col("platform_signals").dropFields("expected_salary_range").withField(
        "expected_salary_range_inr_lpa", F.struct(
            F.col("platform_signals.expected_salary_range.min_lpa").alias("min"),
            F.col("platform_signals.expected_salary_range.max_lpa").alias("max")))
    return c.withColumn("platform_signals", signals).select(F.to_json(F.struct(*c.columns)).alias("value"))


NAMES = (
    "rank_topk", "fused_dims", "skill_match", "evidence_rollup", "evidence_detail", "narrative",
    "recruitability", "semantic_scores", "ranking_metadata", "explanations", "reasoning_lookup",
    "top_report", "cheap_funnel", "feature_vector", "dedup_best", "topk_per_group", "topk_global",
    "skill_stats", "career_features", "education_features", "behavior_fields", "seniority_and_size",
    "career_transitions", "career_trajectory", "authenticity_parts", "timeline_check",
    "overlapping_jobs", "behavioral", "candidate_texts", "jd_sections", "jd_paragraphs",
    "jd_competencies", "jd_default_mentions", "jd_priorities", "jd_concepts", "jd_philosophy",
    "jd_constraints", "jd_experience", "jd_role", "jd_behavior", "jd_disqualifiers", "jd_weights",
    "jd_top_competencies", "sentences", "text_functions", "number_formats", "ingest_jsonl",
    "ingest_rejects", "normalize_robust", "normalize_minmax", "normalize_standard",
    "percentile_rank", "running_stats", "corpus_z_scores", "quantiles", "cosine_to_label",
    "quantiles_by_group", "reject_counts", "ingest_array", "ingest_kinds", "encoded_scores",
    "sentence_vectors", "rank_with_copies", "csv_sink", "explanations_sink", "metadata_sink", "metrics_sink",
    "score_histogram", "score_bands", "ranking_table", "search_filter", "dims_long",
    "contrib_matrix", "candidate_card", "headline_metrics", "stream_topk", "stream_stats",
    "stream_keep_best", "stream_ranking", "stream_quantiles", "stream_progress", "docx_jobs", "docx_rejects",
    "percentile_of", "format_dispatch", "normalize_unknown",
)


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in NAMES}
