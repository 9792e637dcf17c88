"""Keep-best, top-K per job, ranks, metadata and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx


def keep_best(rows: DataFrame, keys: Sequence[str], score: str, tie_break: Sequence[Column]) -> DataFrame:
    """Best row per key, ties by ``tie_break``.

    row_number() = 1 plans a group limit below the shuffle, so a key with very
    many copies leaves each task as one row.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *tie_break)
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def top_k(rows: DataFrame, k: int, score: str, tie_break: Sequence[Column],
          keys: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """First k rows per key by (score desc, tie_break), numbered from 1.

    Every task prunes to k rows per key before the shuffle. Without keys the
    cut is an ordered limit, so only k rows meet in one task.
    """
    if not keys:
        best = rows.orderBy(F.desc(score), *tie_break).limit(k)
        order = Window.orderBy(F.desc(score), *tie_break)
        return best.withColumn(rank, F.row_number().over(order))
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *tie_break)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def max_copies(ids: DataFrame, key: str = "candidate_id") -> int:
    """Largest number of rows with one id: one pruned pass over the id column."""
    counts = ids.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def rank_candidates(scored: DataFrame, k: int = S.DEFAULT_TOP_K, copies: int | None = None,
                    buckets: int | None = None) -> DataFrame:
    """Best k distinct candidates per job with ``rank``, ties by candidate id.

    Two levels, whatever the sizes. A job's rows are dealt into ``buckets`` by a hash of
    the candidate id (by default as many as there are shuffle partitions); each bucket
    keeps the best row per id and then k ids. Only buckets * k rows of a job meet on the
    second level. If no id has more than ``copies`` rows, the k best ids of a bucket lie
    within its first k * copies rows, and every task prunes to those before the shuffle.
    """
    buckets = buckets or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["jd_id", "_bucket"]
    rows = scored.withColumn("_bucket", F.pmod(F.xxhash64("candidate_id"), F.lit(buckets)).cast("int"))
    if copies:
        rows = top_k(rows, k * copies, "score", [F.asc("candidate_id"), F.asc("row_hash")], keys, "_pos").drop("_pos")
    if copies != 1:
        rows = keep_best(rows, [*keys, "candidate_id"], "score", [F.asc("row_hash")])
        rows = top_k(rows, k, "score", [F.asc("candidate_id")], keys, "_pos").drop("_pos")
    return top_k(rows.drop("_bucket"), k, "score", [F.asc("candidate_id")], ["jd_id"])


def cheap_cut(rows: DataFrame, cutoff: int) -> DataFrame:
    """First stage of the funnel: (jd_id, candidate_id, row_hash) of the best by cheap score; of an id's rows the best one."""
    slim = rows.select("jd_id", "candidate_id", "row_hash", "cheap_score")
    best = keep_best(slim, ["jd_id", "candidate_id"], "cheap_score", [F.asc("row_hash")])
    return top_k(best, cutoff, "cheap_score", [F.asc("candidate_id")], ["jd_id"]).select("jd_id", "candidate_id", "row_hash")


def later_cuts(scored: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """The other stages, on the pairs that are left: semantic, evidence, behaviour, final score."""
    stages = [F.col("semantic_relevance"), F.col("evidence_strength"), F.col("behavioral") + F.col("recruitability"), F.col("score")]
    rows = keep_best(scored, ["jd_id", "candidate_id"], "score", [F.asc("row_hash")])
    for stage, cutoff in zip(stages, cutoffs):
        rows = top_k(rows.withColumn("_stage", stage), cutoff, "_stage", [F.asc("candidate_id")],
                     ["jd_id"]).drop("_stage")
    return rows


# -- metadata and explanations: built on the k survivors only ----------------------------

@fx.build_once
def _dimension_rows() -> Column:
    rows = [F.struct((-F.col(key)).alias("order"), F.lit(i).alias("ord"), F.lit(label).alias("label"),
                     F.col(key).alias("value")) for i, (key, label, _) in enumerate(S.DIMENSIONS)]
    return F.array_sort(F.array(*rows))


def _above(dims: Column, threshold: float, limit: int) -> Column:
    kept = F.filter(dims, lambda d: d["value"] > threshold)
    return F.slice(F.transform(kept, lambda d: d["label"]), 1, limit)


def ranking_confidence(score: Column) -> Column:
    """Evenness of the dimensions, share of live ones, and the score."""
    values = F.array(*[F.col(key) for key, _, _ in S.DIMENSIONS])
    n = len(S.DIMENSIONS)
    mean = fx.sum_of(values) / n
    spread = F.sqrt(fx.sum_of(F.transform(values, lambda v: (v - mean) * (v - mean))) / n)
    live = F.size(F.filter(values, lambda v: v > 0.1)) / n
    return fx.clip((F.lit(1.0) - spread) * 0.5 + live * 0.3 + score * 0.2)


def with_metadata(ranked: DataFrame) -> DataFrame:
    """Add rounded score, sorted dimensions, dominant strengths, support and confidence."""
    sorted_dims = ranked.withColumn("_dims", _dimension_rows())
    return sorted_dims.select(
        "*",
        fx.round_exact(F.col("score"), 6).alias("final_score"),
        _above(F.col("_dims"), 0.5, 4).alias("dominant_strengths"),
        _above(F.col("_dims"), 0.4, 5).alias("supporting_modules"),
        fx.round_exact(ranking_confidence(F.col("score")), 4).alias("confidence"),
    )


@fx.build_once
def _strengths() -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(c("technical_alignment") > 0.5, F.concat(
            F.lit("Strong technical alignment ("), fx.percent(c("skill_coverage")), F.lit(" skill coverage)"))),
        F.when(c("evidence_strength") > 0.5, "Well-supported claims with multi-source evidence"),
        F.when(c("career_narrative") > 0.5, F.concat(
            F.lit("Strong career narrative ("), c("direction"), F.lit(" trajectory)"))),
        F.when(c("semantic_relevance") > 0.4, F.concat(
            F.lit("Good semantic alignment with role ("), fx.percent(c("semantic_score")), F.lit(")"))),
        F.when(c("authenticity") > 0.6, "High profile authenticity and consistency"),
        F.when(c("behavioral") > 0.5, "Strong platform engagement and hiring readiness"),
        F.when(c("recruitability") > 0.5, "High recruitability and availability"),
    ))


@fx.build_once
def _improvements() -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(c("technical_alignment") < 0.3, "Limited skill coverage for required competencies"),
        F.when(c("evidence_strength") < 0.3, "Weak evidence supporting technical claims"),
        F.when(c("authenticity") < 0.4, "Profile consistency could be improved"),
        F.when(c("behavioral") < 0.3, "Low platform engagement signals"),
    ))


def explain(ranked: DataFrame) -> DataFrame:
    """Ranked rows to explanations: strengths, gaps, trace, reasoning, contributions."""
    meta = with_metadata(ranked)
    texts = meta.select("*", _strengths().alias("strengths"), _improvements().alias("improvement_areas"))
    experience = F.concat(fx.fixed(F.col("years"), 0), F.lit(" years experience as "), F.col("title"))
    first_gap = F.get("improvement_areas", F.lit(0))
    strongest = F.slice("strengths", 1, 3)
    reasoning = F.concat_ws(
        ". ",
        F.when(F.size(strongest) > 0, F.array_join(strongest, ". ")),
        experience,
        F.when(first_gap.isNotNull(), F.concat(F.lit("Areas for improvement: "), first_gap)),
    )
    return texts.select(
        "jd_id", "candidate_id", "rank", F.col("final_score").alias("score"),
        "strengths", "improvement_areas",
        F.transform("_dims", lambda d: F.concat(d["label"], F.lit(": "), fx.fixed(d["value"], 3)))
        .alias("decision_trace"),
        reasoning.alias("reasoning"),
        F.concat(F.lit("Ranking confidence: "), fx.percent(F.col("confidence"))).alias("confidence"),
        F.map_from_arrays(F.transform("_dims", lambda d: d["label"]),
                          F.transform("_dims", lambda d: d["value"])).alias("module_contributions"),
    )


def ranking_metadata(ranked: DataFrame) -> DataFrame:
    return with_metadata(ranked).select(
        "jd_id", "candidate_id", "rank", F.col("final_score").alias("score"), "name", "title",
        F.col("years").alias("experience_years"), "confidence",
        F.col("dominant_strengths").alias("strengths"))


def reasoning_for(ranked: DataFrame, explanations: DataFrame) -> DataFrame:
    """Ranked rows with the reasoning of the same (job, candidate), '' where absent."""
    texts = explanations.select("jd_id", "candidate_id", "reasoning")
    joined = ranked.join(texts, ["jd_id", "candidate_id"], "left")
    return joined.withColumn("reasoning", F.coalesce("reasoning", F.lit("")))


def top_report(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The console table: rank, score, name, title and years of the first n per job."""
    return ranked.where(F.col("rank") <= n).select(
        "jd_id", "rank", fx.round_exact(F.col("score"), 4).alias("score"),
        F.substring("name", 1, 24).alias("name"), F.substring("title", 1, 34).alias("title"),
        fx.round_exact(F.col("years"), 1).alias("years"))
