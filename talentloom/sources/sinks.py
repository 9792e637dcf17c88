"""Sinks: ranked CSV, explanations, ranking metadata and run metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.functions import scalars as fx


def write_ranked_csv(explanations: DataFrame, path: str) -> None:
    """One CSV file per job: candidate_id, rank, score with six digits, reasoning.

    A job has at most k rows, so sorting a job within one task is bounded.
    """
    rows = explanations.select(
        "jd_id", "candidate_id", "rank", fx.fixed(F.col("score"), 6).alias("score"), "reasoning")
    (rows.repartition("jd_id").sortWithinPartitions("jd_id", "rank")
     .write.mode("overwrite").partitionBy("jd_id")
     .csv(path, header=True, quote='"', escape='"', emptyValue=""))


def write_explanations(explanations: DataFrame, path: str) -> None:
    _write_json(explanations, path)


def write_ranking_metadata(metadata: DataFrame, path: str) -> None:
    _write_json(metadata, path)


def _write_json(rows: DataFrame, path: str) -> None:
    (rows.repartition("jd_id").sortWithinPartitions("jd_id", "rank")
     .write.mode("overwrite").partitionBy("jd_id").json(path))


def run_metrics(spark: SparkSession, totals: Mapping[str, float],
                timings: Mapping[str, Sequence[float]]) -> DataFrame:
    """One row: run totals plus count, total, avg, min and max seconds per stage."""
    stages = [(name, len(t), float(sum(t)), float(sum(t)) / len(t) if t else 0.0,
               float(min(t)) if t else 0.0, float(max(t)) if t else 0.0)
              for name, t in timings.items()]
    schema = ("total_candidates bigint, candidates_ranked bigint, errors bigint, runtime_seconds double, "
              "stages array<struct<stage:string,count:int,total:double,avg:double,min:double,max:double>>")
    return spark.createDataFrame([(
        int(totals.get("total_candidates", 0)), int(totals.get("candidates_ranked", 0)),
        int(totals.get("errors", 0)), float(totals.get("runtime_seconds", 0.0)), stages)], schema)


def write_run_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
