"""All pairs: measures against the expressions, code small enough to be compiled, rounding by arithmetic."""

import random
import re

from pyspark.sql import functions as F

from talentloom.operators import blocks as bl
from talentloom.operators import vectors as ve
from talentloom.plans import catalog
from talentloom.plans import pairs as pp
from tests.test_library import people
from tests.test_scale import AS_OF, crowd, several_jobs

PASSAGES = [None, [], [[0.6, 0.8], None, [1.0, 0.0], [-0.6, 0.8]], [[0.6, None], [0.6, 0.8, 0.0], [0.1, 0.7]],
            [[0.1, 0.2, 0.3], [0.0, 0.0, 0.0], [float("nan"), 0.1, 0.2], [0.3, 0.1, 0.7]], [[0.8, -0.6], [0.8, 0.6], [0.0, 0.0], [], [0.6, 0.8]]]
WANTED = [[0.6, 0.8], [0.1, 0.7, 0.2], None, [0.6, None], [0.8, -0.6], []]


def odd_pairs(spark):
    """A bundle and its matched candidates, both with vectors of several widths, with gaps, and none."""
    def some(values, key, kind):
        table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"slot long, value {kind}")
        return lambda df: df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(len(values)))).join(F.broadcast(table), "slot").drop("slot")

    people_ = people(spark, crowd(30)).repartition(3).transform(some(PASSAGES, "candidate_id", "array<array<double>>")).withColumnRenamed("value", "vectors")
    jobs = several_jobs(spark, 12).transform(some(WANTED, "jd_id", "array<double>")).withColumnRenamed("value", "vector")
    bundle, = pp.job_bundles(jobs)
    return pp.match_terms(pp.candidate_facts(people_, AS_OF), bundle), bundle


def test_means_and_similarities_equal_the_expressions(spark):
    matched, bundle = odd_pairs(spark)
    matched = matched.cache()
    names = ["jd_id", "candidate_id", "row_hash", "first_means", "domain_mean", "sim"]
    by_expression, measured = (sorted(map(str, pp.pair_rows(x, bundle).select(*names).collect()))
                               for x in (matched, bl.measured(matched, bundle.matrix)))
    assert measured == by_expression and len(measured) == matched.count() * bundle.matrix.size
    assert len(set(re.findall(r"career_similarity=([^,]+),", " ".join(measured)))) > 3
    sums = [sorted(map(str, pp.score_rows(pp.pair_rows(x, bundle), apart).select("jd_id", "candidate_id", "row_hash", "specialization",
            "domain", "semantic_score", "cheap_score", "score").collect()))
            for x, apart in ((matched, False), (bl.measured(matched, bundle.matrix), True))]
    assert sums[0] == sums[1]


def test_pairs_are_scored_by_compiled_code(spark, tmp_path):
    """The JVM interprets methods of more than 8000 bytes."""
    made, bundle = odd_pairs(spark)
    made.limit(1).write.parquet(f"{tmp_path}/matched")
    matched = spark.read.schema(made.schema).parquet(f"{tmp_path}/matched")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = pp.score_rows(pp.pair_rows(bl.measured(matched, bundle.matrix), bundle), apart=True)
        wanted = scored.select("jd_id", "candidate_id", *pp.DIMENSION_COLUMNS, "cheap_score", "score")
        plan = catalog.tidy(wanted, many=True)._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    above = plan.toString().split("BroadcastNestedLoopJoin")[0]
    assert "lambda" not in above and all("*(" in line for line in above.splitlines() if "Project" in line)
    sizes = [int(n) for part in code.split("== Subtree ") if "BroadcastNestedLoopJoin" in part or "score" in part
             for n in re.findall(r"maxMethodCodeSize:(\d+)", part)]
    assert sizes and max(sizes) <= 8000


def test_mean_of_positive_similarities(spark):
    rows = [(0.5, -0.1, 0.25, 0.0), (None, 0.3, None, 0.1), (-1.0, 0.0, None, -0.0), (float("nan"), 0.5, 0.1, 0.2)]
    found = spark.createDataFrame(rows, "a double, b double, c double, d double").select(ve.mean_positive([F.col(c) for c in "abcd"]).alias("m"))
    assert [str(r.m) for r in found.collect()] == [str((0.0 + 0.5 + 0.25) / 2), str((0.3 + 0.1) / 2), "0.0", "nan"]


def test_rounding_by_arithmetic_is_rounding(spark):
    rng = random.Random(8)
    values = [rng.random() for _ in range(4000)] + [rng.uniform(-30, 30) for _ in range(2000)]
    values += [s * (n + 0.5) * 1e-8 + d for n in rng.sample(range(10 ** 8), 2000) for s, d in ((1, 0.0), (-1, 0.0), (1, 1e-16), (1, -1e-11))]
    values += [0.0, -0.0, 1e-9, -1e-9, 1.0, 9.999999995, 1e16, -1e300, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    both = df.select(F.round("x", 8).alias("want"), catalog._rounded(F.col("x")).alias("got")).collect()
    assert [str(r.got) for r in both] == [str(r.want) for r in both]
