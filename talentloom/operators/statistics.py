"""Whole-column statistics: normalisation, z-scores, exact quantiles, percentile ranks.

One-row aggregates are broadcast back. Quantiles and ranks never gather a whole
column in one task: values are counted first, then narrowed by histogram passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.plans.storage import shared_folder

_MAX_COLLECTED = 100_000
_ACCURACY = 10_000
#: Size of a quantile sketch; its rank error is about 0.5 % of all values.
SKETCH_SIZE = 800


def _joint_values(values: DataFrame, probabilities: Sequence[float]) -> dict[float, tuple[float, float, float]]:
    """For each probability the two values of the column ``x`` around its spot, p * (n - 1), and the spot's fraction; empty
    without values. All probabilities are narrowed together.

    One scan counts and sketches, one counts below and within a bracket around each spot, one fetches the distinct values of all
    brackets with their counts. Brackets are values of the column, so infinities and skewed scales need no special treatment.
    Only where a bracket misses its spot or still holds too many values, two more scans narrow it.
    """
    x, margin = F.col("x"), 3.0 / _ACCURACY
    asked = list(dict.fromkeys(probabilities))

    def marks(at: float) -> list[float]:
        return [min(1.0, max(0.0, at - margin)), min(1.0, max(0.0, at + margin))]

    first = values.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
                       F.percentile_approx(x, [m for p in asked for m in marks(p)], _ACCURACY).alias("marks")).first()
    size = first["n"]
    if not size:
        return {}
    spots = {p: (int(p * (size - 1)), min(int(p * (size - 1)) + 1, size - 1)) for p in asked}
    brackets = {p: (first["marks"][2 * i], first["marks"][2 * i + 1]) for i, p in enumerate(asked)}
    under, tried = {}, set()
    while True:
        counts = [F.struct(F.count_if(x < low).alias("under"), F.count_if((x >= low) & (x <= high)).alias("n")).alias(f"c{i}")
                  for i, (low, high) in enumerate(brackets.values())]
        seen, narrow = values.agg(*counts).first(), {}
        for i, (p, (low, high)) in enumerate(list(brackets.items())):
            under[p], n = seen[f"c{i}"]
            inside = under[p] <= spots[p][0] and spots[p][1] < under[p] + n
            if not inside:  # all values are a bracket that holds every spot
                brackets[p], under[p], n = (first["low"], first["high"]), 0, size
                low, high = brackets[p]
            if n > _MAX_COLLECTED and low != high and (p, low, high) not in tried:
                tried.add((p, low, high))
                narrow[p] = (spots[p][0] - under[p]) / (n - 1)
        if not narrow:
            break
        cuts = [F.percentile_approx(F.when((x >= brackets[p][0]) & (x <= brackets[p][1]), x), marks(at), _ACCURACY).alias(f"c{i}")
                for i, (p, at) in enumerate(narrow.items())]
        found = values.agg(*cuts).first()
        brackets |= {p: tuple(found[f"c{i}"]) for i, p in enumerate(narrow)}
    wanted = reduce(lambda a, b: a | b, [(x >= low) & (x <= high) for low, high in brackets.values()])
    rows = values.where(wanted).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x")
    out, reached = {p: [None, None] for p in asked}, dict(under)
    for row in rows.toLocalIterator():  # sorted by ranges; the driver holds one range at a time
        for p, (low, high) in brackets.items():
            if low <= row["x"] <= high or row["x"] == low:
                reached[p] += row["n"]
                for side in (0, 1):
                    if out[p][side] is None and spots[p][side] < reached[p]:
                        out[p][side] = row["x"]
        if all(pair[1] is not None for pair in out.values()):
            break
    return {p: (*out[p], p * (size - 1) - spots[p][0]) for p in asked}


def sketches(df: DataFrame, keys: Sequence[str], column: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, n, sketch): one mergeable quantile sketch of the column per group (NULL and NaN ignored); groups without a value
    have none. Sketches of parts, days or batches can be stored and merged in any order."""
    x = F.col(column).cast("double")
    return (df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, size).alias("sketch")))


def merged_sketches(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, sketch) from stored sketches, merged where they share the keys."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(stored: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys, n, p, value) of every group of stored sketches."""
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    found = F.arrays_zip(asked.alias("p"), F.kll_sketch_get_quantile_double("sketch", asked).alias("value"))
    return merged_sketches(stored, keys).select(*keys, "n", F.inline(found).alias("p", "value"))


def sketched_rank(stored: DataFrame, keys: Sequence[str], value: float) -> DataFrame:
    """(keys, n, percentile_rank): the share of each group's values that are not above ``value``."""
    rank = F.kll_sketch_get_rank_double("sketch", F.lit(float(value)))
    return merged_sketches(stored, keys).select(*keys, "n", rank.alias("percentile_rank"))


def quantiles_by_group(df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float],
                       accuracy: int = 100_000) -> DataFrame:
    """Approximate quantiles of each group, one sketch per group and task: (keys, p, value)."""
    sketched = df.groupBy(*keys).agg(F.percentile_approx(
        F.col(column).cast("double"), list(probabilities), accuracy).alias("_v"))
    zipped = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("_v").alias("value"))
    return sketched.select(*keys, F.inline(zipped).alias("p", "value"))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Exact, linearly interpolated quantiles of a column (NULLs ignored)."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")

    at = _joint_values(values, probabilities)
    if not at:
        return [None] * len(probabilities)
    return [low if low == high or part == 0 else low + (high - low) * part for low, high, part in (at[p] for p in probabilities)]


def normalize(df: DataFrame, column: str, strategy: str = "robust", output: str = "normalized") -> DataFrame:
    """Add a normalised column: robust (median and IQR), minmax or standard.

    Unknown strategies mean robust; a constant column becomes 0.
    """
    x = F.col(column).cast("double")
    if strategy in ("minmax", "standard"):
        stats = df.agg(*(
            [F.min(x).alias("_shift"), (F.max(x) - F.min(x)).alias("_scale")] if strategy == "minmax"
            else [F.avg(x).alias("_shift"), F.stddev_pop(x).alias("_scale")]))
        joined = df.join(F.broadcast(stats), F.lit(True))
        shift, scale = F.col("_shift"), F.col("_scale")
    else:
        q1, median, q3 = exact_quantiles(df, column, (0.25, 0.5, 0.75))
        joined = df
        shift, scale = F.lit(median).cast("double"), F.lit(None if q1 is None else q3 - q1).cast("double")
    value = F.when(scale == 0, F.lit(0.0)).otherwise((x - shift) / scale)
    return joined.withColumn(output, value).drop("_shift", "_scale")


def z_scores(df: DataFrame, columns: Sequence[str], suffix: str = "_z_score") -> DataFrame:
    """z-scores against the table's mean and sample deviation, 0 without spread."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_s_{c}")]
    joined = df.join(F.broadcast(df.agg(*aggs)), F.lit(True))
    scores = [F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise(
        (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}{suffix}") for c in columns]
    return joined.select(*df.columns, *scores)


def corpus_z_scores(facts: DataFrame) -> DataFrame:
    """z-scores of experience, skill count, endorsements, response rate and completeness."""
    named = facts.select(
        "candidate_id", F.col("years").cast("double").alias("experience"),
        F.col("skill.total_skills").cast("double").alias("skills"),
        F.col("skill.avg_endorsements").alias("endorsements"),
        F.col("response_rate"), F.col("completeness"))
    columns = ["experience", "skills", "endorsements", "response_rate", "completeness"]
    return z_scores(named, columns).select("candidate_id", *[f"{c}_z_score" for c in columns])


def running_statistics(column: str) -> list[Column]:
    """n, mean, sample variance and deviation (0 below two values), min and max."""
    x = F.col(column).cast("double")
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
        F.min(x).alias("min_val"), F.max(x).alias("max_val"),
    ]


def percentile_rank(df: DataFrame, column: str, output: str = "percentile_rank") -> DataFrame:
    """Share of rows with a value not above the row's own.

    Distinct values are counted (a hot value is one row) and range-partitioned, as many ranges as there are shuffle
    partitions, into a table of the shared folder; sums within a range and before it give each value's rank.
    """
    x = F.col(column).cast("double")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    path = shared_folder(spark, "ranges")
    counts.repartitionByRange(parts, "_v").withColumn("_r", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema("_v double, _n long, _r int").parquet(path)
    totals = ranged.groupBy("_r").agg(F.sum("_n").alias("_t"))
    # one row per range: the running total over ranges is a small window
    ahead = totals.select(
        "_r", (F.sum("_t").over(Window.orderBy("_r")) - F.col("_t")).alias("_before"),
        F.sum("_t").over(Window.partitionBy()).alias("_all"))
    inner = F.sum("_n").over(Window.partitionBy("_r").orderBy("_v"))
    ranks = ranged.withColumn("_cum", inner).join(F.broadcast(ahead), "_r").select(
        "_v", ((F.col("_cum") + F.col("_before")) / F.col("_all")).alias(output))
    return df.join(ranks, x == F.col("_v"), "left").drop("_v")


def percentile_of(df: DataFrame, column: str, value: float) -> DataFrame:
    """Share of the column not above one value; 0.5 for an empty column."""
    share = F.avg((F.col(column) <= value).cast("double"))
    return df.agg(F.coalesce(share, F.lit(0.5)).alias("percentile_rank"))
