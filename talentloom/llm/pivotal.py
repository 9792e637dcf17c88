"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. Its whole part is certain; the
rest is a probability. Two documents pass words between them at random, in a way that keeps both expectations, until one
of the probabilities is 0 or 1; the other goes on to the next pair. Groups of 64 neighbours are paired in one row; what
remains of each group meets on the next level, up to one open probability per source. A source's taken words therefore
differ from its target by at most one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import WORD, cut, free_name, numbered, row_key

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
GROUP = 64
_ITEM = "struct<n:bigint,size:double,p:double>"
_DONE = "array<struct<n:bigint,up:boolean>>"
_NONE = 1e-12


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source with its source_size.

    Sources take ``weights`` in turn, by code point with null last, and share the whole of all sizes. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight. In the order of size / weight the stopped
    sources come first, so the common level of the others follows from running sums. One row per source meets in one
    task; texts do not.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    weighed = sizes.withColumn("_weight", turn).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    rising = weighed.withColumn("_rise", F.col("_cap") / F.col("_weight"))
    before = Window.orderBy("_rise", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    level = ((F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), zero))
             / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), zero)))
    levelled = rising.withColumn("_level", level)
    common = F.min(F.when(F.col("_rise") >= F.col("_level"), F.struct("_rise", "_level"))).over(everything)["_level"]
    return levelled.withColumn("target", F.least("_cap", F.coalesce(common, zero) * F.col("_weight"))).select(
        "source", "source_size", "target")


def _draw(seed: int, *of: Column) -> Column:
    """Uniform in [0, 1), the same for the same arguments."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") / F.lit(float(1 << 53))


def _pair(state: Column, item: Column, seed: int) -> Column:
    """One step: the open item of ``state`` and ``item`` pass words until one is settled."""
    a, b = state["open"], item
    room_a, has_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
    room_b, has_b = (1 - b["p"]) * b["size"], b["p"] * b["size"]
    to_a, to_b = F.least(room_a, has_b), F.least(has_a, room_b)
    gives_a = _draw(seed, a["n"], b["n"]) * (to_a + to_b) < to_b
    a_settles = F.when(gives_a, room_a <= has_b).otherwise(has_a <= room_b)
    p_a = F.when(a_settles, F.when(gives_a, 1.0).otherwise(0.0)).otherwise(
        F.when(gives_a, a["p"] + has_b / a["size"]).otherwise(a["p"] - room_b / a["size"]))
    p_b = F.when(~a_settles, F.when(gives_a, 0.0).otherwise(1.0)).otherwise(
        F.when(gives_a, b["p"] - room_a / b["size"]).otherwise(b["p"] + has_a / b["size"]))
    settled = F.when(a_settles, F.struct(a["n"].alias("n"), gives_a.alias("up"))).otherwise(
        F.struct(b["n"].alias("n"), (~gives_a).alias("up")))
    open_ = F.when(a_settles, F.struct(b["n"].alias("n"), b["size"].alias("size"), p_b.alias("p"))).otherwise(
        F.struct(a["n"].alias("n"), a["size"].alias("size"), p_a.alias("p")))
    whole = (open_["p"] < _NONE) | (open_["p"] > 1 - _NONE)
    both = F.concat(state["done"], F.array(settled),
                    F.when(whole, F.array(F.struct(open_["n"].alias("n"), (open_["p"] > 0.5).alias("up"))))
                    .otherwise(F.array().cast(_DONE)))
    return F.when(a.isNull(), F.struct(item.alias("open"), state["done"].alias("done"))).otherwise(
        F.struct(F.when(~whole, open_).alias("open"), both.alias("done")))


def round_copies(items: DataFrame, rows: int, seed: int = 0, group: int = GROUP) -> DataFrame:
    """(n, up) for items (source_no, n, size, p) with size > 0 and 0 < p < 1; n are row numbers below ``rows``.

    Each level groups neighbouring numbers of a source, at most ``group`` of them, so no source is gathered anywhere."""
    level, span, out = items, group, None
    while True:
        start = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast(_DONE).alias("done"))
        listed = F.sort_array(F.collect_list(F.struct("n", "size", "p")))
        state = cut(level.groupBy("source_no", F.floor(F.col("n") / span).alias("_group")).agg(listed.alias("_items"))
                    .select("source_no", F.aggregate("_items", start, lambda s, x: _pair(s, x, seed)).alias("_s"))
                    .select("source_no", "_s.open", "_s.done"))
        done = state.select(F.explode("done").alias("d")).select("d.n", "d.up")
        out = done if out is None else out.union(done)
        level = state.filter("open is not null").select("source_no", "open.n", "open.size", "open.p")
        if span >= rows:
            return out.union(level.select("n", (_draw(seed, F.col("n")) < F.col("p")).alias("up")))
        span *= group


def copies(rows: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``rows`` (doc_id, source, size, key) with source_size, target and copies.

    ``key`` tells rows with equal ids apart; rows equal in everything are interchangeable. Rows of size 0 draw on their
    own. Sources of size 0 have target 0 and no copies. An empty table stays empty.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, weights, most).withColumn("source_no", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last()))).withColumnRenamed("source", "_source"))
    placed = numbered(rows, [F.col("source").asc_nulls_last(), F.desc("size"), F.col("doc_id"), F.col("key")], "n")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    fair = (placed.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_base", F.floor(share)).withColumn("p", share - F.floor(share)))
    open_ = (F.col("size") > 0) & F.col("p").between(_NONE, 1 - _NONE)
    total = placed.count()
    rounded = round_copies(fair.filter(open_).select("source_no", "n", F.col("size").cast("double").alias("size"), "p"), total, seed)
    alone = F.when(F.col("size") > 0, F.col("p") >= 0.5).otherwise(_draw(seed, F.col("n")) < F.col("p"))
    return (fair.join(rounded, "n", "left")
            .withColumn("copies", (F.col("_base") + F.coalesce("up", alone).cast("long")).cast("int"))
            .drop("n", "_base", "p", "up", "source_no"))


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       row_key("doc_id", "text", "source").alias("key"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row; size counts words, null texts have none."""
    return copies(cut(_slim(docs)), seed).select("doc_id", "size", "source_size", "target", "copies",
                                            (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was given copies. Rows equal in id, text and source share the
    copies that they got together."""
    key, copy = free_name(docs, "_key"), free_name(docs, "_copy")
    given = copies(cut(_slim(docs)), seed).groupBy(F.col("key").alias(key)).agg(
        F.struct(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")).alias(copy))
    rows = docs.withColumn(key, row_key("doc_id", "text", "source")).join(given, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
    everyone, rest = F.floor(F.col(f"{copy}.all") / F.col(f"{copy}.rows")), F.col(f"{copy}.all") % F.col(f"{copy}.rows")
    times = rows.withColumn(copy, (everyone + F.when(place <= rest, 1).otherwise(0)).cast("int")).filter(F.col(copy) > 0)
    return times.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)
