"""Operators that prune, index, sketch or keep state, against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.functions import scalars as fx
from talentloom.operators import blocks as bl
from talentloom.operators import jobs as jo
from talentloom.operators import ranking as rk
from talentloom.operators import statistics as st
from talentloom.operators import termindex as ti
from talentloom.plans import catalog
from talentloom.plans import pairs as pp
from talentloom.plans import pipeline
from talentloom.sources import jobs as js
from talentloom.streaming import state as ss
from talentloom.streaming import topk as sk
from tests.test_library import JOB, people, person

AS_OF = "2024-01-31"


# -- pruning ------------------------------------------------------------------------------

def crowd(n=60, seed=1):
    """Candidates with odd values: ties, copies of an id, absent modes, no jobs, no skills."""
    rng = random.Random(seed)
    words = ["Python", "Spark", "retrieval", "Kafka", "production", "Rust", "search"]
    out = []
    for i in range(n):
        base = person(i)
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        career = [{**e, "description": " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))} for e in base["career_history"]] * rng.randint(0, 3)
        signals = {**base["platform_signals"], "willing_to_relocate": rng.random() < 0.5, "open_to_work_flag": rng.random() < 0.5}
        if rng.random() < 0.7:
            signals["preferred_work_mode"] = rng.choice(["remote", "onsite", "Hybrid", "flexible", ""])
        profile = {**base["profile"], "summary": text, "years_of_experience": rng.choice([0, 3, 4.5, 30]),
                   "current_title": rng.choice(["Senior Python Engineer", "Intern", ""])}
        out.append(person(i % 50, career_history=career, profile=profile, platform_signals=signals,
                          skills=[{"name": rng.choice(words), "proficiency": "expert", "endorsements": 20, "duration_months": 40}] * rng.randint(0, 2)))
    return out + [out[0], {"candidate_id": "bare"}]


def several_jobs(spark, n=9):
    rng = random.Random(2)
    extra = ["Kafka", "Docker", "Rust", "SQL", "hybrid", "on-site", "junior", ""]
    texts = [(f"j{i}", JOB.replace("Kafka", rng.choice(extra)).replace("remote", rng.choice(["remote", "hybrid", "on-site", "here"]))) for i in range(n)]
    return jo.hiring_profiles(js.jobs_from_text(spark.createDataFrame([*texts, ("none", "x")], "jd_id string, text string")))


def encoder():
    def make():  # local, so that it travels by value
        return lambda texts: np.array([[len(t) % 7 - 3.0, t.count("a") - 1.0, 1.0] for t in texts])
    return make


@pytest.mark.parametrize("k", [1, 3, 500])
def test_pruned_ranking_is_exact(spark, k):
    candidates = pipeline.with_vectors(people(spark, crowd()).repartition(3), encoder())
    profiles = pipeline.with_job_vectors(several_jobs(spark), encoder())
    key = lambda r: (r["jd_id"], r["rank"], r["candidate_id"], r["score"])
    whole = sorted(map(key, rk.rank_candidates(pp.score_pairs(candidates, profiles, AS_OF), k).collect()))
    assert sorted(map(key, pipeline.rank(candidates, profiles, AS_OF, k).collect())) == whole


def test_bounds_enclose_every_score(spark):
    candidates = pipeline.with_vectors(people(spark, crowd()), encoder())
    facts = pp.candidate_facts(candidates, AS_OF)
    bundle = pp.job_bundles(pipeline.with_job_vectors(several_jobs(spark), encoder()))[0]
    matched = pp.match_terms(facts, bundle).withColumn("need", bl._needed())
    batch = matched.select("need").toArrow().column("need").combine_chunks()
    batch = batch.chunk(0) if hasattr(batch, "chunk") else batch
    lower, upper = bl.bounds(bl._read(batch, bundle.matrix.vectors.shape[1]), bundle.matrix)
    scores = {}
    for r in pp.score_bundle(facts, bundle).select("jd_id", "candidate_id", "row_hash", "score").collect():
        scores.setdefault((r["candidate_id"], r["jd_id"]), []).append(r["score"])
    names = [r["jd_id"] for r in bundle.jobs.select("job.jd_id").collect()]
    for at, name in enumerate(matched.select("candidate_id").toArrow().column(0).to_pylist()):
        for j, job in enumerate(names):
            assert any(lower[at, j] <= s <= upper[at, j] for s in scores[name, job])
    assert np.all(upper - lower < 0.2)


def test_few_pairs_are_scored(spark):
    many = [person(i, profile={**person(i)["profile"], "years_of_experience": float(i % 40), "summary": "Python " * (i % 11)}) for i in range(600)]
    bundle = pp.job_bundles(several_jobs(spark))[0]
    matched = pp.match_terms(pp.candidate_facts(people(spark, many).repartition(2), AS_OF), bundle).cache()
    left = bl.open_pairs(matched, bundle.matrix, 3).count()
    assert 30 <= left < 600 * bundle.matrix.size / 5


def test_funnel_scores_what_the_cheap_cut_leaves(spark):
    candidates, profiles = people(spark, [person(i, profile={**person(i)["profile"], "years_of_experience": float(i)}) for i in range(30)]), several_jobs(spark)
    cuts = (12, 8, 6, 4, 2)
    rows = [r.asDict() for r in pp.score_pairs(candidates, profiles, AS_OF).select("jd_id", "candidate_id", "cheap_score", "score", *pp.DIMENSION_COLUMNS).collect()]
    want = set()
    for job in {r["jd_id"] for r in rows}:
        left = [r for r in rows if r["jd_id"] == job]
        for cut, stage in zip(cuts, (lambda r: r["cheap_score"], lambda r: r["semantic_relevance"], lambda r: r["evidence_strength"],
                                     lambda r: r["behavioral"] + r["recruitability"], lambda r: r["score"]), strict=True):
            left = sorted(left, key=lambda r: (-stage(r), r["candidate_id"]))[:cut]  # noqa: B023
        want |= {(r["jd_id"], r["candidate_id"], n + 1) for n, r in enumerate(left)}
    assert {(r["jd_id"], r["candidate_id"], r["rank"]) for r in pipeline.funnel(candidates, profiles, AS_OF, cuts).collect()} == want


def test_joined_fields_lose_white_space(spark):
    row = spark.createDataFrame([("\t a b\u00a0\n", " \r\n", None, "c")], "a string, b string, c string, d string").select(
        fx.join_fields(*[F.col(c) for c in "abcd"], separator="|").alias("v")).first()
    assert row["v"] == "a b|c"


def test_best_remembers_distinct_ids():
    rng = np.random.default_rng(3)
    best, seen = bl._Best(4, 3), {}
    for _ in range(20):
        ids = np.array([f"c{i}" for i in rng.integers(0, 15, 8)], dtype=object)
        lower = rng.integers(0, 30, (8, 3)) / 10
        best.add(ids, lower)
        for i, row in zip(ids, lower, strict=True):
            seen[i] = np.maximum(seen.get(i, -np.inf), row)
        for j in range(3):
            want = sorted((v[j] for v in seen.values()), reverse=True)[:4]
            assert best.scores[:, j].tolist()[: len(want)] == want


# -- the vocabulary index --------------------------------------------------------------------

def test_lookup_equals_contains():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    terms = [text(rng.randint(1, 6)) for _ in range(60)] + ["", "aa", "aa"]
    index = ti.Lookup(terms)
    for _ in range(300):
        words = text(rng.randint(0, 30))
        assert index.in_text(words) == {i for i, t in enumerate(terms) if t in words}
        assert sorted(set(index.around(words[:4]))) == [i for i, t in enumerate(terms) if words[:4] in t]
    assert index.in_text(None) == set() and index.around(None) == []
    assert ti.Lookup([]).in_text("a") == set() and ti.Lookup([]).around("") == []


# -- quantiles ---------------------------------------------------------------------------------

@pytest.mark.parametrize("bound", [3, 40, 100_000])
def test_joint_quantiles_equal_numpy(spark, monkeypatch, bound):
    monkeypatch.setattr(st, "_MAX_COLLECTED", bound)
    rng = random.Random(5)
    tables = ([rng.gauss(0, 10 ** rng.randint(0, 5)) for _ in range(3000)], [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(500)],
              [5.0], [1.0, float("inf"), float("-inf"), 0.0, 3.0], [7.0] * 900 + [float(i) for i in range(50)])
    probs = (0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0)
    for values in tables:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
        got = st.exact_quantiles(df, "x", probs)
        with np.errstate(invalid="ignore"):
            want = [np.sort(values)[int(p * (len(values) - 1))] if np.isinf(values).any() else np.quantile(values, p) for p in probs]
        for a, b, p in zip(got, want, probs, strict=True):
            if not np.isinf(values).any() or (p * (len(values) - 1)) % 1 == 0:
                assert a == pytest.approx(b, rel=1e-12), (p, a, b)
    assert st.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_sketches_merge(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), d, rng.expovariate(1)) for d in range(5) for _ in range(2000)] + [("a", 0, None), ("a", 0, float("nan")), ("z", 0, None)]
    stored = st.sketches(spark.createDataFrame(data, "g string, day int, x double").repartition(4), ["g", "day"], "x").cache()
    values = {g: np.sort([x for h, _, x in data if h == g and x is not None and x == x]) for g in "ab"}
    rows = st.sketched_quantiles(stored, ["g"], (0.05, 0.5, 0.9)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["n"] == len(values[r["g"]])
        assert abs(np.searchsorted(values[r["g"]], r["value"], "right") / r["n"] - r["p"]) < 0.015
    for r in st.sketched_rank(stored, ["g"], 1.0).collect():
        assert abs(np.searchsorted(values[r["g"]], 1.0, "right") / r["n"] - r["percentile_rank"]) < 0.015


# -- streams ---------------------------------------------------------------------------------

STREAM = "g string, id string, v double, t long, note string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(folder)


def reading(spark, folder):
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(folder)


def brute_best(rows, k):
    down = lambda v: float("inf") if v is None else float("-inf") if v != v else -v
    best, out = {}, []
    for g, i, v, t, note in rows:
        if i is not None and ((g, i) not in best or (down(v), t) < (down(best[g, i][0]), best[g, i][1])):
            best[g, i] = (v, t, note)
    for g in {g for g, _ in best}:
        mine = sorted((i for h, i in best if h == g), key=lambda i: (down(best[g, i][0]), i))[:k]
        out += [(g, i, str(best[g, i][0]), *best[g, i][1:], n + 1) for n, i in enumerate(mine)]
    return sorted(out, key=str)


def test_keyed_state_survives_a_restart(spark, tmp_path):
    ss.use_rocksdb(spark)
    rng = random.Random(7)
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/cp"
    everything = []
    for turn in range(2):  # the second query starts from the checkpoint of the first
        for _ in range(2):
            rows = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([None, *"abcdefghij"]), rng.choice([1.0, 2.5, float(rng.randint(0, 9)), None]),
                     rng.randint(0, 99), rng.choice(["x", None])) for _ in range(80)]
            everything += rows
            arrive(spark, folder, rows)
        ss.run(ss.best_rows(reading(spark, folder), ["g"], "id", "v", ["t"], 4, buckets=3), checkpoint).awaitTermination()
        now = ss.best_now(spark, checkpoint, ["g"], "id", "v", 4).select("g", "id", "v", "t", "note", "rank").collect()
        got = sorted(((r[0], r[1], str(r[2]), *r[3:]) for r in now), key=str)
        want = brute_best(everything, 4)
        assert [(g, i, v, t, n) for g, i, v, t, _, n in got] == [(g, i, v, t, n) for g, i, v, t, _, n in want], turn


def test_keep_best_reads_the_state(spark, tmp_path):
    ss.use_rocksdb(spark)
    folder, checkpoint, everything = f"{tmp_path}/in", f"{tmp_path}/cp", []
    for turn in range(2):
        rows = [("g", f"k{i % 9}", float((i * 7 + turn) % 11), i, "n") for i in range(40)]
        everything += rows
        arrive(spark, folder, rows)
        ss.run(sk.keep_best(reading(spark, folder), "id", "v", ["t"]), checkpoint).awaitTermination()
        best = {}
        for _, i, v, t, _ in everything:
            best[i] = min(best.get(i, (0.0, 1 << 60)), (-v, t))
        got = {(r["id"], r["v"], r["t"]) for r in sk.keep_best_now(spark, checkpoint, "id", "v", ["t"]).collect()}
        assert got == {(i, -v, t) for i, (v, t) in best.items()}


def test_progress_and_sketches_of_a_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for turn in range(3):
        arrive(spark, folder, [("g", f"k{i}", float(i), i, "n") for i in range(100 * (turn + 1))])
    stream = reading(spark, folder).observe("seen", F.count(F.lit(1)).alias("n"))
    log = sk.logged(spark, lambda: sk.sketch_batches(stream, ["g"], "v", f"{tmp_path}/sketches", f"{tmp_path}/cp"), f"{tmp_path}/log")
    rows = [r for r in log.collect() if r["event"] == "batch" and r["rows"]]
    assert sorted(r["rows"] for r in rows) == [100, 200, 300] and {r["event"] for r in log.collect()} >= {"started", "ended"}
    assert all(f'"n": {r["rows"]}' in r["observed"] for r in rows)
    found = st.sketched_quantiles(spark.read.parquet(f"{tmp_path}/sketches"), ["g"], (0.5,)).first()
    assert found["n"] == 600 and abs(found["value"] - 100) < 20


# -- plans ---------------------------------------------------------------------------------

def test_pruned_plan_has_no_shuffle_before_the_ranks(spark):
    bundle = pp.job_bundles(several_jobs(spark))[0]
    scored = pp.score_bundle(pp.candidate_facts(people(spark, crowd(5)), AS_OF), bundle, 3).select("jd_id", "candidate_id", "score", "row_hash")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


# -- all pairs ----------------------------------------------------------------------------

def test_all_pairs_lists_equal_the_expressions(spark):
    facts = pp.candidate_facts(people(spark, crowd(30)).repartition(3), AS_OF)
    bundle, = pp.job_bundles(several_jobs(spark, 5))
    matched = pp.match_terms(facts, bundle).cache()
    names = ["jd_id", "candidate_id", "row_hash", "matched_count", "evidence_score", "evidence_coverage", "evidence_density",
             "strong_count", "weak_count", "title_relevance", "relevant_months", "relevant_assessment", "unsupported_terms",
             "first_hits", "domain_hits"]
    rows = [sorted(map(str, pp.pair_rows(x, bundle).select(*names).collect())) for x in (matched, bl.measured(matched, bundle.matrix))]
    assert rows[0] == rows[1] and len(rows[0]) == matched.count() * bundle.matrix.size


def test_nested_candidates_are_not_shuffled(spark, tmp_path):
    docs = [(i, "one two. three\nfour five", "en", "web", 22) for i in (1, 2, 2, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "view", None), (None, "view", None)], "user_id long, event_type string, ts timestamp").write.parquet(
        f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2, [1.0, 0.0]), (None, [0.0, 1.0]), (9, [1.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = catalog._candidates(spark, str(tmp_path))
        assert "hashpartitioning(candidate_id" not in found._jdf.queryExecution().executedPlan().toString()
        seen = sorted((r["candidate_id"][-1], r["vectors"] is not None, r["platform_signals"]["profile_views_received_30d"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert seen == [("1", False, 1), ("2", True, 0), ("2", True, 0), ("l", True, 0)]


def test_format_dispatch_writes_one_array_a_task(spark, tmp_path, monkeypatch):
    ids = [*range(2000), 7, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    got = {tuple(r) for r in catalog.format_dispatch(spark, str(tmp_path)).select("source", "n", "n_ids").collect()}
    assert got == {("records.jsonl", 2001, 2000), ("records.json", 2001, 2000)}
    files = [p for p in (tmp_path / "formats" / "records.json").rglob("part-*") if p.is_file()]
    tasks = spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions()
    assert 1 <= len(files) <= tasks
    assert all(len(json.loads(p.read_text())) for p in files)
