"""The pipeline stage by stage against brute force, and the registered queries."""

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from talentloom.llm import simhash, tiling

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        made.write.parquet(str(folder / name))
        before, docs = docs, spark.read.parquet(str(folder / name))
        out.append((name, before, docs))
    return out


def test_stages(stages):
    seen = {name: (a.toPandas(), b.toPandas()) for name, a, b in stages}
    before, after = seen["language"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) >= 0.95 * len(before)
    before, after = seen["near_duplicates"]
    assert set(after.doc_id) < set(before.doc_id)
    before, after = seen["decontamination"]
    bad = {r["doc_id"] for r in tiling.contaminated(stages[2][1], stages[2][1].sparkSession.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert set(after.doc_id) == set(before.doc_id) - bad and bad
    before, after = seen["mixture"]
    assert max(Counter(after.doc_id).values()) <= 3 and set(after.doc_id) <= set(before.doc_id)
    before, after = seen["shards"]
    assert Counter(before.doc_id) == Counter(after.doc_id)
    sizes = after.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for name, a, b in stages[:-1]:
        assert a.columns == b.columns, name


def test_near_duplicates_equal_brute_force(stages):
    before, after = stages[1][1].toPandas(), stages[1][2].toPandas()
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in zip(before.doc_id, before.text, strict=True)}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(after.doc_id) == sorted({find(i) for i in prints})


def test_run_equals_its_stages(spark, stages):
    want = Counter(map(tuple, stages[-1][2].collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == want


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
