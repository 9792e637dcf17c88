"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits that differ in at most 4 bits, cut into 3 segments, have a segment that differs in at most one
bit. Every fingerprint is indexed under each segment with one bit left out (64 variants); two such fingerprints share a
variant, which an equality shuffle brings together, and the full distance is then verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import cut, free_name, row_key, text_batches, utf8
from talentloom.llm.graph import components

DISTANCE = 4
#: First bit and width of the segments; the last lacks nothing: 22 + 21 + 21 = 64.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets up to this size are compared by shifted arrays, larger ones by a search that grows clusters.
_SMALL = 8
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit majority of the hashes of all word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([_hash(joined)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
        hashes = np.fromiter((_hash(joined[a:b]) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)),
                             dtype=np.uint64, count=len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``docs`` with the signed 64-bit column ``fp`` in place of the text."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fps = np.array([fingerprint(x, width) for x in utf8(batch.column(text))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps)], names=[*kept, "fp"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprint words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _cluster(prints: np.ndarray, distance: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Cluster labels and tree edges among fingerprints within ``distance``; each node meets only nodes not yet reached."""
    label, edges, left = np.full(len(prints), -1), [], np.arange(len(prints))
    while len(left):
        seed, left = left[0], left[1:]
        label[seed], queue = seed, [seed]
        while queue and len(left):
            at = queue.pop()
            near = _apart(prints[left], prints[at]) <= distance
            found = left[near]
            left, label[found] = left[~near], seed
            edges += [(at, x) for x in found.tolist()]
            queue += found.tolist()
    return label, edges


def _large_bucket(side: np.ndarray, prints: np.ndarray, first: bool, distance: int) -> list[tuple[int, int]]:
    """Tree edges (places) of one variant bucket; ``side`` is the left-out bit. Members that agree in it meet in the
    segment's first bucket too; only there are their own edges given out."""
    out, groups = [], []
    for at in (np.flatnonzero(~side), np.flatnonzero(side)):
        label, edges = _cluster(prints[at], distance)
        groups.append((at, label))
        if first:
            out += [(int(at[x]), int(at[y])) for x, y in edges]
    (a, la), (b, lb) = groups
    roots = {("a", x): ("a", x) for x in set(la.tolist())} | {("b", x): ("b", x) for x in set(lb.tolist())}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    clusters = len(roots)
    for i in range(len(a)):
        if clusters == 1:
            break
        near = np.flatnonzero(_apart(prints[b], prints[a[i]]) <= distance)
        for x, j in zip(*np.unique(lb[near], return_index=True), strict=True):
            p, q = root(("a", int(la[i]))), root(("b", int(x)))
            if p != q:
                roots[q], clusters = p, clusters - 1
                out.append((int(a[i]), int(b[near[j]])))
    return out


def _bucket_edges(keys: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges, as places, of whole buckets sorted by key; ``prints`` (rows x words) are what the distance is taken of."""
    sides, keys = keys & 1 == 1, keys >> 1
    bits = (keys >> 24) & 63
    first = np.isin(bits, [o for o, _ in SEGMENTS])
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    for lag in range(1, _SMALL):
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & (size_of[:-lag] <= _SMALL))
        take = _apart(prints[at], prints[at + lag]) <= distance
        at = at[take]
        # who agrees in the left-out bit meets in the segment's first bucket too
        take = (sides[at] != sides[at + lag]) | first[at]
        yield at[take], at[take] + lag
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        part = slice(start, start + size)
        found = _large_bucket(sides[part], prints[part], bool(first[start]), distance)
        yield tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T + start)


def _variants(signature: str, number: int) -> list[Column]:
    """The 64 bucket keys of a signature: its number, the place of the left-out bit, that bit's segment without it, and last
    the left-out bit itself, which does not divide the bucket."""
    keys = []
    for offset, width in SEGMENTS:
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            rest = F.shiftrightunsigned(signature, offset).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((64 * number + offset + bit) << 24))
            own = F.shiftrightunsigned(signature, offset + bit).bitwiseAND(F.lit(1))
            keys.append(F.shiftleft(rest.cast("long"), 1).bitwiseOR(own).cast("long"))
    return keys


def _whole_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by key, in tables that hold all rows of their buckets; nothing is copied twice."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy() >> 1
        start = int(np.searchsorted(keys, keys[-1]))
        if held and (start or held[-1].column("key")[-1].as_py() >> 1 != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks()
            held = []
        elif start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def links(nodes: DataFrame, node: str, signatures: list[str], prints: list[str], distance: int) -> DataFrame:
    """Edges (a, b) between rows of ``nodes`` whose ``prints`` differ in at most ``distance`` bits and that share a
    variant of a signature: in buckets of at most eight every link, in larger ones a spanning tree of each cluster, so
    that the edges grow with the buckets, not with their pairs. ``node`` is a long that names the row."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = list(dict.fromkeys([node, *prints]))
    rows = None
    for number, signature in enumerate(signatures):
        part = nodes.select(F.explode(F.array(*_variants(signature, number))).alias("key"), *kept)
        rows = part if rows is None else rows.union(part)
    rows = rows.repartition(parts, F.shiftright("key", 1)).sortWithinPartitions("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: pa.Table):
            column = lambda c: part.column(c).to_numpy()
            words = np.stack([column(c).view(np.uint64) for c in prints], axis=1)
            names = column(node)
            for a, b in _bucket_edges(column("key"), words, distance):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

        for part in _whole_buckets(batches):
            yield from edges(part)

    return rows.mapInArrow(run, "a long, b long")


def component_of(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component, component_id) for the distinct fingerprints of ``prints`` (doc_id, fp)."""
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("three segments with one wildcard find all links up to 5 bits")
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(first, "fp", ["fp"], ["fp"], distance)).withColumnRenamed("node", "fp")
    placed = first.join(roots, "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(named, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: component_id is the smallest doc_id that links of at most
    ``distance`` bits lead to, its own included.

    Null and blank texts have fingerprint 0, linked like any other. Null ids never become a component id unless all ids
    of the component are null. Repeated rows stay, each with the same answer. Other columns are not read.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text"), width=width))
    placed = component_of(prints, distance)
    return prints.join(placed, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, width: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (a null id only where all are null), of
    repeated ids the one with the smallest hash of id and text, of rows equal in both any. All columns stay."""
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    prints = cut(fingerprints(keyed.select("doc_id", key, "text"), width=width))
    placed = component_of(prints, distance)
    kept = (prints.join(placed, "fp").groupBy("component")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key].alias(key)).select(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
