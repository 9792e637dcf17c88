"""Benchmark decontamination by greedy string tiling.

Words that a document shares with a test item in runs of five seed the search. For every seeded (document, item) pair the
longest common runs of words are marked, longest first and never overlapping, by running Karp-Rabin; what share of the
item the tiles cover decides. Tiles count wherever they stand, so reordered passages are caught.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import numbered, strings, text_batches

SEED_WORDS = 5
COVERAGE = 0.8
#: Bytes of test items that one scan of the documents carries; larger test sets take more scans.
BLOCK_BYTES = 16 << 20
#: Characters of texts that a scan takes together; a longer text is taken alone.
SCAN_CHARS = 1 << 20
_WORDS = re.compile(r"[^\W_]+")
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _matches(pattern: list[int], text: list[int], used_p: list[bool], used_t: list[bool], length: int) -> list[tuple]:
    """Common unmarked runs of at least ``length`` words that cannot be extended, found by rolling hashes and verified."""
    def rolling(seq, used):
        top, value, run = pow(_BASE, length, _MODULUS), 0, 0
        for at, x in enumerate(seq):
            run = 0 if used[at] or x < 0 else run + 1
            value = 0 if not run else (value * _BASE + x + 1 - (seq[at - length] + 1) * top) % _MODULUS if run > length \
                else (value * _BASE + x + 1) % _MODULUS
            if run >= length:
                yield value, at - length + 1

    table = defaultdict(list)
    for value, at in rolling(pattern, used_p):
        table[value].append(at)
    found = set()
    for value, t in rolling(text, used_t):
        for p in table.get(value, ()):
            if p and t and pattern[p - 1] == text[t - 1] and not used_p[p - 1] and not used_t[t - 1]:
                continue  # part of a longer run, found from its start
            size = 0
            while (p + size < len(pattern) and t + size < len(text) and pattern[p + size] == text[t + size]
                   and not used_p[p + size] and not used_t[t + size]):
                size += 1
            if size >= length:
                found.add((-size, p, t))
    return list(found)


def tiles(pattern: list[int], text: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length): the longest unmarked common run is taken again and again, ties by
    place in the pattern, then in the text. Negative numbers match nothing."""
    used_p, used_t, out = [False] * len(pattern), [False] * len(text), []
    length = max(least, len(pattern) // 2)
    while True:
        heap = _matches(pattern, text, used_p, used_t, length)
        heapq.heapify(heap)
        while heap:
            size, p, t = heapq.heappop(heap)
            free = [not (used_p[p + i] or used_t[t + i]) for i in range(-size)]
            if all(free):
                for i in range(-size):
                    used_p[p + i] = used_t[t + i] = True
                out.append((p, t, -size))
                continue
            at = 0
            while at < -size:  # what other tiles have left of it goes back into the queue
                end = at
                while end < -size and free[end]:
                    end += 1
                if end - at >= length:
                    heapq.heappush(heap, (at - end, p + at, t + at))
                at = end + 1
        if length <= least:
            return sorted(out)
        length = max(least, length // 2)


class Items:
    """A block of test items: word numbers, and the hashes of their seed runs by run length."""

    def __init__(self, rows: list[tuple[object, str]], seed: int = SEED_WORDS):
        self.vocabulary: dict[str, int] = {}
        self.items, seeds = [], defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            if not ids:
                continue  # an item without words is found nowhere
            width = min(seed, len(ids))
            for at, value in enumerate(self.hashes(np.array(ids), width).tolist()):
                seeds[width][value].append((len(self.items), at))
            self.items.append((item_id, ids))
        self.seeds = {}
        for width, places in seeds.items():
            known = sorted(places)
            where = np.array([at for value in known for at in places[value]], dtype=np.int64)
            ends = np.cumsum([len(places[value]) for value in known])
            self.seeds[width] = (np.array(known, dtype=np.uint64), ends, where[:, 0], where[:, 1])

    @staticmethod
    def hashes(ids: np.ndarray, width: int) -> np.ndarray:
        values, n = ids.astype(np.uint64) + np.uint64(1), max(0, len(ids) - width + 1)
        out = np.zeros(n, dtype=np.uint64)
        for at in range(width):
            out = (out ^ values[at:at + n]) * _STEP
            out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[str], coverage: float) -> Iterator[tuple[int, object, int, int, int]]:
        """(text number, item_id, matched words, words of the item, tiles) of the pairs that reach the coverage. Texts are
        taken together up to a number of characters, and seeds one text at a time, so long texts do not add up."""
        begin, size = 0, 0
        for at, text in enumerate(texts):
            if at > begin and size + len(text) > SCAN_CHARS:
                yield from self._scan(texts[begin:at], begin, coverage)
                begin, size = at, 0
            size += len(text)
        yield from self._scan(texts[begin:], begin, coverage)

    def _scan(self, texts: list[str], first: int, coverage: float) -> Iterator[tuple[int, object, int, int, int]]:
        get = self.vocabulary.get
        parts, starts, at = [], [], 0
        for text in texts:
            ids = [get(w, -1) for w in words(text)]
            starts.append(at)
            parts += ids
            parts.append(-1)
            at += len(ids) + 1
        ids = np.array(parts, dtype=np.int64)
        bad = np.r_[0, np.cumsum(ids < 0)]
        seeded = []
        for width, (known, ends, items, places) in self.seeds.items():
            values = self.hashes(ids, width)
            slot = np.minimum(np.searchsorted(known, values), len(known) - 1)
            hits = np.flatnonzero((known[slot] == values) & (bad[width:] == bad[:-width])[: len(values)])
            owners = np.searchsorted(starts, hits, "right") - 1
            seeded.append((width, ends, items, places, hits, slot[hits], owners))
        for owner in sorted({x for *_, owners in seeded for x in owners.tolist()}):
            pairs = []
            for width, ends, items, places, hits, slot, owners in seeded:
                mine = slice(*np.searchsorted(owners, (owner, owner + 1)))
                end = ends[slot[mine]]
                count = end - np.where(slot[mine] > 0, ends[slot[mine] - 1], 0)
                at = np.repeat(end - np.cumsum(count), count) + np.arange(count.sum())  # every place of every hit
                order = np.argsort(items[at], kind="stable")
                found = items[at][order]
                cuts = np.flatnonzero(np.diff(found)) + 1
                spots, held = np.repeat(hits[mine], count)[order], places[at][order]
                pairs += [(int(item[0]), width, t, p) for item, t, p in zip(
                    np.split(found, cuts), np.split(spots, cuts), np.split(held, cuts), strict=True) if len(item)]
            for item, width, hit, place in sorted(pairs, key=lambda x: x[0]):
                item_id, pattern = self.items[item]
                run = np.arange(width)
                if len(np.unique(np.unique(place)[:, None] + run)) < coverage * len(pattern):
                    continue  # tiles lie within seeds, so they cannot cover more
                text, last = [], None
                for spot in np.unique(np.unique(hit)[:, None] + run).tolist():
                    if last is not None and spot != last + 1:
                        text.append(-1)
                    text.append(int(ids[spot]))
                    last = spot
                got = tiles(pattern, text, width)
                matched = sum(x[2] for x in got)
                if matched >= coverage * len(pattern):
                    yield first + owner, item_id, matched, len(pattern), len(got)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The test items in blocks of bounded size, each to be held against all documents."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    each = max(1, block_bytes // max(1, longest))
    if total <= each:
        yield Items(rows.orderBy("item_id", "text").collect())
        return
    placed = numbered(rows, [F.col("item_id"), F.col("text")], "_n")
    for at in range(0, total, each):
        yield Items(placed.filter(F.col("_n").between(at, at + each - 1)).select("item_id", "text").collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, matched, item_words, coverage, tiles) of every pair whose tiles cover at least ``coverage`` of
    the item's words.

    Words are runs of letters and digits in lower case; tiles have five words at least, or the whole item where it is
    shorter. Null and empty texts match nothing; equal items and repeated documents each give their rows.
    """
    types = {f.name: f.dataType.simpleString() for f in [*docs.select("doc_id").schema, *benchmark.select("item_id").schema]}
    schema = (f"doc_id {types['doc_id']}, item_id {types['item_id']}, matched long, item_words long, coverage double, tiles long")

    def scanned(items: Items) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches):
                found = list(items.scan(strings(batch.column("text")), coverage))
                if found:
                    owner, item, matched, size, count = zip(*found, strict=True)
                    share = pa.array(np.array(matched) / np.array(size))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(owner)), pa.array(item), pa.array(matched, pa.int64()),
                         pa.array(size, pa.int64()), share, pa.array(count, pa.int64())],
                        names=["doc_id", "item_id", "matched", "item_words", "coverage", "tiles"])
        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out = None
    for items in blocks(benchmark, block_bytes):
        out = scanned(items) if out is None else out.union(scanned(items))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that a test item contaminates; all columns stay and nothing is shuffled."""
    for items in blocks(benchmark, block_bytes):
        def run(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[x[0] for x in items.scan(strings(batch.column("text")), coverage)]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
