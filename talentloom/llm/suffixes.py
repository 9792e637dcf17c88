"""Removal of repeated byte strings by hash-compared suffix sorting.

A string of ``length`` bytes occurs again if its suffix has a neighbour in suffix order with a common extension of at
least that length. The suffixes are not sorted in one place. Every window of ``length`` bytes is assigned to its anchor,
the seed string within it with the smallest hash; equal windows have equal anchors at equal offsets, so each anchor's
surroundings can be sorted on their own:

1. Windows with the same anchor position form a stretch. Stretches are counted by anchor and content. A stretch whose
   whole content occurs again is repeated as it stands.
2. Different stretches around one anchor are sorted twice, to the right and to the left of the anchor, by a mergesort
   that compares two suffixes through prefix polynomial hashes and binary search for their common extension. Neighbours'
   common extensions give, for every offset, the classes of equal windows.
3. Common extensions that decide anything are verified byte by byte; a collision sends the batch to direct comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import cut, text_batches, utf8

LENGTH = 200
SEED = 32
#: Stretches around one anchor that are sorted in one piece; larger groups are divided by longer common cores first.
GROUP_LIMIT = 100_000
#: Offsets that one core serves when a group is divided.
CORE_OFFSETS = 8
#: Bits of the filter that spares unshared stretches the shuffle (32 MB at most).
MOST_SIEVE_BITS = 28
_BASE = np.uint64(0x9E3779B97F4A7C55)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 22
_BATCH_BYTES = 16 << 20


def _powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64), out=out[1:]) if n else None
    return out


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] is the polynomial hash of data[:i] times a power that depends on i alone, so that differences are sums of
    byte * base**position; comparing two places multiplies by the power between them."""
    powers = _powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=out[1:])
    return out


def stretches(data: bytes, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """First window, last window, anchor position and anchor hash of each stretch of windows with one anchor, in arrays.

    The anchor is the leftmost of the seeds with the smallest hash in the window. Long texts are read in pieces.
    """
    windows = len(data) - length + 1
    span = length - seed + 1
    raw = np.frombuffer(data, dtype=np.uint8)
    for begin in range(0, windows, _CHUNK):
        count = min(_CHUNK, windows - begin)
        part = raw[begin:begin + count + length - 1].astype(np.uint64)
        value, step, size = np.zeros(len(part) - seed + 1, dtype=np.uint64), part + np.uint64(1), 1
        power = _BASE  # doubling: the hash of 2k bytes from two hashes of k bytes
        while size < seed:
            step = step[:len(step) - size] * power + step[size:]
            power, size = np.uint64(int(power) ** 2 & (1 << 64) - 1), size * 2
        value = step[:len(value)] * _MIX
        value ^= value >> np.uint64(32)
        value *= _BASE
        low = np.uint64((1 << 24) - 1)
        keyed = (value & ~low) | np.arange(len(value), dtype=np.uint64)
        least = _window_minimum(keyed, span)
        anchors = (least & low).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        ends = np.r_[starts[1:], count] - 1
        at = anchors[starts]
        yield starts + begin, ends + begin, at + begin, value[at].view(np.int64)


def _window_minimum(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, by running minima of blocks from both sides."""
    n = len(x) - span + 1
    size = -(-len(x) // span) * span
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1:span - 1 + n])


class _Suffixes:
    """Suffixes of many byte strings, compared by hashes; ``limit`` bytes at most count."""

    def __init__(self, parts: list[bytes], exact: bool = False):
        self.parts, self.exact = parts, exact
        self.sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]] if len(parts) else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.hashes = _prefix_hashes(self.data)
        self.powers = _powers(len(self.data))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of strings a and b, by binary search on hashes (or byte by byte)."""
        if self.exact:
            return np.array([_common(self.parts[i], self.parts[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)],
                            dtype=np.int64)
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.sizes[a], self.sizes[b])
        x, y = self.starts[a], self.starts[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        shift = self.powers[y - x]
        hx, hy = self.hashes[x], self.hashes[y]
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = (self.hashes[x + middle] - hx) * shift == self.hashes[y + middle] - hy
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether string a sorts before b; equal strings count as before where ``ties``."""
        shared = self.extension(a, b)
        end_a, end_b = shared >= self.sizes[a], shared >= self.sizes[b]
        last = max(0, len(self.data) - 1)
        left = self.data[np.minimum(self.starts[a] + shared, last)]
        right = self.data[np.minimum(self.starts[b] + shared, last)]
        return np.where(end_a & end_b, ties, np.where(end_a, True, np.where(end_b, False, left < right)))

    def sort(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings within their groups (ascending and contiguous), and each one's common extension with the
        one before it (0 at the start of a group). All groups' runs are merged together, level by level."""
        n = len(groups)
        order = np.arange(n)
        first = np.searchsorted(groups, groups, "left")
        size = np.searchsorted(groups, groups, "right") - first
        width = 1
        while width < int(size.max(initial=1)):
            place = np.arange(n) - first
            run = place // width
            own, sibling = first + run * width, first + (run ^ 1) * width
            end = np.minimum(sibling + width, first + size)
            move = np.flatnonzero(sibling < first + size)
            low, high = sibling[move].copy(), end[move].copy()
            item, second = order[move], (run[move] & 1) == 1
            while (at := np.flatnonzero(low < high)).size:
                middle = (low[at] + high[at]) // 2
                # a member of the second run goes behind its equals in the first
                late, x, y = second[at], item[at], order[middle]
                goes = self.before(np.where(late, x, y), np.where(late, y, x), False) ^ late
                low[at] = np.where(goes, middle + 1, low[at])
                high[at] = np.where(goes, high[at], middle)
            target = np.minimum(own[move], sibling[move]) + (move - own[move]) + (low - sibling[move])
            fresh = order.copy()
            fresh[target] = item
            order, width = fresh, width * 2
        shared = np.zeros(n, dtype=np.int64)
        inner = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        shared[inner] = self.extension(order[inner - 1], order[inner])
        return order, shared

    def verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours really agree in their common extension: a hash collision can only make it too long."""
        for at in np.flatnonzero(shared).tolist():
            a, b, k = self.parts[order[at - 1]], self.parts[order[at]], int(shared[at])
            if a[:k] != b[:k]:
                return False
        return True


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _classes(parts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    suffixes = _Suffixes(parts)
    order, shared = suffixes.sort(groups)
    if not suffixes.verified(order, shared):  # a hash collision
        suffixes = _Suffixes(parts, exact=True)
        order, shared = suffixes.sort(groups)
    return order, shared


def repeated_windows(groups: np.ndarray, texts: list[bytes], anchors: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch the starts (within it) of the windows that another stretch of its group holds too.

    ``groups`` is ascending; ``anchors`` are the anchors' places within the stretches. A window with ``offset`` bytes before
    the anchor is the same in two stretches if these agree in ``offset`` bytes to the left of the anchor and in the rest
    to the right; both agreements are classes of neighbours in the two sorted orders.
    """
    n = len(texts)
    right, right_shared = _classes([t[a:] for t, a in zip(texts, anchors.tolist(), strict=True)], groups)
    left, left_shared = _classes([t[:a][::-1] for t, a in zip(texts, anchors.tolist(), strict=True)], groups)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    found: list[list[int]] = [[] for _ in range(n)]
    first = np.r_[True, groups[1:] != groups[:-1]] if n else np.zeros(0, bool)
    left_class, right_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for offset in range(int(anchors.max(initial=0)) + 1):
        inside = (anchors >= offset) & (anchors - offset + length <= sizes)
        if inside.sum() < 2:
            continue
        left_class[left] = np.cumsum(first | (left_shared < offset))
        right_class[right] = np.cumsum(first | (right_shared < length - offset))
        at = np.flatnonzero(inside)
        key = left_class[at] * (n + 1) + right_class[at]
        ordered = np.argsort(key, kind="stable")
        same = np.r_[False, np.diff(key[ordered]) == 0]
        twice = same | np.r_[same[1:], False]
        for i in at[ordered[twice]].tolist():
            found[i].append(int(anchors[i]) - offset)
    return [np.array(sorted(x), dtype=np.int64) for x in found]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by windows at the given ascending starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, breaks + 1]].tolist(), (starts[np.r_[breaks, len(starts) - 1]] + length).tolist(), strict=True))


def _key(docs: DataFrame) -> DataFrame:
    """Texts by two independent hashes: equal texts are one text with copies."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("text", text).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))


def _stretch_rows(docs: DataFrame, length: int, seed: int, sieve: np.ndarray | None = None) -> DataFrame:
    """(k1, k2, at, last, mid, anchor, content) for all stretches of all texts, copies included; with a ``sieve`` only
    those whose anchor it lets through."""
    names = ["k1", "k2", "at", "last", "mid", "anchor", "content"]
    shared = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 256):
            out: list[list] = [[] for _ in names]

            def flush(out=out):
                rows = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
                for column in out:
                    column.clear()
                return rows

            for k1, k2, data in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), utf8(batch.column("text")),
                                    strict=True):
                if len(data) < length:
                    continue
                for arrays in stretches(data, length, seed):
                    if shared is not None:
                        through = _passes(shared.value, arrays[3])
                        arrays = tuple(x[through] for x in arrays)
                    a, b, mid, anchor = (x.tolist() for x in arrays)
                    ends = (arrays[1] + length).tolist()
                    columns = ([k1] * len(a), [k2] * len(a), a, b, mid, anchor,
                               [_signed(data[x:y]) for x, y in zip(a, ends, strict=True)])
                    for column, values in zip(out, columns, strict=True):
                        column += values
                    if len(out[0]) >= 200_000:
                        yield flush()
            if out[0]:
                yield flush()

    return docs.select("k1", "k2", "text").mapInArrow(
        run, "k1 long, k2 long, at long, last long, mid long, anchor long, content long")


def _passes(sieve: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    through = np.ones(len(anchors), dtype=bool)
    for spot in (anchors, anchors >> 28):
        spot = (spot & (sieve.size * 64 - 1)).astype(np.int64)
        through &= (sieve[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return through


def _sieve(anchors: DataFrame, column: str = "anchor") -> np.ndarray:
    """A Bloom filter of the anchors in a bounded number of bits. It only saves shuffling: an exact join follows."""
    size = 1 << min(MOST_SIEVE_BITS, max(16, (16 * max(1, anchors.count())).bit_length()))
    spots = F.explode(F.array(F.col(column).bitwiseAND(F.lit(size - 1)),
                              F.shiftright(column, 28).bitwiseAND(F.lit(size - 1)))).alias("x")
    found = anchors.select(spots).groupBy(F.shiftright("x", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(size // 64, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _signed(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, b): removed spans of the rows (group, k1, k2, at, mid, part, open), found group by group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def solve(rows):
            rows = list({(r["group"], r["k1"], r["k2"], r["at"]): r for r in rows}.values())  # copies of a text are one
            names, groups = {}, []
            for r in rows:
                groups.append(names.setdefault(r["group"], len(names)))
            places = np.array([r["mid"] for r in rows], dtype=np.int64)
            out = []
            for r, starts in zip(rows, repeated_windows(np.array(groups), [r["part"] for r in rows], places, length), strict=True):
                if r["open"]:
                    out += [(r["k1"], r["k2"], a + r["at"], b + r["at"]) for a, b in _runs(starts, length)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["k1", "k2", "a", "b"])

        for batch in batches:
            fresh = batch.to_pylist()
            held += fresh
            size += sum(len(r["part"]) for r in fresh)
            if size > _BATCH_BYTES:
                last = held[-1]["group"]
                end = next(i for i in range(len(held) - 1, -2, -1) if i < 0 or held[i]["group"] != last) + 1
                if end:
                    yield from solve(held[:end])
                    held = held[end:]
                    size = sum(len(r["part"]) for r in held)
        if held:
            yield from solve(held)

    return (rows.repartition(parts, "group").sortWithinPartitions("group")
            .select("group", "k1", "k2", "at", "mid", "part", "open").mapInArrow(run, "k1 long, k2 long, a long, b long"))


def _cored(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Rows again, once for every block of ``width`` offsets: the group is now the anchor, the block and the core that all
    of the block's windows share, so only stretches that agree in nearly a whole window still meet."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 512):
            out = []
            for r in batch.to_pylist():
                part, mid = r["part"], r["mid"]
                for low in range(0, mid + 1, width):
                    high = min(low + width - 1, mid)  # offsets low..high, windows start at mid - high .. mid - low
                    start, stop = mid - high, min(mid - low + length, len(part))
                    core = part[mid - low:mid - low - width + 1 + length]  # the same bytes where a part has fewer offsets
                    if stop - start >= length:
                        name = xxhash.xxh3_128_hexdigest(core, seed=low) + r["group"]
                        out.append((name, r["k1"], r["k2"], r["at"] + start, high, part[start:stop], r["open"]))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:5]),
                                                  pa.array(columns[5], pa.binary()), pa.array(columns[6])],
                                                 names=["group", "k1", "k2", "at", "mid", "part", "open"])

    return rows.mapInArrow(run, "group string, k1 long, k2 long, at long, mid long, part binary, open boolean")


def removed_spans(keyed: DataFrame, length: int = LENGTH, seed: int = SEED, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(k1, k2, spans): for each text of ``keyed`` with repeated strings the byte spans to remove (not yet merged)."""
    shared = cut(_stretch_rows(keyed, length, seed).groupBy("anchor")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
                 .filter("n > 1").select(F.col("anchor").alias("_a"), (F.col("lo") == F.col("hi")).alias("same")))
    near = cut(_stretch_rows(keyed, length, seed, _sieve(shared, "_a")).join(shared, F.col("anchor") == F.col("_a")).drop("_a"))
    mixed = near.filter("not same")
    counted = cut(mixed.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"),
                                                         F.min(F.struct("k1", "k2", "at", "last", "mid")).alias("one")))
    again = counted.filter("n > 1").select(F.col("content").alias("_c"), F.col("anchor").alias("_a"))
    span = ["k1", "k2", F.col("at").alias("a"), (F.col("last") + length).alias("b")]
    whole = near.filter("same").select(*span).union(
        mixed.join(again, (F.col("content") == F.col("_c")) & (F.col("anchor") == F.col("_a"))).select(*span))
    kinds = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1")
    most = kinds.agg(F.max("m")).first()[0] or 0
    wanted = (counted.join(kinds.select("anchor", "m"), "anchor")
              .select("anchor", "m", (F.col("n") == 1).alias("open"), "one.*").groupBy("k1", "k2")
              .agg(F.collect_list(F.struct("anchor", "m", "open", "at", "last", "mid")).alias("list")))

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in text_batches(batches, 64):
            out = []
            for k1, k2, data, spans in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
                                           utf8(batch.column("text")), batch.column("list").to_pylist(), strict=True):
                if (k1, k2) == last:
                    continue  # a copy: joined rows come in key order
                last = (k1, k2)
                out += [(f"{s['anchor']:x}", k1, k2, s["at"], s["mid"] - s["at"], data[s["at"]:s["last"] + length], s["open"], s["m"])
                        for s in spans]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:5]),
                                                  pa.array(columns[5], pa.binary()), pa.array(columns[6]), pa.array(columns[7], pa.int64())],
                                                 names=["group", "k1", "k2", "at", "mid", "part", "open", "m"])

    rows = wanted.join(keyed, ["k1", "k2"]).mapInArrow(
        fetch, "group string, k1 long, k2 long, at long, mid long, part binary, open boolean, m long")
    if most <= group_limit:
        found = _sorted_groups(rows, length)
    else:
        rows = cut(rows.dropDuplicates(["group", "k1", "k2", "at"]))
        cored = cut(_cored(rows.filter(F.col("m") > group_limit), length, CORE_OFFSETS))
        sizes = cored.groupBy("group").agg(F.count(F.lit(1)).alias("m"))
        sized = cored.join(sizes, "group")
        windows = _cored(sized.filter(F.col("m") > group_limit), length, 1)  # the core is the window: a count is enough
        several = windows.groupBy("group").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("group")
        found = (_sorted_groups(rows.filter(F.col("m") <= group_limit), length)
                 .union(_sorted_groups(sized.filter(F.col("m").between(2, group_limit)), length))
                 .union(windows.filter("open").join(several, "group").select(
                     "k1", "k2", F.col("at").alias("a"), (F.col("at") + length).alias("b"))))
    return whole.union(found).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in the table, the same text included.
    Matches lie within one text each; texts shorter than ``length``, empty and null ones stay as they are. Repeated rows
    are copies of each other. ``kept`` holds the remaining bytes.
    """
    keyed = _key(docs.select("doc_id", "text"))
    spans = removed_spans(keyed, length, seed, group_limit)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 128):
            out = []
            for data, marks in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in marks or ()):
                    count += a > end or end < 0
                    if a > at:
                        kept.append(data[at:a])
                    removed += max(0, b - max(a, at))
                    at = end = max(at, b)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), removed, count, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]),
                                              pa.array(columns[3]), pa.array(columns[4], pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return (keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
            .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
