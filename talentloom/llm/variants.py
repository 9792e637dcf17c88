"""Spelling variants by search schemes over bidirectional FM-indexes.

Two words that differ by one code point share a half of either exactly: the half the edit is not in. Words are dealt by
such halves, so that every block of some ten thousand words can be indexed in one task; a block's words, sorted and
delimited, form one circular text with a suffix-rank index in both directions. A query matches its half and the delimiter
before (or after) it exactly, then goes on across the other half, allowing one inserted, deleted or replaced code point.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import ascii_lower, cut

#: Letters of words, as a class of code points.
LETTERS = "A-Za-zÀ-ÿ"
#: A (document, word) hash that this divides loses a letter; the contract's words are at least this long and this frequent.
THINNED, SHORTEST, RAREST = 199, 6, 5
#: A word's form occurs at least this many times as often as the word.
OFTENER = 5
#: Indexed words of a block, on average; a half with more words than this is divided among blocks of its own.
BLOCK_WORDS = 30_000
#: Queries that are advanced together.
_TOGETHER = 4096


def occurrences(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points that occur ``rarest`` times or more in all texts.

    Null texts have no words; a null id is hashed as an empty one; repeated rows count each. Every word of every text is
    counted; counts are combined before the shuffle."""
    runs = F.split(F.col("text"), f"[^{LETTERS}]+")
    found = (docs.select("doc_id", F.explode(runs).alias("run")).filter(F.length("run") >= shortest)
             .select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), ascii_lower(F.col("run"))).alias("named"),
                     ascii_lower(F.col("run")).alias("run")))
    hashed = found.withColumn("h", F.crc32(F.col("named").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    thinned = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % THINNED == 0, thinned).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= rarest))


class Index:
    """Suffix ranks in both directions over sorted, distinct words, each after a delimiter, read in a circle.

    A state of a search is (lo, rlo, size): the rows of the matched string among the text's rotations, of its reversal among
    the reversed text's, and their number. Codes are ranks of letters, 0 is the delimiter; a letter that no word has is
    never matched. The rotation that starts with the delimiter and word i has rank i.
    """

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("\n".join(["", *words]).encode("utf-32-le"), dtype=np.uint32)
        self.letters = np.unique(points[points != 10])
        codes = np.where(points == 10, 0, np.searchsorted(self.letters, points) + 1)
        self.symbols = len(self.letters) + 1
        self.length = len(codes)
        counts = np.bincount(codes, minlength=self.symbols)
        self.start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.left, self.right = self._ranks(codes), self._ranks(codes[::-1])

    def _ranks(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits "the letter before the rotation of this rank is code c or less", and their counts before each word of 64, by c."""
        n = len(codes)
        width = max(1, int(self.symbols - 1).bit_length())
        step = max(1, 62 // width)
        key = np.zeros(n, dtype=np.int64)
        for k in range(step):
            key = (key << width) | np.roll(codes, -k)
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
            if rank[order[-1]] == n - 1 or step >= n:
                break
            key = rank * n + np.roll(rank, -step)
            step *= 2
        before = codes[order - 1]
        words = n // 64 + 1
        bits = np.zeros((self.symbols + 1, words), dtype=np.uint64)
        padded = np.full(words * 64, self.symbols, dtype=np.int64)
        padded[:n] = before
        for c in range(self.symbols):
            bits[c + 1] = np.packbits(padded <= c, bitorder="little").view(np.uint64)
        sums = np.zeros((self.symbols + 1, words), dtype=np.int64)
        np.cumsum(np.bitwise_count(bits)[:, :-1], axis=1, out=sums[:, 1:], dtype=np.int64)
        return bits, sums

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words in a row, -1 where the block lacks the letter, and each word's first place."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        codes = np.where(self.letters[at] == points, at + 1, -1) if len(self.letters) else np.full(len(points), -1)
        return codes, np.cumsum(sizes) - sizes

    @staticmethod
    def _up_to(table: tuple[np.ndarray, np.ndarray], code: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the first ``rank`` letters before rotations have a code below ``code``."""
        bits, sums = table
        word = rank >> 6
        mask = (np.uint64(1) << (rank & 63).astype(np.uint64)) - np.uint64(1)
        return sums[code, word] + np.bitwise_count(bits[code, word] & mask)

    def _extend(self, table, lo, rlo, size, code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        below_lo, below_hi = self._up_to(table, code, lo), self._up_to(table, code, lo + size)
        to_lo, to_hi = self._up_to(table, code + 1, lo), self._up_to(table, code + 1, lo + size)
        return (self.start[code] + to_lo - below_lo, rlo + below_hi - below_lo,
                np.where(code < 0, 0, (to_hi - below_hi) - (to_lo - below_lo)))

    def extend(self, state: tuple[np.ndarray, ...], code: np.ndarray, forward: bool) -> tuple[np.ndarray, ...]:
        """The state after one more letter at the right end (``forward``) or at the left end."""
        lo, rlo, size = state
        code = np.asarray(code)
        if forward:
            rlo, lo, size = self._extend(self.right, rlo, lo, size, code)
        else:
            lo, rlo, size = self._extend(self.left, lo, rlo, size, code)
        return lo, rlo, size

    def everything(self, count: int) -> tuple[np.ndarray, ...]:
        return np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64), np.full(count, self.length)


def _keep(where: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(a[where] for a in arrays)


def _exactly(index: Index, codes: np.ndarray, first: np.ndarray, count: np.ndarray, forward: bool) -> tuple[np.ndarray, ...]:
    """(query, lo, rlo, size) of the stretches of ``count`` codes, matched letter by letter, and the delimiter after them in the
    direction of travel; ``first`` is the letter to begin with."""
    step = 1 if forward else -1
    at = np.arange(len(first))
    state, done = index.everything(len(first)), 0
    closed = []
    while len(at):
        over = count[at] == done
        if over.any():
            closed.append((at[over], *index.extend(_keep(over, *state), np.zeros(int(over.sum()), dtype=np.int64), forward)))
        at, *state = _keep(~over, at, *state)
        if len(at):
            state = index.extend(tuple(state), codes[first[at] + step * done], forward)
            at, *state = _keep(state[2] > 0, at, *state)
        done += 1
    if not closed:
        return at, *index.everything(0)
    found = tuple(np.concatenate(x) for x in zip(*closed, strict=True))
    return _keep(found[3] > 0, *found)


def _one_error(index: Index, codes: np.ndarray, query: np.ndarray, state: tuple[np.ndarray, ...], first: np.ndarray,
               count: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for the words that go on from each state by ``count`` codes from ``first`` with exactly one error, then end.

    In a run of equal letters only its last letter is dropped, and a letter is inserted only where the next one differs, so a
    word is found once."""
    step = 1 if forward else -1
    letters = np.arange(1, index.symbols)
    clean = (query, *state)
    wrong: tuple[np.ndarray, ...] = tuple(np.array([], dtype=np.int64) for _ in range(5))  # query, place, lo, rlo, size
    found, done = [], 0
    while len(clean[0]) or len(wrong[0]):
        # states with their error behind them, all one letter on; those at the end close with the delimiter
        at, place, *state = wrong
        ends = place == count[at]
        if ends.any():
            lo, _, size = index.extend(_keep(ends, *state), np.zeros(int(ends.sum()), dtype=np.int64), forward)
            found.append(_keep(size > 0, at[ends], lo))
        at, place, *state = _keep(~ends, at, place, *state)
        state = index.extend(tuple(state), codes[first[at] + step * place], forward)
        at, place, *state = _keep(state[2] > 0, at, place + 1, *state)
        parts = [(at, place, *state)]
        # clean states make their error here, or go on
        at, *state = clean
        if len(at):
            inside = done < count[at]
            here = np.where(inside, codes[np.where(inside, first[at] + step * done, 0)], 0)
            more = done + 1 < count[at]
            after = np.where(more, codes[np.where(more, first[at] + step * (done + 1), 0)], 0)
            drop = inside & ((here != after) | ~more)
            parts.append((at[drop], np.full(int(drop.sum()), done + 1), *_keep(drop, *state)))
            wide = tuple(np.repeat(x, len(letters)) for x in (at, *state, here, inside))
            letter = np.tile(letters, len(at))
            new = index.extend(wide[1:4], letter, forward)
            other = (new[2] > 0) & (letter != wide[4])
            put = _keep(other, wide[0], *new)
            parts.append((put[0], np.full(len(put[0]), done), *put[1:]))
            swap = _keep(other & wide[5], wide[0], *new)
            parts.append((swap[0], np.full(len(swap[0]), done + 1), *swap[1:]))
            at, here, *state = _keep(inside, at, here, *state)
            state = index.extend(tuple(state), here, forward)
            clean = _keep(state[2] > 0, at, *state)
        wrong = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        done += 1
    if not found:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(index: Index, queries: list[str], prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) places of all indexed words one edit away from a query whose edit lies behind its first half (``prefix``),
    or within it: then words that the other search finds, those that begin with the first half, are left out.

    The exact half is matched from the middle outwards, the other one from the middle to the other end."""
    codes, starts = index.encode(queries)
    sizes = np.fromiter(map(len, queries), dtype=np.int64, count=len(queries))
    half = sizes // 2
    if prefix:
        query, lo, rlo, size = _exactly(index, codes, starts + half - 1, half, False)
        return _one_error(index, codes, query, (lo, rlo, size), starts + half, sizes - half, True)
    query, lo, rlo, size = _exactly(index, codes, starts + half, sizes - half, True)
    query, lo = _one_error(index, codes, query, (lo, rlo, size), starts + half - 1, half, False)
    return query, lo


def _block_search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, query, side, word, n) sorted by block and query: the indexed words of a block come before its queries."""
    block, words, counts, index = None, [], [], None
    for batch in batches:
        ids, kinds, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "query", "side"))
        cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])]) if len(ids) else []
        for start, end in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            part = batch.slice(int(start), int(end - start))
            if ids[start] != block:
                block, words, counts, index = ids[start], [], [], None
            if not kinds[start]:
                words += part.column("word").to_pylist()
                counts += part.column("n").to_pylist()
                continue
            if index is None:
                known = dict(zip(words, counts, strict=True))
                listed = sorted(known)
                index = Index(listed) if listed else None
                held = np.array([known[w] for w in listed], dtype=np.int64)
                words, counts = [], []
            if index is None:
                continue
            for at in range(0, part.num_rows, _TOGETHER):
                yield from _answers(index, held, part.slice(at, _TOGETHER).column("word").to_pylist(), bool(sides[start]))


def _answers(index: Index, counts: np.ndarray, queries: list[str], prefix: bool) -> Iterator[pa.RecordBatch]:
    query, word = search(index, queries, prefix)
    if not prefix:
        apart = np.fromiter((not index.words[w].startswith(queries[q][: len(queries[q]) // 2])
                             for q, w in zip(query.tolist(), word.tolist(), strict=True)), dtype=bool, count=len(query))
        query, word = query[apart], word[apart]
    if not len(query):
        return
    order = np.lexsort((word, -counts[word], query))  # words are sorted, so the first of the most frequent comes first
    query, word = query[order], word[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    near = np.diff(np.r_[first, len(query)])
    best = word[first]
    yield pa.RecordBatch.from_pydict({
        "word": pa.array([queries[q] for q in query[first]], pa.string()), "n_near": pa.array(near, pa.int64()),
        "form": pa.array([index.words[w] for w in best], pa.string()), "form_n": pa.array(counts[best], pa.int64())})


def _halves(words: DataFrame, shortest: int) -> DataFrame:
    """(side, half, query, word, n): a word as a query under its two halves, and as an indexed word under the halves of all
    words that may be one edit away. ``side`` is true for first halves."""
    size = F.length("word")
    front, back = (size / 2).cast("int"), size - (size / 2).cast("int")
    of = lambda side, query, length: F.struct(
        F.lit(side).alias("side"), F.lit(query).alias("query"),
        (F.substring(F.col("word"), F.lit(1), length) if side else F.substring(F.col("word"), size - length + 1, length)).alias("half"))
    around = lambda side: F.transform(
        F.array_distinct(F.filter(F.array(size - 1, size, size + 1), lambda m: m >= shortest)),
        lambda m: (m / 2).cast("int") if side else m - (m / 2).cast("int"))
    listed = F.concat(F.array(of(True, True, front), of(False, True, back)),
                      F.transform(F.array_distinct(around(True)), lambda k: of(True, False, k)),
                      F.transform(F.array_distinct(around(False)), lambda k: of(False, False, k)))
    return words.select("word", "n", F.explode(listed).alias("_h")).select("_h.*", "word", "n")


def near_words(words: DataFrame, shortest: int = SHORTEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near one: how many words of ``words`` (word, n; distinct, none
    shorter than ``shortest``) are one edit away, and the most frequent of them, the least in code-point order of equals."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(_halves(words, shortest))
    sizes = rows.filter("not query").groupBy("side", "half").agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.filter(F.col("_n") > block_words).withColumn("_cuts", F.ceil(F.col("_n") / block_words)).drop("_n"))
    blocks = max(1, -(-rows.filter("not query").count() // block_words))
    joined = rows.join(large, ["side", "half"], "left")
    own = F.xxhash64("word")
    portion = F.when(F.col("_cuts").isNull(), F.array(F.lit(0).cast("long"))).when(
        F.col("query"), F.sequence(F.lit(1).cast("long"), F.col("_cuts"))).otherwise(F.array(F.pmod(own, F.col("_cuts")) + 1))
    common_block = F.concat_ws(":", F.col("side").cast("string"), F.pmod(F.xxhash64("half"), F.lit(blocks)).cast("string"))
    own_block = F.concat_ws(":", F.col("side").cast("string"), F.lit("own"), F.col("half"), F.col("_portion").cast("string"))
    dealt = joined.withColumn("_portion", F.explode(portion)).select(
        F.when(F.col("_portion") == 0, common_block).otherwise(own_block).alias("block"), "query", "side", "word", "n")
    found = (dealt.repartition(parts, "block").sortWithinPartitions("block", "query")
             .mapInArrow(_block_search, "word string, n_near long, form string, form_n long"))
    # code-point order equals the order of UTF-8 bytes, which min takes
    best = F.min(F.struct(-F.col("form_n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", F.col("_b.form").alias("form"), (-F.col("_b.col1")).alias("form_n"))


def grouped(words: DataFrame, shortest: int = SHORTEST, oftener: int = OFTENER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    ``form`` is the most frequent near word if it occurs ``oftener`` times as often (else null), ``root`` is what forms lead to in
    the end. A form is more frequent than its word, so forms never go in a circle; each round follows twice as many."""
    words = cut(words)
    known = words.join(near_words(words, shortest, block_words), "word", "left")
    fits = F.col("form_n") >= oftener * F.col("n")
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                             F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    up = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(up.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        up = step.drop("_moved")
        if not step.filter("_moved").limit(1).count():
            break
    return (known.join(up, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all texts, grouped by spelling; an empty table or one without frequent words gives no rows. Other columns than
    doc_id and text are not read."""
    return grouped(occurrences(docs))
