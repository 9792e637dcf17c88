"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a good and a bad document are preferences. A document's strength is linear in its features; the probability that
one beats another is the logistic function of the difference of their strengths, fitted by the logistic loss on feature
differences. A quantile of the strengths, at the share of bad documents, is the threshold.

Every labelled row counts, and so does every pair of a good and a bad one: a pass over the rows counts bins by cells of the
strength, and two rows of different labels meet as their cells do. The counts are whole numbers, so that neither the order nor
the number of tasks changes the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import cut, id_crc, strings, text_batches
from talentloom.operators.statistics import exact_quantiles

BINS = 12
_DECAY = 1e-3
#: Cells of the strengths in a pass. A row takes its cell's mean strength, which is off by less than a cell's width.
_CELLS = 512
#: Bound of the passes, remembered steps of the descent, and the slope at which it ends.
_PASSES, _MEMORY, _FLAT = 60, 12, 1e-5
#: Training rows per task of a pass.
_ROWS_PER_TASK = 100_000
NAMES = ("log_chars", "log_words", "word_length", "long_word_share", "upper_share", "digit_share", "symbol_share",
         "space_share", "other_share", "kinds_share", "top_word_share", "repeat_share", "line_kinds_share", "line_length",
         "ended_lines", "marked_words", "upper_words", "lone_symbols", "entropy", "frequent_symbol")


def _kinds() -> np.ndarray:
    """ASCII characters as 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol."""
    table = np.full(128, 5)
    for code in range(128):
        c = chr(code)
        table[code] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if code > 32 else 0
    return table


_KINDS = _kinds()


def features(text: str) -> list[float]:
    """Surface statistics of the whole text; an empty text has zeros."""
    if not text.strip():
        return [0.0] * len(NAMES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_ = codes[codes < 128]
    kinds, n = np.bincount(_KINDS[ascii_], minlength=6), len(codes)
    words = text.split()
    count, lines = len(words), [x for x in text.splitlines() if x.strip()]
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=count)
    symbols = np.bincount(ascii_[_KINDS[ascii_] == 5], minlength=128)
    shares = np.fromiter(tally.values(), dtype=np.float64, count=len(tally)) / count
    return [
        np.log1p(n), np.log1p(count), float(sizes.mean()), float((sizes > 12).mean()), kinds[2] / n, kinds[3] / n,
        kinds[5] / n, kinds[4] / n, (n - len(ascii_)) / n, len(tally) / count, float(shares.max()),
        sum(map(str.__eq__, words, words[1:])) / count, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(x.rstrip()[-1:] in ".!?:" for x in lines) / len(lines), sum(not w[-1].isalnum() for w in words) / count,
        sum(map(str.isupper, words)) / count, sum(len(w) == 1 and not w.isalnum() for w in words) / count,
        float(-(shares * np.log(shares)).sum()) / max(1.0, np.log(count) if count > 1 else 1.0), float(symbols.max()) / n,
    ]


@dataclass
class Model:
    edges: np.ndarray  # features x inner bin edges
    weights: np.ndarray
    threshold: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return _strengths(_codes(rows, self.edges), self.weights)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(rows) - self.threshold, -50, 50)))


def _codes(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The place of each feature's bin among all bins, so that a strength may rise and fall along a feature."""
    out = np.empty((len(rows), len(edges)), dtype=np.int64)
    for f in range(len(edges)):
        out[:, f] = f * (edges.shape[1] + 1) + np.searchsorted(edges[f], rows[:, f], "right")
    return out


def _binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One indicator per feature and bin."""
    out = np.zeros((len(rows), edges.shape[0] * (edges.shape[1] + 1)))
    np.put_along_axis(out, _codes(rows, edges), 1, axis=1)
    return out


def _strengths(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[codes].sum(axis=1)


def _counts(codes: np.ndarray, good: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """label (bad, good) x cell of the strength x bin: how many rows have the bin."""
    by_feature = weights.reshape(codes.shape[1], -1)
    low, high = by_feature.min(axis=1).sum(), by_feature.max(axis=1).sum()
    cell = np.clip((_strengths(codes, weights) - low) * (_CELLS / max(high - low, 1e-9)), 0, _CELLS - 1).astype(np.int64)
    at = (good * _CELLS + cell) * len(weights)
    out = np.zeros(2 * _CELLS * len(weights), dtype=np.int64)
    for f in range(codes.shape[1]):
        out += np.bincount(at + codes[:, f], minlength=len(out))
    return out.reshape(2, _CELLS, len(weights))


def _loss(counts: np.ndarray, weights: np.ndarray, features_: int) -> tuple[float, np.ndarray]:
    """Mean loss of all pairs of a good and a bad row with the decay of the weights, and its slope."""
    n = counts.sum(axis=2) / features_
    (bad, good), pairs = n, n[0].sum() * n[1].sum()
    means = (counts @ weights) / np.maximum(n, 1)
    apart = np.clip(means[1][:, None] - means[0][None, :], -500, 500)
    wrong = 1 / (1 + np.exp(apart))
    loss = good @ np.logaddexp(0, -apart) @ bad / pairs + _DECAY / 2 * weights @ weights
    slope = ((good @ wrong) @ counts[0] - (wrong @ bad) @ counts[1]) / pairs
    return float(loss), slope + _DECAY * weights


def _descend(count: Callable[[np.ndarray], np.ndarray], size: int, features_: int) -> np.ndarray:
    """Weights of the least loss by L-BFGS; ``count`` passes over the rows and gives ``_counts`` for some weights."""
    weights, taken, passes = np.zeros(size), [], 1
    loss, slope = _loss(count(weights), weights, features_)
    while passes < _PASSES and np.abs(slope).max() > _FLAT:
        way, left = -slope, []
        for moved, turned in reversed(taken):
            share = moved @ way / (moved @ turned)
            left.append(share)
            way = way - share * turned
        if taken:
            moved, turned = taken[-1]
            way = way * (moved @ turned / (turned @ turned))
        for (moved, turned), share in zip(taken, reversed(left), strict=True):
            way = way + (share - turned @ way / (moved @ turned)) * moved
        step = 1.0 if taken else 1.0 / max(1e-9, float(np.abs(slope).max()))
        while True:
            tried = weights + step * way
            new_loss, new_slope = _loss(count(tried), tried, features_)
            passes += 1
            if new_loss <= loss + 1e-4 * step * (way @ slope) or passes >= _PASSES:
                break
            step /= 2
        if new_loss >= loss:
            break
        moved, turned = tried - weights, new_slope - slope
        weights, loss, slope = tried, new_loss, new_slope
        if moved @ turned > 1e-12:
            taken = [*taken, (moved, turned)][-_MEMORY:]
    return weights


_PROBABILITIES = [float(p) for p in np.linspace(0, 1, BINS + 1)[1:-1]]


def fit(rows: np.ndarray, good: np.ndarray, bad_share: float) -> Model | None:
    """Fits on all preference pairs of rows in memory. None without rows of both labels."""
    if not good.any() or good.all():
        return None
    edges = np.quantile(rows, _PROBABILITIES, axis=0).T.copy()
    codes = _codes(rows, edges)
    weights = _descend(lambda w: _counts(codes, good, w), edges.shape[0] * BINS, edges.shape[0])
    strengths = _strengths(codes, weights)
    # the rows may hold the labels in other shares than the table: weigh the quantile by the table's shares
    weight = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(strengths, kind="stable")
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, bad_share)), len(order) - 1)
    beside = min(at + 1, len(order) - 1)
    return Model(edges, weights, float((strengths[order[at]] + strengths[order[beside]]) / 2))


def _coarse(rows: np.ndarray) -> np.ndarray:
    """Features to ten binary digits (0.1 %), so that a column has few distinct values whatever the size of the table."""
    bits = rows.astype(np.float32).view(np.uint32)
    return (bits & np.uint32(0xFFFFE000)).view(np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row; a null text counts as an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = _coarse(np.array([features(x) for x in strings(batch.column("text"))]).reshape(-1, len(NAMES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<float>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(_matrix(batch.column("features")), edges).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * len(edges), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("good"), lists], names=["good", "codes"])

    return rows.select("good", "features").mapInArrow(run, "good boolean, codes array<smallint>")


def _counted(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """``_counts`` of a table of coded rows: one array per task, added up over the tasks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _CELLS, len(weights)), dtype=np.int64)
        for batch in batches:
            total += _counts(_matrix(batch.column("codes")).astype(np.int64),
                             batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64), weights)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    parts = rows.mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], dtype=np.int64))
    return parts.treeReduce(np.add).reshape(2, _CELLS, len(weights))


def _strength_rows(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _strengths(_matrix(batch.column("codes")).astype(np.int64), weights)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["strength"])

    return rows.mapInArrow(run, "strength double")


def train(rows: DataFrame, labels: DataFrame, keep: Column) -> Model | None:
    """Fits on every row of ``rows`` (doc_id, features) that ``labels`` (doc_id, quality) marks 0 or 1 and ``keep`` selects.
    An id with both labels counts for neither. Only quantiles and counts by bin reach the driver."""
    marked = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.min("quality").alias("_q"), F.max("quality").alias("_most")).filter("_q = _most").select("doc_id", "_q")
              .filter(keep))
    learned = cut(rows.join(marked, "doc_id").select((F.col("_q") == 1).alias("good"), "features"))
    cuts = [F.percentile(F.get("features", F.lit(f)), F.lit(_PROBABILITIES)).alias(f"f{f}") for f in range(len(NAMES))]
    seen = learned.agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), *cuts).first()
    n_good, n_bad = seen["n_good"], seen["n_bad"]
    if not n_good or not n_bad:
        return None
    edges = np.array([seen[f"f{f}"] for f in range(len(NAMES))])
    coded = cut(_coded(learned.coalesce(1 + (n_good + n_bad) // _ROWS_PER_TASK), edges))
    weights = _descend(lambda w: _counted(coded, w), len(NAMES) * BINS, len(NAMES))
    # midway between the last strength within the share of bad rows and the next one
    middle = exact_quantiles(_strength_rows(coded, weights), "strength", [(n_bad - 0.5) / (n_good + n_bad - 1)])
    return Model(edges, weights, float(middle[0]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Learns from all labelled ids whose crc32(doc_id) mod 3 is not 1. Scores see the whole text and nothing else; a null text
    is scored as an empty one, whose features are zeros. Without rows of both labels every score is 0.5. Equal texts have
    equal scores. The texts are read once; their features are kept for training and scoring.
    """
    table = cut(featured(docs))
    model = docs.sparkSession.sparkContext.broadcast(train(table, labels, id_crc() % 3 != 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("features"))
            scores = model.value.scores(rows) if model.value else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (table.mapInArrow(run, f"doc_id {kind}, score double")
            .select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))
