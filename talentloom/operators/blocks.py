"""Which pairs may still rank: bounds of the score for blocks of candidates and jobs, as matrices.

A block of candidates meets all jobs of a bundle at once: popcounts of the term masks, a matrix product of the passages with
the job vectors, and the arithmetic of the score, each as one matrix. This gives two numbers a pair that enclose its score.
A task remembers the k best lower bounds of distinct candidates per job; a pair whose upper bound lies below the k-th of
them cannot be ranked and goes no further. What is left is scored by the ordinary expressions, so the ranking is exact.

Where every pair is wanted, the same matrices give its counts: a candidate gets one list a measure, with a place for each job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.operators import narrative as na
from talentloom.operators import vectors as ve

#: Rounding of the matrices against the expressions; bounds are widened by it.
SLACK = 1e-9
#: Pairs of one block.
_CELLS = 1 << 19
_PLAIN = ("years", "title_level", "n_jobs", "progression", "growth", "semantic_coherence", "career_coherence",
          "timeline_consistency", "education_alignment", "profile_support", "behavioral_score", "availability")
_MASKS = ("matched", "in_title", "covered")
#: Stand-ins for absent work modes, which agree with nothing.
_NO_MODE, _NO_ROLE = "\0mine", "\0role"


@dataclass(frozen=True)
class JobMatrix:
    """The jobs of one bundle, by position, as arrays."""

    masks: dict[str, np.ndarray]
    numbers: dict[str, np.ndarray]
    seniority: np.ndarray
    modes: list[str]
    weights: np.ndarray
    vectors: np.ndarray
    widths: np.ndarray
    first: np.ndarray
    required: np.ndarray
    terms: list[np.ndarray]

    @property
    def size(self) -> int:
        return len(self.modes)


def _whole(vector: Sequence[float | None] | None) -> bool:
    return vector is not None and None not in vector


def job_matrix(jobs: Sequence[Row]) -> JobMatrix:
    """Arrays of a bundle's jobs; jobs without a vector, or with one that lacks a number, have zeros, which give similarity 0."""
    width = max((len(j["vector"]) for j in jobs if _whole(j["vector"])), default=0)
    vectors = np.zeros((len(jobs), width))
    for at, job in enumerate(jobs):
        if _whole(job["vector"]):
            vectors[at, :len(job["vector"])] = job["vector"]
    chunks = max((len(j["all_mask"]) for j in jobs), default=1)
    has = {name: np.zeros((64 * chunks, len(jobs)), dtype=np.float32) for name in ("first_ids", "required_ids")}
    for name, table in has.items():
        for at, job in enumerate(jobs):
            table[job[name], at] = 1
    number = lambda values: np.array([np.nan if v is None else v for v in values], dtype=float)
    defaults = {key: weight for key, _, weight in S.DIMENSIONS}
    return JobMatrix(
        {m: np.array([j[m] for j in jobs], dtype=np.int64).view(np.uint64)
         for m in ("all_mask", "first_mask", "first_words", "domain_words")},
        {"n": number(j["n_competencies"] for j in jobs), "required": number(j["n_required"] for j in jobs),
         "low": number(j["experience"]["min_years"] for j in jobs), "high": number(j["experience"]["max_years"] for j in jobs)},
        np.array([{"senior": 3, "mid": 2}.get(j["experience"]["seniority_level"], 1 << 20) for j in jobs]),
        [_NO_ROLE if j["role_mode"] is None else j["role_mode"].lower() for j in jobs],
        np.array([[d if w is None else w for w, d in ((j["weights"][k], d) for k, d in defaults.items())] for j in jobs], dtype=float),
        vectors, np.array([len(j["vector"]) if _whole(j["vector"]) else 0 for j in jobs]), has["first_ids"], has["required_ids"],
        [np.array(list(dict.fromkeys(j["term_ids"])), dtype=np.int64) for j in jobs])


# -- arrays of a candidate batch --------------------------------------------------------

def _field(batch: pa.StructArray, name: str) -> pa.Array:
    return batch.field(batch.type.get_field_index(name))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _lists(values: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the flat elements; a null list is empty."""
    lengths = values.value_lengths().fill_null(0).to_numpy()
    return np.concatenate([[0], np.cumsum(lengths)]), values.flatten()


def _words(values: pa.ListArray) -> np.ndarray:
    """Masks of one width as a matrix."""
    flat = values.flatten().to_numpy().view(np.uint64)
    return flat.reshape(len(values), -1)


def _planes(values: pa.ListArray) -> np.ndarray:
    inner = values.flatten()
    return _words(inner).reshape(len(values), len(inner) // max(1, len(values)), -1)


@dataclass(frozen=True)
class _Batch:
    ids: np.ndarray
    plain: dict[str, np.ndarray]
    modes: list[str]
    relocates: np.ndarray
    masks: dict[str, np.ndarray]
    entries: tuple[np.ndarray, np.ndarray]
    passages: tuple[np.ndarray, np.ndarray, np.ndarray]

    def part(self, a: int, b: int) -> _Batch:
        starts, words = self.entries
        rows, slots, vectors = self.passages
        mine = slice(*np.searchsorted(rows, (a, b)))
        return _Batch(self.ids[a:b], {k: v[a:b] for k, v in self.plain.items()}, self.modes[a:b], self.relocates[a:b],
                      {k: v[a:b] for k, v in self.masks.items()},
                      (starts[a:b + 1] - starts[a], words[starts[a]:starts[b]]), (rows[mine] - a, slots[mine], vectors[mine]))


def _read(batch: pa.StructArray, width: int) -> _Batch:
    masks = {m: _words(_field(batch, m)) for m in _MASKS} | {m: _planes(_field(batch, m)) for m in ("sources", "confidence")}
    starts, entries = _lists(_field(batch, "entry_masks"))
    words = _words(entries) if len(entries) else np.zeros((0, 1), dtype=np.uint64)
    begin, passages = _lists(_field(batch, "vectors"))
    row = np.repeat(np.arange(len(batch)), np.diff(begin))
    slot = np.arange(len(passages)) - begin[row]
    plain = {name: _numbers(_field(batch, name)) for name in (*_PLAIN, "proficiency", "assessed")}
    plain["n_jobs"] = np.where(_field(batch, "entry_masks").is_valid().to_numpy(zero_copy_only=False), plain["n_jobs"], np.nan)
    return _Batch(np.array(_field(batch, "candidate_id").to_pylist(), dtype=object), plain,
                  [_NO_MODE if m is None else m.lower() for m in _field(batch, "work_mode").to_pylist()],
                  _field(batch, "relocates").fill_null(False).to_numpy(zero_copy_only=False), masks, (starts, words),
                  (row, slot, _same_width(passages, width)))


def _same_width(passages: pa.ListArray, width: int) -> np.ndarray:
    """Passage vectors as rows of ``width``; one of another width, or with a missing number, has no similarity: zeros."""
    sizes = passages.value_lengths().fill_null(-1).to_numpy()
    out = np.zeros((len(passages), width))
    fits = np.flatnonzero(sizes == width)
    if width and len(fits):
        flat = passages.take(pa.array(fits)).flatten().cast(pa.float64())
        numbers = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
        if flat.null_count:
            numbers = np.where(flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)[:, None], 0.0, numbers)
        out[fits] = numbers
    return out


# -- the score as matrices ---------------------------------------------------------------

def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that each row of ``a`` shares with each row of ``b``."""
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for chunk in range(b.shape[1]):
        total += np.bitwise_count(a[:, chunk, None] & b[None, :, chunk])
    return total


def _planes_sum(planes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return sum(_common(planes[:, k], wanted) << k for k in range(planes.shape[1]))


def _over(a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
    return np.where(b > 0, a / np.where(b > 0, b, 1.0), empty)


def _average(values: Sequence, weights: Sequence[float]):
    return sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights)


def _semantic(x: _Batch, jobs: JobMatrix) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the mean positive similarity: a similarity within rounding of 0 may count as positive or not."""
    rows, slots, vectors = x.passages
    sums, sure, unsure = (np.zeros((len(x.ids), jobs.size)) for _ in range(3))
    if vectors.size:
        found = np.where(jobs.widths[None, :] == jobs.vectors.shape[1], vectors @ jobs.vectors.T, 0.0)
        for slot in range(4):
            mine, at = found[slots == slot], rows[slots == slot]
            sums[at] += np.where(mine > SLACK, mine, 0.0)
            sure[at] += mine > SLACK
            unsure[at] += np.abs(mine) <= SLACK
    low, high = sums / np.maximum(1, sure + unsure), sums / np.maximum(1, sure)
    return _clip(low), _clip(high)


def _narrative(x: _Batch, jobs: JobMatrix) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the career narrative: the latest two entries may or may not beat the older ones."""
    starts, words = x.entries
    begin, end = starts[:-1], starts[1:]
    middle = np.minimum(begin + 2, end)

    def means(wanted: np.ndarray, step: float, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        hits = np.minimum(1.0, _common(words, wanted) * step)
        sums = np.concatenate([np.zeros((1, jobs.size)), np.cumsum(hits, axis=0)])
        return [(sums[b] - sums[a]) / np.maximum(1, b - a)[:, None] for a, b in spans]

    recent, older = means(jobs.masks["first_words"], 0.15, (begin, middle), (middle, end))
    domain = _clip(means(jobs.masks["domain_words"], 0.12, (begin, end))[0])
    more, less = _clip(0.5 + recent * 0.5), _clip(0.3 + recent * 0.4)
    given = {name: x.plain[name][:, None] for name in ("progression", "growth", "n_jobs")}
    out = []
    for slack in (-SLACK, SLACK):
        special = np.where(recent + slack > older, more, less)
        value = _clip(_average((given["progression"], special, given["growth"], domain), S.NARRATIVE_WEIGHTS))
        out.append(np.where(given["n_jobs"] == 0, 0.3, np.where(np.isnan(given["n_jobs"]), np.nan, value)))
    return out[0], out[1]


def _mode_fit(x: _Batch, jobs: JobMatrix) -> np.ndarray:
    kinds = sorted({*x.modes, *jobs.modes, "flexible", "remote", "hybrid", "onsite"})
    code = {k: i for i, k in enumerate(kinds)}
    mine = np.array([code[m] for m in x.modes])[:, None]
    role = np.array([code[m] for m in jobs.modes])[None, :]
    is_ = lambda side, kind: side == code[kind]
    match = np.select([is_(role, "flexible") | is_(mine, "flexible"), role == mine, is_(role, "remote") & is_(mine, "hybrid"),
                       is_(role, "hybrid") & is_(mine, "remote")], [0.25, 0.3, 0.2, 0.15], 0.0)
    return _clip(0.5 + match + np.where(is_(role, "onsite") & x.relocates[:, None], 0.15, 0.0))


def bounds(x: _Batch, jobs: JobMatrix) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of the final score of every candidate of the block for every job; a score that is no number is unbounded."""
    c = {name: values[:, None] for name, values in x.plain.items()}
    n, required = jobs.numbers["n"][None, :], jobs.numbers["required"][None, :]
    wanted = jobs.masks["all_mask"]
    matched = _common(x.masks["matched"], wanted)
    title = _clip(_common(x.masks["in_title"], jobs.masks["first_mask"]) * 0.15)
    technical = _clip(matched / np.maximum(1.0, required) * 0.35 + _over(matched, n, 0.0) * 0.25 + c["proficiency"] * 0.15
                      + c["assessed"] * 0.15 + title * 0.10)
    proof = np.where(n > 0, _clip(_over(_planes_sum(x.masks["confidence"], wanted) / 20.0, n, 0.0)), 0.5)
    covered = _over(_common(x.masks["covered"], wanted), n, 0.0)
    density = _over(_planes_sum(x.masks["sources"], wanted), n, 0.0)
    evidence = _clip(proof * 0.5 + covered * 0.3 + density * 0.2 * 0.25)
    alignment = np.where(n == 0, 0.5, _clip(covered * 0.5 + proof * 0.5))
    trust = _clip(_average((c["semantic_coherence"], c["career_coherence"], alignment, c["timeline_consistency"],
                            c["education_alignment"], c["profile_support"]), S.AUTHENTICITY_WEIGHTS))
    low, high = jobs.numbers["low"][None, :], jobs.numbers["high"][None, :]
    years = np.where((c["years"] >= low) & (c["years"] <= high), 0.3, np.where(c["years"] >= low * 0.8, 0.15, 0.0))
    hiring = _clip(0.5 + years + np.where(c["title_level"] >= jobs.seniority[None, :], 0.2, 0.0))
    behavior = _clip(c["behavioral_score"])
    reach = _clip(_average((c["availability"], hiring, c["behavioral_score"], _mode_fit(x, jobs)), S.RECRUITABILITY_WEIGHTS))
    total = jobs.weights.sum(axis=1)
    share = np.where(total == 0, 0.0, jobs.weights.T / np.where(total == 0, 1.0, total))
    out = []
    for semantic, story, slack in zip(_semantic(x, jobs), _narrative(x, jobs), (-SLACK, SLACK), strict=True):
        dims = (technical, semantic, evidence, trust, story, behavior, reach)
        score = sum(d * w for d, w in zip(dims, share, strict=True))
        score = score + np.where((technical + slack > 0.6) & (evidence + slack > 0.6), 0.03, 0.0)
        score = score + np.where((semantic + slack > 0.5) & (story + slack > 0.5), 0.02, 0.0)
        score = score + np.where((trust + slack > 0.7) & (evidence + slack > 0.5), 0.02, 0.0)
        score = _clip(score - np.where(trust + slack < 0.3, 0.05, 0.0)) + slack
        out.append(np.where(np.isnan(score), np.copysign(np.inf, slack), score))
    return out[0], out[1]


class _Best:
    """The k best lower bounds of distinct ids per job, as seen by one task."""

    def __init__(self, k: int, jobs: int):
        self.k = k
        self.scores, self.ids = np.full((k, jobs), -np.inf), np.full((k, jobs), None, dtype=object)

    def add(self, ids: np.ndarray, lower: np.ndarray) -> None:
        """Takes a block's k best rows of distinct ids into account."""
        names, place = np.unique(ids.astype(str), return_inverse=True)
        if len(names) < len(ids):
            order = np.argsort(place, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
            lower = np.maximum.reduceat(lower[order], heads, axis=0)
        else:
            names = ids.astype(str)
        if len(names) > self.k:
            top = np.argpartition(lower, len(names) - self.k, axis=0)[len(names) - self.k:]
            lower, fresh = np.take_along_axis(lower, top, axis=0), names[top].astype(object)
        else:
            fresh = np.repeat(names[:, None].astype(object), lower.shape[1], axis=1)
        scores, held = np.concatenate([self.scores, lower]), np.concatenate([self.ids, fresh])
        order = np.argsort(-scores, axis=0, kind="stable")
        scores, held = np.take_along_axis(scores, order, axis=0), np.take_along_axis(held, order, axis=0)
        for at in range(1, len(scores)):  # an id that stood higher already
            scores[at][(held[:at] == held[at]).any(axis=0)] = -np.inf
        order = np.argsort(-scores, axis=0, kind="stable")[:self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, axis=0), np.take_along_axis(held, order, axis=0)

    @property
    def threshold(self) -> np.ndarray:
        return self.scores[-1]


def _needed() -> Column:
    return F.struct(
        F.col("candidate_id").cast("string").alias("candidate_id"), *_PLAIN, "work_mode", "relocates",
        F.col("skill.avg_proficiency").alias("proficiency"), F.col("skill.assessment_score_avg").alias("assessed"),
        *[F.col(f"masks.{m}").alias(m) for m in (*_MASKS, "sources", "confidence")], "entry_masks", "vectors")


def open_jobs(jobs: JobMatrix, k: int) -> Column:
    """Positions of the jobs for which a matched candidate may be among the k best, as far as its task has seen."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        best = _Best(k, jobs.size)
        rows = max(1, _CELLS // max(1, jobs.size))
        for batch in batches:
            whole, counts, found = _read(batch, jobs.vectors.shape[1]), [], []
            for at in range(0, len(batch), rows):
                part = whole.part(at, min(len(batch), at + rows))
                lower, upper = bounds(part, jobs)
                best.add(part.ids, lower)
                left = upper >= best.threshold[None, :]
                counts.append(left.sum(axis=1))
                found.append(np.nonzero(left)[1])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else [0]
            values = np.concatenate(found) if found else []
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(_needed())


def open_pairs(matched: DataFrame, jobs: JobMatrix, k: int) -> DataFrame:
    """``matched`` with one row per pair that may rank, and the job's position ``pos``. An id may have many rows."""
    return matched.withColumn("pos", F.explode(open_jobs(jobs, k)))


# -- all pairs: what the expressions read of every job, as lists by the job's position -------

def _lists_of(values: np.ndarray, valid: np.ndarray | None = None) -> pa.ListArray:
    """A list for each row of a matrix; places that are not valid are null."""
    flat = pa.array(values.ravel(), mask=None if valid is None else ~valid.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def _by_block(part: Callable[[pa.StructArray], pa.Array], jobs: JobMatrix, kind: str, needed: Column) -> Column:
    rows = max(1, _CELLS // max(1, jobs.size))

    def run(batch: pa.Array) -> pa.Array:  # no iterator: all measures of a query then share one pass
        return pa.concat_arrays([part(batch.slice(at, rows)) for at in range(0, max(1, len(batch)), rows)])

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(needed)


_SUMS = ("matched", "in_title", "covered", "strong", "firm", "sources", "confidence")


def term_sums(jobs: JobMatrix) -> Column:
    """Counts of each job's terms by property, and the sums of their source counts and confidence steps."""
    def part(batch: pa.StructArray) -> pa.StructArray:
        out = []
        for name in _SUMS:
            wanted = jobs.masks["first_mask" if name == "in_title" else "all_mask"]
            planes = name in ("sources", "confidence")
            held = _field(batch, name)
            out.append(_lists_of((_planes_sum(_planes(held), wanted) if planes else _common(_words(held), wanted)).astype(np.int32)))
        return pa.StructArray.from_arrays(out, names=list(_SUMS))

    needed = F.struct(*[F.col(f"masks.{name}").alias(name) for name in _SUMS])
    return _by_block(part, jobs, ", ".join(f"{name} array<int>" for name in _SUMS), needed)


def entry_hits(jobs: JobMatrix) -> Column:
    """Per job, how many of its first and of its domain words each career entry has; null without a list of entries."""
    def part(batch: pa.StructArray) -> pa.StructArray:
        values = _field(batch, "entry_masks")
        starts, entries = _lists(values)
        words = _words(entries) if len(entries) else np.zeros((0, 1), dtype=np.uint64)
        inner = pa.array(np.concatenate([[0], np.cumsum(np.repeat(np.diff(starts), jobs.size))]), pa.int32())
        outer = pa.array(np.arange(len(batch) + 1) * jobs.size, pa.int32())
        out = []
        for name in ("first_words", "domain_words"):
            hits = _common(words, jobs.masks[name]).astype(np.int32)
            flat = [hits[a:b].T.ravel() for a, b in pairwise(starts)]
            lists = pa.ListArray.from_arrays(inner, pa.array(np.concatenate(flat) if flat else [], pa.int32()))
            out.append(pa.ListArray.from_arrays(outer, lists, mask=values.is_null()))
        return pa.StructArray.from_arrays(out, names=["first", "domain"])

    return _by_block(part, jobs, "first array<array<int>>, domain array<array<int>>", F.struct("entry_masks"))


def entry_means(jobs: JobMatrix) -> Column:
    """Per job, the means over career entries that the narrative reads: of the scores of its first words in the two latest and in the
    older entries, and of its domain words in all; 0 without entries. Added entry by entry, as the expressions add."""
    def part(batch: pa.StructArray) -> pa.StructArray:
        starts, entries = _lists(_field(batch, "entry_masks"))
        words, sizes = _words(entries) if len(entries) else np.zeros((0, 1), dtype=np.uint64), np.diff(starts)
        sums = {name: np.zeros((len(batch), jobs.size)) for name in ("recent", "older", "domain")}
        first = np.minimum(1.0, _common(words, jobs.masks["first_words"]) * na.FIRST_STEP)
        domain = np.minimum(1.0, _common(words, jobs.masks["domain_words"]) * na.DOMAIN_STEP)
        for place in range(sizes.max(initial=0)):
            mine = np.flatnonzero(sizes > place)
            at = starts[mine] + place
            sums["recent" if place < 2 else "older"][mine] += first[at]
            sums["domain"][mine] += domain[at]
        counts = {"recent": np.minimum(sizes, 2), "older": np.maximum(sizes - 2, 0), "domain": sizes}
        return pa.StructArray.from_arrays([_lists_of(sums[name] / np.maximum(1, n)[:, None]) for name, n in counts.items()],
                                          names=list(counts))

    return _by_block(part, jobs, "recent array<double>, older array<double>, domain array<double>", F.struct("entry_masks"))


#: Cells of the products that are added at a time.
_TILE = 1 << 15


def _dots(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Dot products of all rows with all vectors, each added place by place, as the expressions add."""
    out = np.zeros((len(rows), len(vectors)))
    step = max(1, _TILE // max(1, len(vectors)))
    columns = np.ascontiguousarray(vectors.T)
    for a in range(0, len(rows), step):
        mine = out[a:a + step]
        product = np.empty_like(mine)
        for x, y in zip(np.ascontiguousarray(rows[a:a + step].T), columns, strict=True):
            mine += np.multiply(x[:, None], y[None, :], out=product)
    return out


def similarities(jobs: JobMatrix) -> Column:
    """Per job, the cosines of the four passages with its vector, both of length 1; 0 where either is absent, of another width or
    lacks a number."""
    def part(batch: pa.StructArray) -> pa.StructArray:
        begin, passages = _lists(_field(batch, "vectors"))
        row = np.repeat(np.arange(len(batch)), np.diff(begin))
        slot = np.arange(len(passages)) - begin[row]
        widths = passages.value_lengths().fill_null(-1).to_numpy()
        out = np.zeros((len(ve.PASSAGES), len(batch), jobs.size))
        for width in np.unique(jobs.widths[jobs.widths > 0]):
            fits = np.flatnonzero((widths == width) & (slot < len(out)))
            wanted = np.flatnonzero(jobs.widths == width)
            if len(fits):
                found = _dots(_same_width(passages.take(pa.array(fits)), width), jobs.vectors[wanted, :width])
                out[slot[fits][:, None], row[fits][:, None], wanted[None, :]] = found
        return pa.StructArray.from_arrays([_lists_of(values) for values in out], names=list(ve.PASSAGES))

    return _by_block(part, jobs, ", ".join(f"{name} array<double>" for name in ve.PASSAGES), F.struct("vectors"))


def term_marks(jobs: JobMatrix) -> Column:
    """Per job: months of the entries that mention one of its first terms, and the mean, over 100, of the assessments that name a
    required one. Null where a number that counts is missing."""
    def used(at: np.ndarray, terms: np.ndarray, places: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
        has = np.zeros((size, len(terms)), dtype=np.float32)
        has[places, at] = 1
        return has @ wanted[terms] > 0

    def part(batch: pa.StructArray) -> pa.StructArray:
        begin, evidence = _lists(_field(batch, "evidence"))
        ids = _field(evidence, "id").to_numpy(zero_copy_only=False)
        marks = [(*_lists(_field(evidence, name)), *_lists(_field(batch, values)), wanted) for name, values, wanted in (
            ("jobs", "months", jobs.first), ("tested", "scores", jobs.required))]
        out = []
        for kind, (starts, flat, first, held, wanted) in enumerate(marks):
            places, numbers = flat.to_numpy(zero_copy_only=False), _numbers(held)
            known = held.is_valid().to_numpy(zero_copy_only=False)
            result, valid = np.zeros((len(batch), jobs.size)), np.ones((len(batch), jobs.size), dtype=bool)
            for i, (a, b) in enumerate(pairwise(begin)):
                if starts[a] == starts[b]:
                    continue
                mine = slice(first[i], first[i + 1])
                hit = used(np.repeat(np.arange(b - a), np.diff(starts[a:b + 1])), ids[a:b], places[starts[a]:starts[b]],
                           first[i + 1] - first[i], wanted)
                values = np.where(hit & known[mine, None], numbers[mine, None], 0.0)
                total = np.cumsum(values, axis=0)[-1]  # in the order of the list, as the expressions add
                counted = hit.sum(axis=0)
                result[i] = total if kind == 0 else np.where(counted > 0, total / np.maximum(1, counted), 0.0) / 100.0
                valid[i] = ~(hit & ~known[mine, None]).any(axis=0)
            out.append(_lists_of(result.astype(np.int64) if kind == 0 else result, valid))
        return pa.StructArray.from_arrays(out, names=["months", "assessment"])

    needed = F.struct(F.transform("evidence", lambda e: F.struct(e["id"].alias("id"), e["jobs"].alias("jobs"), e["tested"].alias("tested")))
                      .alias("evidence"), "months", F.transform("assessments", lambda a: a["score"]).alias("scores"))
    return _by_block(part, jobs, "months array<bigint>, assessment array<double>", needed)


def open_terms(jobs: JobMatrix) -> Column:
    """Per job, the distinct ids of its terms without any source, in the job's order."""
    ids = np.concatenate([np.zeros(0, dtype=np.int64), *jobs.terms])
    job = np.repeat(np.arange(jobs.size), [len(t) for t in jobs.terms])
    rows = max(1, _CELLS // max(1, len(ids)))

    def part(batch: pa.StructArray) -> pa.ListArray:
        covered = _words(_field(batch, "covered"))
        flat, counts = [], np.zeros((len(batch), jobs.size), dtype=np.int64)
        for at in range(0, len(batch), rows):
            mine = covered[at:at + rows]
            row, place = np.nonzero((mine[:, ids >> 6] >> (ids & 63).astype(np.uint64)) & np.uint64(1) == 0)
            np.add.at(counts, (row + at, job[place]), 1)
            flat.append(ids[place])
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts.ravel())]), pa.int32()),
                                         pa.array(np.concatenate(flat), pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * jobs.size, pa.int32()), inner)

    return _by_block(part, jobs, "array<array<int>>", F.struct(F.col("masks.covered").alias("covered")))


#: Columns of ``measured``, each read only if something selects what it gives.
MEASURES = ("_sums", "_hits", "_means", "_sims", "_marks", "_open")


def measured(matched: DataFrame, jobs: JobMatrix) -> DataFrame:
    """``matched`` with the counts of every job as lists by the job's position."""
    found = (term_sums(jobs), entry_hits(jobs), entry_means(jobs), similarities(jobs), term_marks(jobs), open_terms(jobs))
    return matched.withColumns(dict(zip(MEASURES, found, strict=True)))
