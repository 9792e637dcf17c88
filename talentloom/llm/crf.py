"""Language identification by a linear-chain conditional random field over the words of each line.

Emission scores come from hashed affixes, character n-grams and the word itself (the lexicon); transitions are learned
with them. Forward-backward gives every word its label probabilities, so lines that switch language are labelled word by
word; a document's language is the one with the largest mean probability.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import id_crc, strings, text_batches

UNKNOWN = "und"
FEATURE_BITS = 18
#: Bounds of the training sample: about so many labelled rows, so many of every language at least (if it has them), and
#: so many runs of words in all.
ROWS, ROWS_PER_LANGUAGE, RUNS = 2400, 150, 8000
RUN_WORDS = 10
_RUNS_JOINED = 2  # runs of different documents joined in one training sequence, so that switches occur
_LETTERS = re.compile(r"[^\W\d_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # from x to


def words(text: str) -> list[str]:
    return [w for w in _LETTERS.findall(text.lower()) if any(map(str.isalpha, w))]


def _features(known: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, feature numbers) pairs, one array pair per feature template; words are padded in groups of like
    length, so long words cost in proportion to their length."""
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    shift = np.uint64(64 - FEATURE_BITS)

    def slot(tag, *codes):
        value = np.full(len(codes[0]), tag, dtype=np.uint64)
        for code in codes:
            value = (value ^ code) * _GOLD
            value ^= value >> np.uint64(31)
        return ((value * _GOLD) >> shift).astype(np.int64)

    classes = np.ceil(np.log2(np.maximum(sizes, 4))).astype(int)
    for size in np.unique(classes):
        at = np.flatnonzero(classes == size)
        width = 1 << int(size)
        text = "".join(known[i].ljust(width, "\0") for i in at)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(at), width).astype(np.uint64)
        n, rows = sizes[at], np.arange(len(at))
        whole = np.zeros(len(at), dtype=np.uint64)
        for j in range(width):
            whole = np.where(j < n, (whole ^ codes[:, j]) * _GOLD, whole)
            whole ^= whole >> np.uint64(31)
        yield at, slot(1, whole)
        for k in (1, 2, 3):
            fit = rows[n >= k]
            yield at[fit], slot(10 + k, *(codes[fit, j] for j in range(k)))
            yield at[fit], slot(20 + k, *(codes[fit, n[fit] - k + j] for j in range(k)))
        for k in (2, 3):
            for j in range(width - k + 1):
                fit = rows[n >= j + k]
                if len(fit):
                    yield at[fit], slot(30 + k, *(codes[fit, j + i] for i in range(k)))


def emissions(known: list[str], weights: np.ndarray) -> np.ndarray:
    """Words x labels scores."""
    out = np.zeros((len(known), weights.shape[1]), dtype=np.float64)
    for at, slot in _features(known):
        out[at] += weights[slot]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word. ``scores`` holds the sequences one after another (sum of lengths x labels).

    All sequences advance together, longest first, in scaled probabilities; a step touches those that still have words.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = np.r_[0, np.cumsum(lengths)[:-1]][order]
    sizes = lengths[order]
    own = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    out = np.empty_like(own)
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]))] if len(sizes) else []
    alpha = None
    for t, n in enumerate(active):
        at = starts[:n] + t
        alpha = own[at] if t == 0 else (alpha[:n] @ step) * own[at]
        alpha /= alpha.sum(axis=1, keepdims=True)
        out[at] = alpha
    labels = own.shape[1] if own.ndim > 1 else 0
    beta = np.ones((0, labels))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        fresh = np.ones((n, labels))
        if len(beta):
            following = starts[:len(beta)] + t + 1
            fresh[:len(beta)] = (own[following] * beta) @ step.T
            fresh[:len(beta)] /= fresh[:len(beta)].sum(axis=1, keepdims=True)
        beta = fresh
        both = out[starts[:n] + t] * beta
        out[starts[:n] + t] = both / both.sum(axis=1, keepdims=True)
    return out


def fit(runs: list[tuple[list[str], str]], epochs: int = 8, batch: int = 200, rate: float = 0.1, decay: float = 1e-4,
        seed: int = 0) -> Model | None:
    """Maximum likelihood by AdaGrad on the expected counts of forward-backward. None without labelled words."""
    runs = [(w, x) for w, x in runs if w]
    labels = sorted({x for _, x in runs})
    if not labels:
        return None
    number, known = {x: i for i, x in enumerate(labels)}, {}
    random, count = np.random.default_rng(seed), len(labels)
    coded = [(np.array([known.setdefault(w, len(known)) for w in ws]), number[x]) for ws, x in runs]
    pairs = list(_features(list(known)))
    word = np.concatenate([a for a, _ in pairs])
    slots = np.concatenate([b for _, b in pairs])[np.argsort(word, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(word, minlength=len(known)))]
    weights, transitions = np.zeros((1 << FEATURE_BITS, count)), np.zeros((count, count))
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(epochs):
        shuffled = random.permutation(len(coded))
        for start in range(0, len(coded), batch):
            part = [coded[i] for i in shuffled[start:start + batch]]
            ids = np.concatenate([x for x, _ in part])
            truth = np.concatenate([np.full(len(x), y) for x, y in part])
            sizes = np.array([sum(len(x) for x, _ in part[i:i + _RUNS_JOINED]) for i in range(0, len(part), _RUNS_JOINED)])
            spans = [np.arange(first[i], first[i + 1]) for i in ids]
            spread = np.repeat(np.arange(len(ids)), [len(s) for s in spans])
            where = slots[np.concatenate(spans)]
            scores = np.stack([np.bincount(spread, weights[where, k], len(ids)) for k in range(count)], axis=1)
            chance = forward_backward(scores, sizes, transitions)
            error = chance.copy()
            error[np.arange(len(ids)), truth] -= 1
            touched, place = np.unique(where, return_inverse=True)
            slope = np.stack([np.bincount(place, error[spread, k], len(touched)) for k in range(count)], axis=1)
            slope += decay * weights[touched]
            seen_w[touched] += slope ** 2
            weights[touched] -= rate * slope / np.sqrt(seen_w[touched])
            inner = np.ones(len(ids), dtype=bool)
            inner[np.r_[0, np.cumsum(sizes)[:-1]]] = False
            at = np.flatnonzero(inner)
            own = np.exp(scores - scores.max(axis=1, keepdims=True))
            joint = _pair_chances(own, chance, at, transitions, sizes)
            np.add.at(joint, (truth[at - 1], truth[at]), -1)
            joint += decay * transitions
            seen_t += joint ** 2
            transitions -= rate * joint / np.sqrt(seen_t)
    return Model(labels, weights.astype(np.float32), transitions)


def _pair_chances(own, chance, at, transitions, sizes) -> np.ndarray:
    """Expected label pairs of neighbouring words, from forward probabilities and the words' own probabilities."""
    step = np.exp(transitions - transitions.max())
    alpha, begins = np.empty_like(own), np.r_[0, np.cumsum(sizes)[:-1]]
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = begins[order], sizes[order]
    for t in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))
        here = starts[:n] + t
        alpha[here] = own[here] if t == 0 else (alpha[here - 1] @ step) * own[here]
        alpha[here] /= alpha[here].sum(axis=1, keepdims=True)
    # P(i, j) = alpha(i) step(i, j) / sum_i alpha(i) step(i, j) * P(j), since given j the past does not see the future
    joint = alpha[at - 1][:, :, None] * step[None]
    joint /= joint.sum(axis=1, keepdims=True)
    return (joint * chance[at][:, None, :]).sum(axis=0)


def predict(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, scores (the mean probability of that language), words, and certainty (the mean over the words of their
    likeliest language's probability) per text."""
    known: dict[str, int] = {}
    ids: list[int] = []
    lengths, owner, counts = [], [], np.zeros(len(texts), dtype=np.int64)
    for at, text in enumerate(texts):
        for line in text.splitlines():
            found = words(line)
            if found:
                ids += [known.setdefault(w, len(known)) for w in found]
                lengths.append(len(found))
                owner.append(at)
                counts[at] += len(found)
    if model is None or not ids:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), counts, np.zeros(len(texts))
    chance = forward_backward(emissions(list(known), model.weights)[np.array(ids)], np.array(lengths), model.transitions)
    text_of = np.repeat(np.array(owner), np.array(lengths))
    sums = np.stack([np.bincount(text_of, chance[:, k], len(texts)) for k in range(len(model.labels))], axis=1)
    best = sums.argmax(axis=1)
    share = sums[np.arange(len(texts)), best] / np.maximum(counts, 1)
    certain = np.bincount(text_of, chance.max(axis=1), len(texts)) / np.maximum(counts, 1)
    languages = [model.labels[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)]
    return languages, np.clip(share, 0, 1), counts, np.clip(certain, 0, 1)


def train(docs: DataFrame, keep: Column | None = None, rows: int = ROWS, rows_per_language: int = ROWS_PER_LANGUAGE,
          runs: int = RUNS) -> Model | None:
    """Fits on rows with a language (and ``keep``): a hash of the id draws about ``rows`` of them, and more of a language
    that would have fewer than ``rows_per_language``. Their whole texts are cut into runs of ten words. At most ``runs`` of
    these reach the driver: one of each language in turn, and within a language one of each row in turn, by hash. So
    neither long texts nor frequent languages take the share of others. All bounds are independent of the size of the table."""
    labelled = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    labelled = labelled if keep is None else labelled.filter(keep)
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) / F.lit(float(1 << 53))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    share = F.greatest(F.lit(rows / max(1, total)), F.lit(float(rows_per_language)) / F.col("_n"))
    most = F.ceil(F.lit(4.0 * runs) / (F.col("_n") * F.least(share, F.lit(1.0))))  # runs a row may give, with room for short rows
    sample = (labelled.join(F.broadcast(sizes.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang"))
              .filter(draw < share).select("doc_id", "text", "lang", most.cast("long").alias("most")))

    def cut_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 64):
            out = []
            for i, text, lang, limit in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")),
                                            batch.column("lang").to_pylist(), batch.column("most").to_pylist(), strict=True):
                found = words(text)
                places = ((xxhash.xxh64_intdigest(f"{i}:{at}", seed=23), at) for at in range(0, len(found), RUN_WORDS))
                out += [(str(i), turn, at, " ".join(found[at:at + RUN_WORDS]), lang)
                        for turn, (_, at) in enumerate(heapq.nsmallest(limit, places))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)],
                                                 names=["id", "turn", "at", "run", "lang"])

    cut = sample.mapInArrow(cut_runs, "id string, turn long, at long, run string, lang string")
    order = [F.xxhash64(F.lit(23), "id", "at", "run"), F.col("id"), F.col("at"), F.col("run")]
    ranked = cut.withColumn("_turn", F.row_number().over(Window.partitionBy("lang").orderBy("turn", *order)))
    drawn = ranked.orderBy("_turn", *order, "lang").limit(runs).collect()
    return fit([(r["run"].split(), r["lang"]) for r in drawn])


def _columns(docs: DataFrame, model: Model | None, kept: list[str], text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"),
                         F.lit(0.0).alias("certainty")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            languages, scores, counts, certain = predict(shared.value, strings(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(languages, pa.string()),
                                              pa.array(scores), pa.array(counts), pa.array(certain)], names=schema.names)

    columns = list(dict.fromkeys([*kept, text]))
    return docs.select(*columns).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words) for every row.

    Learns from rows with a language whose crc32(doc_id) mod 5 is not 0 (a null id counts as the empty text); held_out
    marks the rest. ``und`` with score 0 is given to null texts, texts without a letter, and where no row has a language.
    Ties go to the first language by code point; repeated rows get equal answers.
    """
    model = train(docs, id_crc() % 5 != 0)
    return (_columns(docs, model, ["doc_id"]).withColumn("held_out", id_crc() % 5 == 0)
            .select("doc_id", "held_out", "lang_pred", "score", "n_words"))


def with_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` (all columns) with the rows whose words have a likeliest language with a mean probability of ``least``; it
    need not be the same one for all words, so a text that mixes languages stays."""
    model = train(docs, id_crc() % 5 != 0)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # the answer's columns must not clash with the table's
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    found = _columns(renamed, model, list(names.values()), names["text"])
    return (found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("certainty") >= least))
            .select(*(F.col(n).alias(c) for c, n in names.items())))
