"""I-Match fingerprints over randomised lexicons.

The lexicon is the set of terms whose document frequency lies in a band: very common terms say nothing, very rare ones
are mostly noise. Every randomised subset of it keeps a term by a hash of the term and the subset. A document's sorted
distinct terms within a subset are hashed; the fingerprint is the list of these hashes, and the likeness of two
fingerprints is the share of agreeing ones. Sparse subsets give steps to long texts, dense ones to short texts; every term is
in a dense subset, so that no term of the lexicon goes unseen.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import strings, text_batches

#: Document frequencies, as shares of all documents. With D distinct terms in the mean document at most D / BAND[0]
#: terms can be in the band, however many documents there are.
BAND = (0.001, 0.05)
#: One in so many terms is kept by each of the subsets of a density.
DENSITIES = (64, 128, 256)
SUBSETS_EACH = 16
#: One in so many terms is kept by each of the last sixteen subsets, four for each density.
DENSE = (2, 4, 8, 16)
_ONE_IN = tuple(np.repeat([*DENSITIES], SUBSETS_EACH).tolist() + np.repeat([*DENSE], SUBSETS_EACH // len(DENSE)).tolist())
SUBSETS = len(_ONE_IN)
_FIRST_DENSE = len(DENSITIES) * SUBSETS_EACH
MAX_LEXICON = 8_000_000
_HEX = 8
_FLUSH = 300_000
_TERMS = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    return set(_TERMS.findall(text.lower()))


@lru_cache(maxsize=100_000)
def memberships(term: str) -> int:
    """Bit s is set where subset s keeps the term; a term's chances in the subsets are independent. A term that no dense
    subset draws goes to one of the first four of them."""
    out, coded = 0, term.encode("utf-8", "surrogatepass")
    for d in range(SUBSETS // SUBSETS_EACH):
        digest = hashlib.blake2b(coded, digest_size=2 * SUBSETS_EACH, salt=bytes([d])).digest()
        for s, draw in enumerate(np.frombuffer(digest, dtype="<u2").tolist(), d * SUBSETS_EACH):
            if draw % _ONE_IN[s] == 0:
                out |= 1 << s
    return out if out >> _FIRST_DENSE else out | 1 << (_FIRST_DENSE + xxhash.xxh64_intdigest(coded, seed=1) % 4)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all rows; tasks add up before they shuffle."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

        for batch in text_batches(batches, 64):
            for text in strings(batch.column("text")):
                counts.update(terms(text))
            if len(counts) > _FLUSH:
                yield flush()
                counts.clear()
        yield flush()

    return docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> dict[str, int]:
    """Terms within the band and the subsets that keep them; the size is checked before anything is fetched."""
    rows = docs.count()
    inside = document_frequencies(docs).filter(F.col("df").between(band[0] * rows, band[1] * rows)).select("term")
    fetched = inside.limit(MAX_LEXICON + 1).collect()
    if len(fetched) > MAX_LEXICON:
        raise ValueError("the band holds too many terms; raise its lower end")
    return {r["term"]: memberships(r["term"]) for r in fetched}


def _written(value: int) -> str:
    """32 bits of a hash, the lower half first."""
    return f"{value & 0xFFFF:04x}{value >> 16 & 0xFFFF:04x}"


def fingerprint(text: str, kept: dict[str, int]) -> tuple[str, int]:
    """The fingerprint, and a bit for each subset that holds terms of the text.

    A text without any term of the lexicon is fingerprinted by the same subsets of all its terms, and one without terms
    over its characters, so that different texts do not agree for want of terms.
    """
    found = terms(text)
    chosen = sorted(found & kept.keys())
    if not found:
        coded = text.encode("utf-8", "surrogatepass")
        return "".join(_written(xxhash.xxh64_intdigest(coded, seed=s)) for s in range(SUBSETS)), (1 << SUBSETS) - 1 if text else 0
    if not chosen:
        chosen = sorted(found)
        bits = np.array([memberships(t) for t in chosen], dtype=np.uint64)
    else:
        bits = np.array([kept[t] for t in chosen], dtype=np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in chosen), dtype=np.uint64,
                         count=len(chosen))
    inside = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    parts, filled, at, joined = [], 0, 0, hashes[np.nonzero(inside)[1]].tobytes()
    for s, size in enumerate((8 * inside.sum(axis=1, dtype=np.int64)).tolist()):
        filled |= (size > 0) << s
        parts.append(_written(xxhash.xxh64_intdigest(joined[at:at + size])) if size else "0" * _HEX)
        at += size
    return "".join(parts), filled


def likeness(a: tuple[str, int], b: tuple[str, int]) -> float:
    """Share of agreeing subset hashes among the subsets that hold terms of either text; 1 if neither text has any."""
    if a[0] == b[0]:
        return 1.0
    either = a[1] | b[1]
    same = sum(1 for s in range(SUBSETS) if either >> s & 1 and a[0][_HEX * s:_HEX * s + _HEX] == b[0][_HEX * s:_HEX * s + _HEX])
    return same / either.bit_count() if either else 0.0


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next in descending doc_id, the last with the first's.

    Ids are cut into ranges at sampled quantiles, and the first row of each range also goes to the end of the range
    before; so whole texts are shuffled once, by range, and no task sees more than its range. Null ids come last, ties go
    by a hash of the text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    part = F.lit(0)
    if cuts:
        below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("doc_id") < c))
        part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(below)
    ranged = rows.withColumn("_part", part)
    heads = sorted((tuple(r) for r in ranged.groupBy("_part").agg(F.max(F.struct("doc_id", "_tie")).alias("h"))
                    .select("_part", "h.doc_id", "h._tie").collect()), key=lambda r: r[0])
    order = [F.col("_edge"), F.col("doc_id").desc_nulls_last(), F.desc("_tie")]
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    moved = docs.sparkSession.createDataFrame(
        [(heads[i - 1][0], h[1], h[2]) for i, h in enumerate(heads)], f"_to int, _id {docs.schema['doc_id'].dataType.simpleString()}, _hash long")
    edges = (rows.join(F.broadcast(moved), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_hash")))
             .groupBy("_to", "doc_id", "_tie").agg(F.any_value("text").alias("text"))
             .select("doc_id", "text", "_tie", F.col("_to").alias("_part"), F.lit(True).alias("_edge")))
    ahead = F.lead("text").over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_edge", F.lit(False)).unionByName(edges).withColumn("next_text", ahead)
            .filter(~F.col("_edge")).select("doc_id", "text", "next_text"))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text, or all it has."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compare_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A null text is empty. Equal texts have equal fingerprints. A table of one row follows itself; an empty one stays empty.
    """
    kept = docs.sparkSession.sparkContext.broadcast(lexicon(docs, band))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 128):
            out = []
            following = strings(batch.column("next_text"))
            last_text, last = None, None  # neighbours mostly follow each other, so half of the work is done already
            for text, ahead in zip(strings(batch.column("text")), following, strict=True):
                changed = edited(text, ahead)
                own = last if text == last_text else fingerprint(text, kept.value)
                last_text, last = ahead, fingerprint(ahead, kept.value)
                new = fingerprint(changed, kept.value)
                out.append((len(text), hashlib.sha256(changed.encode()).hexdigest(), own[0], new[0],
                            likeness(own, new), likeness(own, last)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return followed(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                          "edited_fingerprint string, near_edited double, near_next double")
