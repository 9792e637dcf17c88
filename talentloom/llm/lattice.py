"""Language-model scores from a lattice of subwords.

A word may be cut into vocabulary pieces in many ways. Its probability is the sum over all of them, each the product of
unigram piece probabilities, found by a forward recursion in log space. Pieces of this vocabulary never cross white
space, so the lattice of a document falls apart at its words: the forward value of every distinct word is found once, and
a document's log-probability is the sum over its words and its end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.common import cut, id_crc, text_batches, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SMOOTHING = 0.1
#: Words that make up at least this share of the training tokens are looked up in every task; there are at most
#: 1 / FREQUENT = 200,000 of them, whatever the corpus. The others are joined.
FREQUENT = 5e-6
_FLUSH = 300_000  # distinct words that a task holds before it passes its counts on
_SPACE = "▁"
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Vocabulary pieces by hash, with natural-log probabilities, and those of the 256 byte pieces and the end."""

    keys: np.ndarray
    scores: np.ndarray
    longest: int
    bytes_: np.ndarray
    end: float


def _mixed(hashes: np.ndarray) -> np.ndarray:
    out = hashes * _MIX
    return out ^ (out >> np.uint64(29))


def read_vocabulary(path: str) -> tuple[list[str], list[int]]:
    """Piece texts (empty where a piece has none) and byte values (-1 where it is no byte piece), by piece number."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, values = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        values.append(int(piece[3:5], 16) if model.is_byte(i) else -1)
        texts.append("" if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else piece)
    return texts, values


def pieces_from(texts: list[str], values: list[int], counts: dict[int, int], ends: int) -> Pieces:
    """Unigram probabilities from piece counts with additive smoothing; the end is one more token."""
    usable = [i for i, (t, v) in enumerate(zip(texts, values, strict=True)) if t or v >= 0]
    total = sum(counts.get(i, 0) for i in usable) + ends + SMOOTHING * (len(usable) + 1)
    score = {i: float(np.log((counts.get(i, 0) + SMOOTHING) / total)) for i in usable}
    bytes_ = np.full(256, np.log(SMOOTHING / total))
    for i in usable:
        if values[i] >= 0:
            bytes_[values[i]] = score[i]
    found = {}
    for i in usable:
        if texts[i]:
            value = np.uint64(0)
            with np.errstate(over="ignore"):
                for code in map(ord, texts[i]):
                    value = value * _PRIME + np.uint64(code + 1)
                found[int(_mixed(np.array([value]))[0])] = score[i]
    keys = np.array(sorted(found), dtype=np.uint64)
    return Pieces(keys, np.array([found[k] for k in keys.tolist()]), max([1, *map(len, texts)]), bytes_,
                  float(np.log((ends + SMOOTHING) / total)))


def word_scores(words: list[str], pieces: Pieces) -> np.ndarray:
    """Natural-log probabilities of words: the forward recursion over all segmentations of each.

    Words of like length advance together. A character may always be spelled with byte pieces, so no word is impossible.
    """
    out = np.zeros(len(words))
    marked = [_SPACE + w for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(words))
    classes = np.ceil(np.log2(np.maximum(sizes, 4)) * 2).astype(int)
    for size in np.unique(classes):
        members = np.flatnonzero(classes == size)
        width = int(sizes[members].max())
        for start in range(0, len(members), max(1, 1_000_000 // width)):
            at = members[start:start + max(1, 1_000_000 // width)]
            out[at] = _forward([marked[i] for i in at], sizes[at], width, pieces)
    return out


def _forward(words: list[str], sizes: np.ndarray, width: int, pieces: Pieces) -> np.ndarray:
    text = "".join(w.ljust(width, "\0") for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), width)
    spelled = _spelling(codes, pieces.bytes_)
    ahead = np.full((width + 1, len(words)), -np.inf)  # log-probability of the first j characters
    ahead[0] = 0.0
    values = codes.T.astype(np.uint64) + np.uint64(1)
    for i in range(width):
        here = ahead[i]
        ahead[i + 1] = np.logaddexp(ahead[i + 1], here + spelled[:, i])
        value = np.zeros(len(words), dtype=np.uint64)
        for size in range(1, min(pieces.longest, width - i) + 1):
            value = value * _PRIME + values[i + size - 1]
            fits = np.flatnonzero(sizes >= i + size)
            if not len(fits):
                break
            keys = _mixed(value[fits])
            slot = np.minimum(np.searchsorted(pieces.keys, keys), len(pieces.keys) - 1)
            hit = pieces.keys[slot] == keys
            rows = fits[hit]
            ahead[i + size, rows] = np.logaddexp(ahead[i + size, rows], here[rows] + pieces.scores[slot[hit]])
    return ahead[sizes, np.arange(len(words))]


def _spelling(codes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """Log-probability of each character as its UTF-8 bytes."""
    known, place = np.unique(codes, return_inverse=True)
    cost = np.array([sum(bytes_[b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in known.tolist()])
    return cost[place].reshape(codes.shape)


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """(word, c): every distinct word of ``docs`` with its count in the rows that ``train`` selects. Tasks add up before
    they shuffle, in parts of bounded size."""
    rows = docs.select("text", F.coalesce(train, F.lit(False)).alias("train"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                               pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in text_batches(batches, 64):
            for text, learn in zip(utf8(batch.column("text")), batch.column("train").to_pylist(), strict=True):
                words = text.lower().split()
                if learn:
                    counts.update(words)
                else:
                    for word in words:
                        counts.setdefault(word, 0)
            if len(counts) > _FLUSH:
                yield flush()
                counts.clear()
        yield flush()

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(words: DataFrame, path: str) -> dict[int, int]:
    """Piece counts of the vocabulary's own segmentation, over the distinct words (word, c) with c > 0; at most one
    number per piece of the vocabulary comes back."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        model, counts = sentencepiece.SentencePieceProcessor(model_file=path), Counter()
        for batch in text_batches(batches, 8192):
            texts = [w.decode("utf-8", "replace") for w in utf8(batch.column("word"))]
            for ids, c in zip(model.encode(texts, num_threads=1), batch.column("c").to_pylist(), strict=True):
                for i in ids:
                    counts[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                         names=["piece", "c"])

    found = words.filter("c > 0").mapInArrow(run, "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()
    return {r["piece"]: r["c"] for r in found}


def _hash_long(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def score_documents(docs: DataFrame, train: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are the words in lower case (A-Z only) and one end. ``base_score`` is the smoothed unigram word model's log10
    probability, ``score`` the lattice's. A null text is empty: its only token is the end. Repeated rows each count and
    are each scored; without training rows all counts are 0 and the smoothing alone decides.
    """
    spark = docs.sparkSession
    words = cut(count_words(docs, train))
    n_docs = docs.filter(train).count()
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, kinds = tokens + n_docs, kinds + (n_docs > 0)
    texts, values = read_vocabulary(vocabulary)
    pieces = spark.sparkContext.broadcast(pieces_from(texts, values, count_pieces(words, vocabulary), n_docs))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 20_000):
            found = utf8(batch.column("word"))
            logs = word_scores([w.decode("utf-8", "replace") for w in found], pieces.value) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([_hash_long(w) for w in found], pa.int64()),
                                              batch.column("c"), pa.array(logs)], names=["word", "h", "c", "lp"])

    known = cut(words.mapInArrow(scored, "word binary, h long, c long, lp double"))
    often = known.filter(F.col("c") >= F.lit(max(1.0, FREQUENT * tokens))).select("word", "c", "lp").collect()
    table = spark.sparkContext.broadcast((
        {bytes(r["word"]): i for i, r in enumerate(often)}, np.array([r["c"] for r in often], dtype=np.float64),
        np.array([r["lp"] for r in often], dtype=np.float64)))
    whole = float(np.log10(tokens + SMOOTHING * (kinds + 1)))
    end_base, end_score = float(np.log10(n_docs + SMOOTHING)) - whole, pieces.value.end / float(np.log(10))

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, c, lp = table.value
        base = np.log10(c + SMOOTHING)
        get = number.get
        for batch in text_batches(batches, 256):
            sizes, hits, sums, marginals, rare = [], [], [], [], []
            for text in utf8(batch.column("text")):
                split = text.lower().split()
                ids = np.fromiter((get(w, -1) for w in split), dtype=np.int64, count=len(split))
                there = ids[ids >= 0]
                sizes.append(len(split) + 1)
                hits.append(len(there) + (n_docs > 0))
                sums.append(float(base[there].sum()))
                marginals.append(float(lp[there].sum()))
                left = Counter(split[i] for i in np.flatnonzero(ids < 0).tolist())
                rare.append([{"h": _hash_long(w), "n": n} for w, n in left.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(sums),
                 pa.array(marginals), pa.array(rare, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))],
                names=["doc_id", "n_tokens", "hits", "sums", "marginals", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    main = cut(docs.select("doc_id", "text").mapInArrow(
        parts, f"doc_id {kind}, n_tokens long, hits long, sums double, marginals double, rare array<struct<h:long,n:int>>")
        .withColumn("row", F.monotonically_increasing_id()))
    seldom = main.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.n")
    joined = seldom.join(known.filter(F.col("c") < F.lit(max(1.0, FREQUENT * tokens))).select("h", "c", "lp"), "h")
    extra = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_hits"),
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(SMOOTHING))).alias("more_sums"),
        F.sum(F.col("n") * F.col("lp")).alias("more_marginals"))
    zero = F.lit(0.0)
    return main.drop("rare").join(extra, "row", "left").select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("more_hits", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more_sums", zero) - (F.col("n_tokens") - 1) * F.lit(whole) + F.lit(end_base)).alias("base_score"),
        (F.col("marginals") + F.coalesce("more_marginals", zero) + F.lit(end_score)).alias("score"))


def score_query(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Scores of all rows, learned from those whose crc32(doc_id) mod 10 is not 0."""
    out = score_documents(docs, id_crc() % 10 != 0, vocabulary)
    return out.select("doc_id", (id_crc() % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def session_vocabulary(spark: SparkSession) -> str:
    """The vocabulary file that the session names, else the default."""
    return spark.conf.get("talentloom.llm.vocabulary", VOCABULARY)
