"""Large JSON arrays, read in byte ranges: one file of any size gives as many tasks as it has splits.

Spark's text reader cuts a file into pieces after every ``}`` and so splits it anywhere. A split does not know whether it
begins within a string, nor how deep. Each split therefore counts its quotes and the change of depth for either case; a
running sum over the splits of a file gives every split its start. With it the splits cut out their elements on their own, and
only the elements that cross a border are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(rb"\\.", re.S)
_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
_SEGMENT = "file string, block long, seq long, value string, left string, right string"


def _steps(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the quotes up to and with each of them, and by how much each would change the depth outside of a string."""
    if b"\\" in text:
        text = _ESCAPED.sub(b"__", text)
    data = np.frombuffer(text, dtype=np.uint8)
    steps = np.zeros(256, dtype=np.int8)
    steps[list(b"[{")], steps[list(b"]}")] = 1, -1
    return data, np.cumsum(data == ord('"')), steps[data]


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, bytes]]:
    """Values of the named columns and the joined text of each run of rows that agree in them."""
    at, texts = 0, batch.column("value").to_pylist()
    for key, rows in groupby(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
        size = sum(1 for _ in rows)
        yield key, b"}".join(texts[at:at + size]) + b"}"
        at += size


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run: bytes, quotes, change of depth if the run begins outside of a string, and if within one."""
    for number, batch in enumerate(batches):
        out = []
        for (file, block, size), text in _runs(batch, "file", "block", "size"):
            _, quotes, steps = _steps(text)
            within = (quotes & 1).astype(bool)
            out.append((file, block, size, number, len(text), int(quotes[-1]), int(steps[~within].sum()), int(steps[within].sum())))
        yield pa.RecordBatch.from_pydict(dict(zip(
            ["file", "block", "size", "seq", "n", "quotes", "outside", "inside"], map(list, zip(*out, strict=True)), strict=True)))


class _Split:
    """Cuts the text of one split, fed in parts, at the commas and brackets of the outermost array."""

    def __init__(self, file: str, block: int, depth: int, quotes: int):
        self.file, self.block, self.depth, self.quotes = file, block, depth, quotes
        self.seq, self.parts, self.left = 0, [], "^" if block == 0 else ""

    def _row(self, right: str) -> tuple:
        value = b"".join(self.parts).decode("utf-8", "replace")
        row = (self.file, self.block, self.seq, value, self.left, right)
        self.seq, self.parts, self.left = self.seq + 1, [], right
        return row

    def feed(self, text: bytes) -> Iterator[tuple]:
        data, quotes, steps = _steps(text)
        outside = (quotes + self.quotes & 1) == 0
        depth = self.depth + np.cumsum(np.where(outside, steps, 0))
        borders = outside & ((depth == 1) & ((data == ord(",")) | (data == ord("["))) | (depth == 0) & (data == ord("]")))
        begin = 0
        for at in np.flatnonzero(borders).tolist():
            self.parts.append(text[begin:at])
            yield self._row(chr(text[at]))
            begin = at + 1
        self.parts.append(text[begin:])
        self.depth, self.quotes = int(depth[-1]), self.quotes + int(quotes[-1])

    def end(self) -> tuple:
        return self._row("")


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, names = None, ["file", "block", "seq", "value", "left", "right"]
    for batch in batches:
        out = []
        for (file, block, depth, quotes), text in _runs(batch, "file", "block", "depth", "before"):
            if split is None or (split.file, split.block) != (file, block):
                out += [split.end()] if split else []
                split = _Split(file, block, depth, quotes)
            out += split.feed(text)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
    if split:
        yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, split.end(), strict=True)})


def _joined(segments: DataFrame) -> DataFrame:
    """Whole segments as they are; those that cross borders of splits from their pieces, in order."""
    pieces = segments.where("left = '' OR right = ''")
    begun = F.sum((F.col("left") != "").cast("long")).over(Window.partitionBy("file").orderBy("block", "seq"))
    listed = F.sort_array(F.collect_list(F.struct("block", "seq", "value", "left", "right")))
    whole = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(listed.alias("p")).select(
        "file", F.array_join(F.col("p.value"), "").alias("value"), F.get("p.left", F.lit(0)).alias("left"),
        F.element_at("p.right", -1).alias("right"))
    return segments.where("left <> '' AND right <> ''").select("file", "value", "left", "right").unionByName(whole)


def scan_array(spark: SparkSession, path: str, is_json: Callable[[Column], Column], broken: str) -> DataFrame:
    """``value``: the text of every element of the JSON arrays at ``path``.

    A file that is not one array of texts that ``is_json`` accepts gives one row instead: ``broken`` and its name. Blank
    files and empty arrays give none.
    """
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")))
    counted = pieces.mapInArrow(_counted, "file string, block long, size long, seq long, n long, quotes long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    started = counted.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    change = F.when(F.col("before") % 2 == 1, F.col("inside")).otherwise(F.col("outside"))
    starts = (started.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
              .groupBy("file", "block").agg(F.min(F.struct("seq", "depth", F.col("before") % 2)).alias("s"))
              .where("block > 0")  # a row per split, not per file: some 20 MB for 100 TB
              .select(F.xxhash64("file", "block").alias("key"), "s.depth", F.col("s.col3").alias("before")))
    segments = (pieces.withColumn("key", F.xxhash64("file", "block")).join(F.broadcast(starts), "key", "left")
                .select("value", "file", "block", F.coalesce("depth", F.lit(0)).alias("depth"),
                        F.coalesce("before", F.lit(0)).alias("before")).mapInArrow(_segments, _SEGMENT))
    found = _joined(segments)
    borders, blank = F.concat("left", "right"), ~F.col("value").rlike(r"\S")
    trailing = F.col("value").rlike(r"^\s*\}$")  # the reader ends every file with a separator
    fits = (F.when(borders.isin("^[", "[]") & blank, True).when(borders.isin("]", "^"), trailing)
            .otherwise(borders.isin("[,", ",,", ",]", "[]") & is_json(F.col("value"))))
    sizes = counted.groupBy("file").agg((F.sum("n") != F.max("size") + 1).alias("bad")).where(~F.col("file").rlike(_COMPRESSED))
    verdict = found.select("file", (~fits).alias("bad")).unionByName(sizes).groupBy("file").agg(F.bool_or("bad").alias("bad"))
    bad = verdict.where("bad").select("file")
    elements = found.where(F.col("left").isin("[", ",") & ~blank).join(bad, "file", "left_anti").select("value")
    return elements.unionByName(bad.select(F.concat(F.lit(broken), "file").alias("value")))
