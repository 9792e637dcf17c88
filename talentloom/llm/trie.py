"""A prefix trie of conversations by ROLLUP over positional turn-id columns.

Turns are numbered globally, then every eight turns of a conversation become one row with eight turn-id columns. One
ROLLUP over those columns, grouped by the node that the earlier blocks lead to, gives all prefixes of all blocks at once;
grouping_id tells their depth. The node before a block is a running sum of block digests, so long conversations need no
loop over their blocks. What a node sums over its subtree is summed over its members in a second ROLLUP: every node is
charged to its smallest member, and along that member's own path what lies above is taken off again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import cut, numbered

BLOCK = 8
#: Rows of one conversation that are joined or summed in one portion.
PORTION = 4096
#: Conversation ids that are joined into one piece of an end list.
PIECE = 8192
#: The contract's rebuilding: a conversation takes its first h < SHARE turns from the first of its FAMILY.
SHARE, FAMILY = 9, 5
_IDS = [f"t{i}" for i in range(1, BLOCK + 1)]
_NUMBER = "decimal(38,0)"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id): the id is a 128-bit hash of role and text, followed by the text's UTF-8 bytes in decimals."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    print_ = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.concat(F.substring(print_, 1, 32), F.octet_length(text).cast("string")).alias("id"))


def _placed(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their place (``pos``) in the conversation, and (conv_id, turns, first) of every conversation.

    A turn's place is its global row number less that of the conversation's first, so a conversation is never gathered;
    it meets its first number in portions."""
    rows = numbered(slim, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")], "n").select("conv_id", "n", "id")
    sizes = cut(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("n").alias("first")))
    return rows, sizes


def _portions(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / PORTION), F.floor(last / PORTION)))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, id), (conv_id, length)) of the conversations after the shared openings were put in."""
    rows, sizes = _placed(turns(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARE
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("turns").alias("_head_turns"))
    plan = cut(sizes.withColumn("h", shared).withColumn("head", family).join(heads, "head", "left")
               .withColumn("given", F.least("h", F.coalesce("_head_turns", F.lit(0))))
               .withColumn("length", F.col("given") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).drop("_head_turns"))
    portions = plan.select("conv_id", "first", "h", "given",
                           _portions(F.col("first"), F.col("first") + F.col("turns") - 1).alias("_part"))
    own = (rows.withColumn("_part", F.floor(F.col("n") / PORTION)).join(portions, ["conv_id", "_part"])
           .withColumn("pos", F.col("n") - F.col("first")))
    opening = (own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARE - 1))
               .select(F.col("conv_id").alias("head"), "pos", "id"))
    rest = own.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "id")
    taken = opening.join(plan.select("conv_id", "head", "h"), "head").filter("pos < h").select("conv_id", "pos", "id")
    return rest.union(taken), plan.select("conv_id", "length")


def _before(rows: DataFrame, place: str, values: list[str]) -> DataFrame:
    """``rows`` with ``before_<value>``: the sum of the values at lower places of the same conversation; in two levels, so
    that a task sees a portion of a conversation."""
    split = rows.withColumn("_part", F.floor(F.col(place) / PORTION))
    own = Window.partitionBy("conv_id", "_part").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (split.groupBy("conv_id", "_part").agg(*[F.sum(v).alias(v) for v in values])
             .select("conv_id", "_part", *[F.coalesce(F.sum(v).over(parts), F.lit(0)).cast(_NUMBER).alias(f"_{v}") for v in values]))
    return (split.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(own), F.lit(0)).cast(_NUMBER) for v in values})
            .join(ahead, ["conv_id", "_part"])
            .withColumns({f"before_{v}": (F.col(f"before_{v}") + F.col(f"_{v}")).cast(_NUMBER) for v in values})
            .drop("_part", *[f"_{v}" for v in values]))


def _digest(block: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits from the place and ids of a full block."""
    text = F.sha2(F.concat_ws(",", block.cast("string"), *_IDS), 256)
    return tuple(F.conv(F.substring(text, at, 15), 16, 10).cast(_NUMBER) for at in (1, 16))


def blocks(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, block, a, b, t1..t8, last): one row per eight turns and one for a conversation without any. ``a`` and
    ``b`` name the node that the blocks before lead to."""
    slot = F.col("pos") % BLOCK + 1
    cells = placed.select("conv_id", F.floor(F.col("pos") / BLOCK).alias("block"), slot.alias("slot"), "id").union(
        lengths.select("conv_id", F.lit(0), F.lit(None), F.lit(None)))
    wide = cells.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("id"))).alias(f"t{i}") for i in range(1, BLOCK + 1)])
    a, b = _digest(F.col("block"))
    chained = _before(wide.withColumn("a", a).withColumn("b", b), "block", ["a", "b"])
    ends = lengths.select("conv_id", F.floor((F.greatest("length", F.lit(1)) - 1) / BLOCK).alias("block"), F.lit(True).alias("last"))
    return (chained.select("conv_id", "block", F.col("before_a").alias("a"), F.col("before_b").alias("b"), *_IDS)
            .join(ends, ["conv_id", "block"], "left"))


def _named(kind: str, *of: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(",", F.lit(kind), *of), 256), 1, 32)


def _key(depth: Column) -> Column:
    """The name of the node that the first ``depth`` ids of a block row lead to; a full block's is that of the next start."""
    start = [F.col(c).cast("string") for c in ("block", "a", "b")]
    more = _digest(F.col("block"))
    ahead = [(F.col("block") + 1).cast("string"), *[(F.col(c) + m).cast(_NUMBER).cast("string") for c, m in zip("ab", more, strict=True)]]
    within = [F.when(depth >= i, F.col(f"t{i}")) for i in range(1, BLOCK)]
    return (F.when(depth == 0, _named("start", *start)).when(depth == BLOCK, _named("start", *ahead))
            .otherwise(_named("node", *start, *within)))


def prefixes(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Every prefix of the block rows, once: (block, a, b, t1..t8, d) and the aggregates ``sums`` (name: SQL)."""
    ids = ", ".join(_IDS)
    made = ", ".join(f"{sql} AS {name}" for name, sql in sums.items())
    rolled = rows.sparkSession.sql(
        f"SELECT block, a, b, {ids}, {BLOCK} - bit_count(grouping_id()) AS d, {made} "
        f"FROM {{rows}} GROUP BY block, a, b, ROLLUP ({ids})", rows=rows)
    there = F.array(*_IDS)[F.col("d") - 1].isNotNull()
    return rolled.filter(F.when(F.col("d") == 0, F.col("block") == 0).otherwise(there))


def _nodes(rows: DataFrame) -> DataFrame:
    found = prefixes(rows, {"conv_id": "min(conv_id)", "n_convs": "count(1)"})
    d = F.col("d")
    last = F.array(*_IDS)[d - 1]
    return found.select(_key(d).alias("key"), F.when(d > 0, _key(d - 1)).alias("parent"), "conv_id", "n_convs",
                        (F.col("block") * BLOCK + d).alias("depth"),
                        F.when(d > 0, F.substring(last, 33, 20).cast("long")).otherwise(0).alias("bytes"))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key, sorted by id, as joined decimals with their first id."""
    key, held = None, []

    def piece():
        return pa.RecordBatch.from_pydict({"key": [key], "first": pa.array(held[:1], pa.int64()), "ids": [",".join(map(str, held))]})

    for batch in batches:
        for name, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (name != key or len(held) >= PIECE):
                yield piece()
                held = []
            key = name
            held.append(conv)
    if held:
        yield piece()


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces in turn; nothing but the running digest is held."""
    key, state = None, None
    for batch in batches:
        names, sums = [], []
        for name, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != key:
                if state is not None:
                    names.append(key)
                    sums.append(state.hexdigest())
                key, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(names, pa.string()), "ends_sha256": pa.array(sums, pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end. Ids are sorted by ranges and joined to pieces first, so that
    the one task that hashes a large group reads few rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in _IDS), F.lit(0))
    ends = rows.filter("last").select(_key(filled).alias("key"), "conv_id")
    pieces = ends.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _pieces, "key string, first long, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key string, ends_sha256 string")


def prefix_trie(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie over conversations given as ``placed`` (conv_id, pos, id as of ``turns``), with ``lengths``
    (conv_id, length) naming every conversation, also those without a turn.

    Each row is a distinct prefix: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, (n_convs - 1) times the UTF-8 bytes
    of a node's last text) and ends_sha256 (of the ids that end here). The two first columns name a node. No conversation:
    no row."""
    rows = cut(blocks(placed, lengths))
    nodes = cut(_nodes(rows))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = (nodes.join(children, "key", "left").join(parents, "parent", "left").drop("parent")
             .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
             .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    known = cut(_before(known, "depth", ["saved"]))
    charged = (known.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max(F.struct("depth", F.col("n_children") == 0)).alias("_end"))
               .select("conv_id", "saved", F.col("_end.col2").cast("long").alias("leaf"),
                       F.explode(F.sequence(F.lit(0), F.floor(F.col("_end.depth") / BLOCK / PORTION))).alias("_part")))
    weighed = rows.withColumn("_part", F.floor(F.col("block") / PORTION)).join(charged, ["conv_id", "_part"])
    below = (prefixes(weighed, {"_saved": "sum(saved)", "n_leaves": "sum(leaf)"})
             .select(_key(F.col("d")).alias("key"), "_saved", "n_leaves"))
    none = F.lit(hashlib.sha256().hexdigest())
    return (known.join(below, "key").join(_ends(rows), "key", "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    (F.col("_saved") - F.col("before_saved")).cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", none).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.

    Null roles and texts are empty; turns that tie are ordered by their hash, and repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation and are left out. Other columns are not read. An empty table gives no
    rows."""
    return prefix_trie(*rebuilt(conversations))
