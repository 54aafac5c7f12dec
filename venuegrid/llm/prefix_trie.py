"""The prefix trie of a table of conversations, built from adaptive radix trees by key range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .radix_tree import RadixTree

#: Bytes of a turn's id: MD5 of role and text, and the text's code points, big-endian.
WIDTH = 20
#: Turns of different sequences that one task builds its tree from, about.
TASK_TURNS = 200_000
#: Conversation numbers that one row of the digest's input holds at most.
CHUNK_IDS = 4_000


def turn_id(role: Column, text: Column) -> Column:
    """A turn's fixed-width id as 40 hex digits; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(named, F.lower(F.lpad(F.hex(F.length(text)), 8, "0")))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the ids of each conversation's turns as an array of hex texts,
    ordered by turn (null first) and, where turns tie, by id."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("id")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn"))["id"].alias("turns"))


def shared_openings(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``sequences`` rebuilt: the first h turns of conversation c - c % every, then the own
    turns after the first h, with h = CRC-32 of c's decimal text, modulo ``most``."""
    base = F.col("conv_id") - F.col("conv_id") % every
    openings = sequences.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    opening = F.coalesce(F.slice("opening", F.lit(1), h), F.array().cast("array<string>"))
    return sequences.withColumn("base", base).join(openings, "base", "left").select("conv_id", F.concat(opening, own).alias("turns"))


_BORDER = "region int, node binary, parent binary, depth long, symbol binary, border boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


class _Open:
    """A node whose subtree is being walked."""

    __slots__ = ("depth", "node", "symbol", "border", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "waiting")

    def __init__(self, depth: int, node: bytes, symbol: bytes, border: bool) -> None:
        self.depth, self.node, self.symbol, self.border = depth, node, symbol, border
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.waiting: list[tuple] = []


def _region_nodes(region: int, keys: list[bytes], counts: list[int], leasts: list[int]) -> Iterator[tuple]:
    """Rows of ``_BORDER`` for the ascending ``keys`` of one range.

    Nodes that no other range can have are final. Prefixes of the range's first and last
    key (borders) may go on in others: their rows hold what this range adds, without the
    other borders below them.
    """
    tree = RadixTree(WIDTH)
    for key, n, least in zip(keys, counts, leasts, strict=True):
        tree.insert(key, (n, least))
    borders = set()
    for key in {keys[0], keys[-1]}:
        state = hashlib.md5()
        borders.add(state.digest())
        for at in range(0, len(key), WIDTH):
            state.update(key[at : at + WIDTH])
            borders.add(state.digest())
    path: list[_Open] = []
    for entered, depth, node, symbol, value in tree.walk():
        if entered:
            path.append(_Open(depth, node, symbol, node in borders))
            if value:
                path[-1].n_convs, path[-1].conv_id = value
            continue
        done = path.pop()
        own = (done.n_convs - 1) * int.from_bytes(symbol[-4:], "big")
        if not done.border:
            done.n_leaves += not done.n_children
            done.saved += own
        # Children wait for the smallest member of their parent.
        for row in done.waiting:
            yield (*row, done.conv_id)
        done.waiting.clear()
        row = (region, done.node, path[-1].node if path else None, depth, symbol, done.border, done.conv_id, done.n_convs, done.n_children, done.n_leaves, done.saved)
        if path:
            above = path[-1]
            above.n_convs += done.n_convs
            if above.conv_id is None or done.conv_id < above.conv_id:
                above.conv_id = done.conv_id
            if not done.border:
                above.n_children += 1
                above.n_leaves += done.n_leaves
                above.saved += done.saved
        if path and not path[-1].border:
            path[-1].waiting.append(row)
        else:
            yield (*row, None)


def _local_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree from the sorted keys of a task's range."""
    keys, counts, leasts, region = [], [], [], 0
    for batch in batches:
        for key, n, least, region in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "region")), strict=True):
            keys.append(key)
            counts.append(n)
            leasts.append(least)
    if not keys:
        return
    names = [part.split()[0] for part in _BORDER.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()] + [pa.int64()] * 6
    rows = []
    for row in _region_nodes(region, keys, counts, leasts):
        rows.append(row)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of one range's border nodes, deepest first."""
    rows = rows.sort_values("depth", ascending=False)
    place = {bytes(node): at for at, node in enumerate(rows["node"])}
    leaves, saved = rows["n_leaves"].tolist(), rows["saved_tokens"].tolist()
    for at, parent in enumerate(rows["parent"]):
        above = place.get(bytes(parent)) if parent is not None else None
        if above is not None:
            leaves[above] += leaves[at]
            saved[above] += saved[at]
    return pd.DataFrame({"node": rows["node"], "n_leaves": leaves, "saved_tokens": saved})


def prefix_trie(sequences: DataFrame, task_turns: int = TASK_TURNS) -> tuple[DataFrame, DataFrame]:
    """The trie of (conv_id, turns): its nodes, and (conv_id, node) with the node at which
    each conversation ends.

    Nodes have ``node`` (MD5 of the prefix, 16 bytes), ``parent``, ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens``; one node for each different sequence of first turns, the empty one
    included.

    Equal sequences are counted first. The different ones, as strings of turn ids, are dealt
    to tasks in ranges, so that a common first turn does not bind a task; each task builds
    an adaptive radix tree of its range. Only prefixes of a range's first and last key can
    lie in several ranges: these border nodes, two paths for each range, are added up
    afterwards. Long conversations cost their length. A conversation's row has all its ids
    (40 bytes a turn); no text is moved.

    Conversations without turns are members of the root alone. An empty table has no nodes.
    """
    scratch = Scratch(sequences.sparkSession, "trie")
    keyed = scratch.written(sequences.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key")), "keys")
    ends = keyed.select("conv_id", F.unhex(F.md5("key")).alias("node"))
    distinct = scratch.written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")), "distinct")
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("key") / WIDTH + 1), F.lit(0))).first()[0]
    regions = max(1, -(-int(size) // task_turns))
    dealt = distinct.repartitionByRange(regions, "key").withColumn("region", F.spark_partition_id()).sortWithinPartitions("key")
    rows = scratch.written(dealt.mapInArrow(_local_trees, _BORDER), "rows")

    border = rows.where("border")
    merged = border.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("symbol").alias("symbol"), F.min("region").alias("region"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    merged = scratch.written(merged, "borders")
    below = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("outer"))
    chars = F.conv(F.hex(F.substring("symbol", WIDTH - 3, 4)), 16, 10).cast("long")
    children = F.col("inner") + F.coalesce("outer", F.lit(0))
    own = merged.join(below, "node", "left").select(
        "node", "parent", "depth", "region", "conv_id", "n_convs", children.alias("n_children"), (F.col("n_leaves") + (children == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * chars).otherwise(0)).alias("saved_tokens"),
    )
    own = scratch.written(own, "border-nodes")

    # Each border's own part is counted in the first range that has it, along that range's paths.
    there = border.select("region", "node", "parent", "depth")
    counted = there.join(own.select("region", "node", "n_leaves", "saved_tokens"), ["region", "node"], "left").na.fill(0, ["n_leaves", "saved_tokens"])
    sums = counted.groupBy("region").applyInPandas(_add_up, "node binary, n_leaves long, saved_tokens long").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    named = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    columns = ("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    outer = own.drop("n_leaves", "saved_tokens").join(sums, "node").join(named, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    inner = rows.where("NOT border AND parent_conv_id IS NOT NULL")
    hanging = rows.where("NOT border AND parent_conv_id IS NULL").join(named, "parent").withColumn("parent_conv_id", F.col("above"))
    nodes = scratch.written(inner.select(*columns).unionByName(hanging.select(*columns)).unionByName(outer.select(*columns)), "nodes")
    scratch.drop(distinct, rows, merged, own)
    return nodes, ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's ascending conversation numbers as texts."""

    def rows() -> Iterator[tuple]:
        node, first, ids = None, 0, []
        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node or len(ids) == CHUNK_IDS:
                    if ids:
                        yield node, first, ",".join(map(str, ids))
                    node, first, ids = n, c, []
                ids.append(c)
        if ids:
            yield node, first, ",".join(map(str, ids))

    yield from _batched(rows(), {"node": pa.binary(), "first": pa.int64(), "ids": pa.string()})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        node, state = None, None
        for batch in batches:
            for n, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    yield node, state.hexdigest()
                node, state = n, hashlib.sha256(text.encode())
        if state:
            yield node, state.hexdigest()

    yield from _batched(rows(), {"node": pa.binary(), "ends_sha256": pa.string()})


def _batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, kinds)
            held = []
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal numbers of the conversations that end at
    each node, ascending and comma-joined.

    Numbers are sorted in ranges and joined to texts of some thousands; a digest then reads
    its texts in order, one at a time, whatever their number.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_chunks, "node binary, first long, ids string")
    return runs.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt ``conversations`` (conv_id, turn, role,
    text; see ``shared_openings``), with the digest of the conversations that end at each.

    Null roles and texts are empty; turns are ordered by number, null first, repeated
    numbers by the turn's id; repeated rows are turns of their own; rows without conv_id
    belong to no conversation; extra columns are ignored; texts of any length only leave
    their id and length; an empty table has no nodes.
    """
    nodes, ends = prefix_trie(shared_openings(turn_sequences(conversations)))
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
